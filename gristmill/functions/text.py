"""Column functions on text. All of them stay inside the JVM."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill import fixed_values as fv

# Every character that counts as blank: Unicode whitespace and the four separator controls.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_BLANK = r"[\s\x1c-\x1f]"
# A lone space needs no replacement, so only other runs match.
_BLANK_RUN = rf"(?U)[\s\x1c-\x1f&&[^ ]]{_BLANK}*| {_BLANK}+"


def strip_blank(text: Column) -> Column:
    """Trim any Unicode whitespace. ``trim`` alone removes only spaces."""
    return F.btrim(text, F.lit(BLANKS))


def clean_text(text: Column) -> Column:
    """Every whitespace run becomes one space; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _BLANK_RUN, " "))


def first_truthy(*values: Column, default: str | None = None) -> Column:
    """First value that is neither NULL nor ''. Blanks-only text counts as a value."""
    present = [F.nullif(v, F.lit("")) for v in values]
    if default is not None:
        present.append(F.lit(default))
    return F.coalesce(*present)


def truthy(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True when any of the (few, literal) words is a substring."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def raw_tokens(text: Column) -> Column:
    """Lower-case tokens of three or more characters in text order, stop words included."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(fv.TOKEN_PATTERN), F.lit(1))


def similarity_tokens(text: Column, stopwords: Sequence[str] = fv.TOKEN_STOPWORDS) -> Column:
    """P20: raw tokens without stop words, as an array."""
    return F.filter(raw_tokens(text), lambda t: ~t.isin(*stopwords))


def token_rows(rows: DataFrame, text: str, *keep: str, stopwords: Sequence[str] = fv.TOKEN_STOPWORDS) -> DataFrame:
    """P20 as rows: the columns to keep and `token`. Stop words are filtered after the explode, inside
    generated code."""
    exploded = rows.select(*keep, F.explode(raw_tokens(F.col(text))).alias("token"))
    return exploded.filter(~F.col("token").isin(*stopwords))


def keyword_words(text: Column) -> Column:
    """Lower-case words. Any character but a-z, 0-9 and '-' separates; a lone '-' is a word."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9-]+)"), F.lit(1))


def slugify(name: Column) -> Column:
    """Each character outside a-z and 0-9 becomes '-'."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "-")


def min_years(text: Column) -> Column:
    """Minimum years of experience; 0 when none is stated, NULL beyond INT."""
    low = F.lower(F.coalesce(text, F.lit("")))
    range_start = F.regexp_extract(low, fv.YEARS_RANGE_PATTERN, 1)
    single = first_truthy(*[F.regexp_extract(low, fv.YEARS_SINGLE_PATTERN, g) for g in (1, 2, 3)], default="0")
    return F.when(range_start != "", range_start.try_cast("int")).otherwise(single.try_cast("int"))


def seniority(years: Column) -> Column:
    """P19, the part decided by text: true, false, or NULL when a verdict is needed."""
    return F.when(years >= fv.SENIOR_YEARS, F.lit(True)).when(years > 0, F.lit(False))


def split_feed_title(raw: Column) -> Column:
    """P12: 'Company: Title' at the first ': '; without it the whole text is the title."""
    at = F.instr(raw, ": ")
    rest = F.substring(raw, at + 2, F.length(raw))
    split = (at > 0) & (rest != "")
    return F.struct(
        F.when(split, first_truthy(F.substring(raw, F.lit(1), at - 1), default="Unknown"))
        .otherwise(F.lit("Unknown")).alias("company"),
        F.when(split, rest).otherwise(raw).alias("title"),
    )
