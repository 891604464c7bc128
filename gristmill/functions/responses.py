"""Columns that read batches of model responses."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions import variants as V
from gristmill.functions.text import first_truthy, strip_blank


def salvage_json(text: Column) -> Column:
    """The whole text as JSON, else the span from the first '{' to the last '}', else NULL."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0)))


def json_truthy(value: Column) -> Column:
    """False for NULL, JSON null, {}, [], 0, false and ''."""
    empty = F.to_json(value).isin("{}", "[]", "0", "0.0", "false", '""', "null")
    return value.isNotNull() & ~F.is_variant_null(value) & ~empty


def score_from_response(response: Column) -> Column:
    """P25: integer `score` of the JSON, else the first digits in the text, else 0."""
    data = salvage_json(response)
    stated = F.when(V.is_object(data, "$"), V.get(data, "$.score", "int"))
    digits = F.regexp_extract(F.coalesce(response, F.lit("")), r"\d+", 0).try_cast("int")
    return F.coalesce(stated, digits, F.lit(0))


def verdict_from_response(response: Column) -> Column:
    """The undecided rows' verdict is 'yes' after trimming, in any case."""
    return F.lower(strip_blank(response)) == "yes"


def reordered_list(response: Column, original: Column) -> Column:
    """Texts of the numbered lines; the original list when no line is numbered."""
    lines = F.transform(F.split(strip_blank(F.coalesce(response, F.lit(""))), "\n"), strip_blank)
    numbered = F.filter(lines, lambda l: l.rlike(r"^\d") & (F.instr(F.substring(l, 1, 4), ". ") > 0))
    texts = F.transform(numbered, lambda l: F.regexp_extract(l, r"(?s)^.*?\. (.*)$", 1))
    return F.when(F.size(texts) > 0, texts).otherwise(original)


def picked_items(response: Column, items: Column, limit: int = 3) -> Column:
    """Items at the comma-separated 1-based positions, in the order given. Positions out of
    range are dropped, repeats stay, and nothing valid gives an empty list."""
    marks = F.transform(F.split(F.coalesce(response, F.lit("")), ","), strip_blank)
    positions = F.transform(F.filter(marks, lambda m: m.rlike(r"^\d+$")), lambda m: m.try_cast("int"))
    valid = F.filter(positions, lambda p: (p >= 1) & (p <= F.size(items)))
    return F.slice(F.transform(valid, lambda p: F.try_element_at(items, p)), 1, limit)


def comma_list(response: Column, limit: int = 8) -> Column:
    """Trimmed non-empty parts, the first eight."""
    parts = F.transform(F.split(F.coalesce(response, F.lit("")), ","), strip_blank)
    return F.slice(F.filter(parts, lambda p: p != ""), 1, limit)


def application_result(response: Column) -> Column:
    """Letter and reason of a usable response; `error` holds the raw text of any other."""
    data = salvage_json(response)
    usable = json_truthy(data)
    error = F.when(V.is_object(data, "$") & V.get(data, "$.error", "variant").isNotNull(),
                   V.get(data, "$.error")).when(~F.coalesce(usable, F.lit(False)), F.coalesce(response, F.lit("")))
    return F.struct(
        F.when(error.isNull(), V.get(data, "$.cover_letter")).alias("cover_letter"),
        F.when(error.isNull(), V.get(data, "$.fit_reason")).alias("fit_reason"),
        error.alias("error"),
    )


def extracted_posting(response: Column, url: Column) -> Column:
    """Posting of an extraction response, NULL without a description."""
    from gristmill.functions.postings import posting

    data = salvage_json(response)
    description = V.get(data, "$.description")
    found = posting(V.get(data, "$.title"), V.get(data, "$.company"), url, description, "llm",
                    first_truthy(V.get(data, "$.location"), default="Unknown"))
    return F.when(F.coalesce(description, F.lit("")) != "", found)
