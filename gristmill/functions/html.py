"""HTML columns.

Markup is handled with built-in string functions. Rows those cannot settle (rare entities, broken
tags, pages without a body) go through one Arrow UDF on the standard-library parser; for all
other rows the UDF input is NULL, so their text never leaves the JVM.
"""

import re
import sys
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gristmill import fixed_values as fv
from gristmill.functions.text import clean_text

# Tasks get this module's functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_COMMENT = r"(?s)<!--.*?-->"
_SILENT = r"(?is)<(script|style|template)\b[^>]*>.*?</\1\s*>"
_TAG = r"""<[A-Za-z/!?](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_RARE_ENTITY = r"&(?:#|[A-Za-z][A-Za-z0-9]|[A-Za-z];)"
_UNCOMMON_ENTITY = "&(?!(?:" + "|".join(e[1:-1] for e, _ in fv.NATIVE_ENTITIES) + ");)(?:#|[A-Za-z][A-Za-z0-9]|[A-Za-z];)"
_LEFT_OVER_TAG = r"<[A-Za-z/!?]"

_DROPPED = "|".join(fv.DROPPED_TAGS)
SILENT = ("script", "style", "template")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _TextReader(HTMLParser):
    """Collects text nodes. `wanted(tag, attributes)` names the regions an element opens; the text
    of each region is collected apart."""

    def __init__(self, dropped=(), wanted=None):
        super().__init__(convert_charrefs=True)
        self.silent, self.wanted = frozenset(SILENT + tuple(dropped)), wanted
        self.open, self.node, self.whole, self.regions = [], [], [], []

    def end_node(self, *_):
        text, self.node = "".join(self.node), []
        if not text or any(tag in self.silent for tag, _ in self.open):
            return
        self.whole.append(text)
        for _, buffers in self.open:
            for buffer in buffers:
                buffer.append(text)

    handle_comment = handle_decl = handle_pi = unknown_decl = end_node

    def handle_starttag(self, tag, attrs):
        self.end_node()
        buffers = []
        for name in self.wanted(tag, dict(attrs)) if self.wanted else ():
            buffers.append([])
            self.regions.append((name, buffers[-1]))
        if tag not in VOID:
            self.open.append((tag, buffers))

    def handle_endtag(self, tag):
        self.end_node()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                del self.open[at:]
                return

    def handle_data(self, data):
        self.node.append(data)


def _read(markup, dropped=(), wanted=None):
    reader = _TextReader(dropped, wanted)
    reader.feed(markup)
    reader.close()
    reader.end_node()
    return reader


def _words(parts):
    return " ".join(" ".join(parts).split())


_AMPERSAND = re.compile(r"&(?:#[0-9]+;|#[xX][0-9a-fA-F]+;|([A-Za-z][A-Za-z0-9]*;))?")


def _only_ended(text):
    """Escapes every ampersand that begins no whole reference, so that it stays when references are resolved."""
    return _AMPERSAND.sub(lambda m: "&amp;" + m[0][1:] if m[0] == "&" or m[1] and m[1] not in html5 else m[0], text)


def _text_of(value, guard):
    text = unescape(guard(value))
    if "<" in text and ">" in text:
        return _words(_read(guard(text)).whole)
    return " ".join(text.split())


@F.pandas_udf(StringType())
def _text_by_parser(values: pd.Series) -> pd.Series:
    return values.map(lambda value: _text_of(value, str), na_action="ignore")


@F.pandas_udf(StringType())
def _ended_text_by_parser(values: pd.Series) -> pd.Series:
    return values.map(lambda value: _text_of(value, _only_ended), na_action="ignore")


def _description_regions(tag, attrs):
    """Places in DESCRIPTION_REGIONS of the regions that an element opens. A class holds the value somewhere, in any case."""
    def holds(attribute, value):
        own = attrs.get(attribute) or ""
        return value in own.lower() if attribute == "class" else own == value

    return [k for k, (wanted, attribute, value) in enumerate(fv.DESCRIPTION_REGIONS)
            if wanted in ("*", tag) and (not attribute or holds(attribute, value))]


def _longest_region(value):
    regions = _read(value, fv.DROPPED_TAGS, _description_regions).regions
    texts = [_words(parts) for _, parts in sorted(regions, key=lambda r: r[0])]
    return max(texts, key=len, default="")


@F.pandas_udf(StringType())
def _longest_region_by_parser(values: pd.Series) -> pd.Series:
    return values.map(_longest_region, na_action="ignore")


@F.pandas_udf(StringType())
def _longest_ended_region_by_parser(values: pd.Series) -> pd.Series:
    return values.map(lambda value: _longest_region(_only_ended(value)), na_action="ignore")


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _some(value: Column) -> Column:
    return _let(value, lambda v: F.when(v != "", v))


def unescape_common(text: Column) -> Column:
    """One level of the common entities."""
    def plain(value: Column) -> Column:
        out = value
        for entity, char in fv.NATIVE_ENTITIES:
            out = F.replace(out, F.lit(entity), F.lit(char))
        return F.when(F.contains(value, F.lit("&")), out).otherwise(value)

    return _let(text, plain)


def strip_tags(markup: Column) -> Column:
    """Comments, script/style bodies and tags become one space each."""
    text = F.regexp_replace(markup, _COMMENT, " ")
    text = F.regexp_replace(text, _SILENT, " ")
    return F.regexp_replace(text, _TAG, " ")


def _native_text(value: Column) -> Column:
    """Struct of the text by built-in functions and whether they cannot be trusted with it."""
    def settled(once: Column) -> Column:
        tagged = F.contains(once, F.lit("<")) & F.contains(once, F.lit(">"))
        return _let(F.when(tagged, strip_tags(once)), lambda bare: F.struct(
            F.coalesce(once.rlike(_RARE_ENTITY) | bare.rlike(_LEFT_OVER_TAG), once.rlike(_RARE_ENTITY), F.lit(False)).alias("hard"),
            clean_text(F.coalesce(unescape_common(bare), once)).alias("text")))

    return _let(unescape_common(value), settled)


def _settle(rows: DataFrame, out: str, value: Column, native: Column, parser, **extra: str) -> DataFrame:
    """Adds the native text, or the parser's where it is needed. The parser sees NULL for other rows.
    `extra` names further fields of the native struct to add, as new column = field."""
    staged = rows.withColumns({"_value": value, "_native": native})
    hard = F.col("_native.hard")
    # Marked so that no filter on the result is pushed down: it would parse the text twice.
    parsed = parser.asNondeterministic()(F.when(hard, F.col("_value")))
    return staged.withColumns({
        out: F.when(hard, parsed).otherwise(F.col("_native.text")),
        **{name: F.col(f"_native.{field}") for name, field in extra.items()}}).drop("_value", "_native")


def with_text(rows: DataFrame, out: str, value: Column, ended_only: bool = False) -> DataFrame:
    """Adds the text of an HTML value: unescape, strip tags if any, collapse blanks; NULL gives ''. References
    count without their semicolon as well, as browsers read them, unless ``ended_only`` leaves those as text."""
    return _settle(rows, out, value, _native_text(value), _ended_text_by_parser if ended_only else _text_by_parser)


def _drop_regions(html: Column) -> Column:
    html = F.regexp_replace(html, _COMMENT, " ")
    return F.regexp_replace(html, rf"(?is)<({_DROPPED})\b[^>]*>.*?</\1\s*>", " ")


def _native_page(html: Column) -> Column:
    """Struct of a page's title, site, body text and whether the text cannot be trusted. The dropped
    regions are cut out once for all of them."""
    def settled(kept: Column) -> Column:
        body = F.regexp_extract(kept, r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)", 1)
        title = F.coalesce(_some(_meta_title(kept)), _some(_element(kept, "h1")), _some(_element(kept, "title")), F.lit("Unknown"))
        return _let(strip_tags(body), lambda bare: F.struct(
            (~kept.rlike(r"(?i)<body\b") | kept.rlike(rf"(?i)</?(?:{_DROPPED})\b")
             | bare.rlike(_LEFT_OVER_TAG) | bare.rlike(_UNCOMMON_ENTITY)).alias("hard"),
            clean_text(unescape_common(bare)).alias("text"), title.alias("title"),
            clean_text(_meta(kept, "property", "og:site_name")).alias("site")))

    return _let(_drop_regions(html), settled)


def with_generic_page(rows: DataFrame, html: Column, text: str, title: str, site: str, ended_only: bool = False) -> DataFrame:
    """Adds the longest text among the description regions, the title (og:title, twitter:title,
    first h1 outside dropped regions, <title>, Unknown) and the site name ('' if none). A body contains
    all the regions, so its text is the answer whenever there is one; only pages without a clean body
    are parsed. A NULL page gives NULLs. ``ended_only`` as in ``with_text``."""
    native = F.when(html.isNotNull(), _native_page(html))
    parser = _longest_ended_region_by_parser if ended_only else _longest_region_by_parser
    return _settle(rows, text, html, native, parser, **{title: "title", site: "site"})


def _meta(html: Column, attribute: str, name: str) -> Column:
    """Content of the first meta tag with attribute=name, in either attribute order; NULL without one."""
    content = r"""(?is)\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    tag = F.regexp_extract(html, rf"""(?is)<meta\b[^>]*\b{attribute}\s*=\s*["']?{name}["'\s/>][^>]*>?""", 0)
    return _let(tag, lambda t: F.when(t != "", unescape_common(F.concat(
        F.regexp_extract(t, content, 1), F.regexp_extract(t, content, 2)))))


def _element(html: Column, tag: str) -> Column:
    inner = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    return clean_text(unescape_common(F.regexp_replace(F.regexp_replace(inner, _COMMENT, ""), _TAG, "")))


def _meta_title(html: Column) -> Column:
    """og:title if there is such a tag, even an empty one; else twitter:title."""
    return F.coalesce(_meta(html, "property", "og:title"), _meta(html, "name", "twitter:title"))


def _markup(html: Column) -> Column:
    """The page without comments and without what stands inside scripts and styles."""
    return F.regexp_replace(F.regexp_replace(html, _COMMENT, " "), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")


def page_title(html: Column) -> Column:
    """Og:title, twitter:title, then <title>; '' when none."""
    return _let(_markup(html), lambda h: F.coalesce(_some(clean_text(_meta_title(h))), _element(h, "title")))


def iframe_source(html: Column) -> Column:
    """First iframe or frame in document order whose source starts with http, else NULL."""
    tags = F.regexp_extract_all(_markup(html), F.lit(r"(?is)<i?frame\b[^>]*>"), F.lit(0))
    sources = F.transform(tags, lambda t: unescape_common(F.regexp_extract(
        t, r"""(?is)\ssrc\s*=\s*["']?([^"'\s>]*)""", 1)))
    return F.try_element_at(F.filter(sources, lambda s: F.startswith(s, F.lit("http"))), F.lit(1))


def json_ld_blocks(html: Column) -> Column:
    """Raw text of the ld+json scripts in document order, comments left out."""
    return F.regexp_extract_all(
        F.regexp_replace(html, _COMMENT, " "),
        F.lit(r"""(?s)<(?i:script)\b[^>]*(?i:\stype)\s*=\s*["']?application/ld\+json(?:["'\s][^>]*)?>(.*?)</(?i:script)"""),
        F.lit(1),
    )
