"""The best description per url.

Pages have one row per url: url, html, iframe_html, rendered_html, rendered_iframe_html,
rendered_text (NULL where not fetched), and an optional response text of a batch extraction. The ladder is
climbed rung by rung: urls that one rung settles leave, by an anti join on the url, before the documents of the
next are read, so no parser meets a page whose posting is known. What a rung finds is a small table of postings,
cut off in the checkpoint folder; documents are read where they lie.
"""

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill import fixed_values as fv
from gristmill.functions import html as H
from gristmill.functions import variants as V
from gristmill.functions.html import with_text
from gristmill.functions.postings import json_ld_company, json_ld_items, json_ld_location, posting
from gristmill.functions.responses import extracted_posting
from gristmill.functions.text import first_truthy, strip_blank
from gristmill.functions.urls import embedded_board_url
from gristmill.session import cut_lineage
from gristmill.sources import details as D


def _with_json_ld(items: DataFrame, out: str) -> DataFrame:
    """Adds the posting of one JobPosting `item`, NULL when its cleaned description is too short."""
    item = F.col("item")
    described = with_text(items, "_text", first_truthy(V.get(item, "$.description"), V.get(item, "$.jobDescription"), default=""))
    made = posting(first_truthy(V.get(item, "$.title"), V.get(item, "$.name")), json_ld_company(item), F.col("url"),
                   F.col("_text"), "json-ld", json_ld_location(item))
    return described.withColumn(out, F.when(F.length("_text") >= fv.MIN_DESCRIPTION, made)).drop("_text")


def json_ld_postings(pages: DataFrame) -> DataFrame:
    """(url, posting) from the first JobPosting in `html` with a long enough description. Only
    pages with such items produce rows to group."""
    items = pages.select("url", F.posexplode(json_ld_items(F.col("html"))).alias("pos", "item"))
    made = _with_json_ld(items, "posting").filter(F.col("posting").isNotNull())
    return made.groupBy("url").agg(F.min_by("posting", "pos").alias("posting"))


def with_generic_posting(pages: DataFrame, html: str, out: str, ended_only: bool = False) -> DataFrame:
    """Adds the generic posting of a page, NULL when its longest region is too short. ``ended_only`` as in ``with_text``."""
    described = H.with_generic_page(pages, F.col(html), "_text", "_title", "_site", ended_only)
    made = posting(F.col("_title"), F.col("_site"), F.col("url"), F.col("_text"), "generic", F.lit("Unknown"))
    return described.withColumn(out, F.when(F.length("_text") >= fv.MIN_DESCRIPTION, made)).drop("_text", "_title", "_site")


def text_posting(text: Column, url: Column) -> Column:
    """First non-blank line, 120 characters, is the title."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip_blank), lambda l: l != "")
    title = F.substring(F.try_element_at(lines, F.lit(1)), 1, 120)
    made = posting(title, F.lit("Unknown"), url, text, "generic", F.lit("Unknown"))
    return F.when(F.length(text) >= fv.MIN_DESCRIPTION, made)


def better(current: Column, candidate: Column) -> Column:
    """The candidate replaces the current one only when its description is strictly longer."""
    longer = F.length(candidate["description"]) > F.length(current["description"])
    return F.when(current.isNull() | F.coalesce(longer, F.lit(False)), candidate).otherwise(current)


def _length(p: Column) -> Column:
    return F.coalesce(F.length(p["description"]), F.lit(-1))


def _board_lookups(pages: DataFrame, details: DataFrame, boards: DataFrame) -> DataFrame:
    """Per url the board posting of the url itself, of the board link in its page and of the
    one in its rendered page, each under the page's own url. All links are looked up together."""
    links = pages.select("url", F.posexplode(F.array(
        F.col("url"), embedded_board_url(F.col("html")), embedded_board_url(F.col("rendered_html")))).alias("slot", "link")) \
        .filter(F.col("link").isNotNull())
    found = D.board_postings(links, details, boards, pages.select("url", "html"), url="link").select(F.col("url").alias("link"), "posting")
    own = links.join(found, "link").withColumn("posting", F.col("posting").withField("url", F.col("url")))

    def picked(slot: int) -> Column:
        return F.any_value(F.when(F.col("slot") == slot, F.col("posting")), True)

    return own.groupBy("url").agg(picked(0).alias("_api"), picked(1).alias("_embedded"), picked(2).alias("_rendered_api"))


def documents_of(pages: DataFrame, page: str, frame: str) -> DataFrame:
    """(url, slot, html): the page (slot 0) and its frame (slot 1) as rows, where they were fetched."""
    slots = F.posexplode(F.array(page, frame)).alias("slot", "html")
    return pages.select("url", slots).filter(F.col("html").isNotNull())


def page_postings(documents: DataFrame, ended_only: bool = False) -> DataFrame:
    """(url, posting) of pages: JSON-LD, then the frame's JSON-LD, the frame's generic text, and the page's generic text. Each
    document is read once for both kinds; documents are never shuffled, only postings are."""
    read = with_generic_posting(documents.withColumn("_items", json_ld_items(F.col("html"))), "html", "_generic", ended_only)
    items = read.select("url", "slot", "_generic", F.posexplode_outer("_items").alias("pos", "item"))
    found = _with_json_ld(items, "_ld").select("url", "slot", "_generic", "pos", "_ld")

    def structured(slot: int) -> Column:
        return F.expr(f"min_by(_ld, pos) FILTER (WHERE slot = {slot} AND _ld IS NOT NULL)")

    def generic(slot: int) -> Column:
        return F.any_value(F.when(F.col("slot") == slot, F.col("_generic")), True)

    posting_of = F.coalesce(structured(0), structured(1), generic(1), generic(0))
    return found.groupBy("url").agg(posting_of.alias("posting")).filter(F.col("posting").isNotNull())


def without(pages: DataFrame, *settled: DataFrame) -> DataFrame:
    """Pages whose url is in none of the tables."""
    for known in settled:
        pages = pages.join(known.select("url"), "url", "left_anti")
    return pages


def is_full(p: Column) -> Column:
    return _length(p) >= fv.FULL_DESCRIPTION


def best_descriptions(pages: DataFrame, details: DataFrame, boards: DataFrame, responses: DataFrame | None = None,
                      ended_only: bool = False) -> DataFrame:
    """The posting chosen per url, with its fields as columns; urls without any are left out.

    Order: board record, careers record, embedded board (own url kept), page text if full, the longer
    of page and rendered page and rendered text, extraction response, whatever remains.
    `responses` has url, text. With `ended_only`, generic text keeps references without a semicolon as they are. A url's documents are parsed only if the rungs before left it open; links of
    all pages are looked up at once.
    """
    read = partial(page_postings, ended_only=True) if ended_only else page_postings
    careers = D.careers(D.requested(pages), details).withColumnRenamed("posting", "_careers")
    looked_up = cut_lineage(_board_lookups(pages, details, boards).join(careers, "url", "full_outer"))
    by_board = looked_up.select("url", F.coalesce("_api", "_careers", "_embedded").alias("posting")).filter(F.col("posting").isNotNull())

    by_page = cut_lineage(read(documents_of(without(pages.select("url", "html", "iframe_html"), by_board), "html", "iframe_html")))
    full = by_page.filter(is_full(F.col("posting")))

    rendered = without(pages.select("url", "rendered_html", "rendered_iframe_html", "rendered_text"), by_board, full)
    by_rendered = read(documents_of(rendered, "rendered_html", "rendered_iframe_html")).withColumnRenamed("posting", "_rendered")
    rows = rendered.select("url", F.col("rendered_html").isNotNull().alias("_is_rendered"), text_posting(F.col("rendered_text"), F.col("url")).alias("_text"),
                           F.coalesce(F.col("rendered_text") != "", F.lit(False)).alias("_asked"))
    rows = rows.join(by_page.withColumnRenamed("posting", "_page"), "url", "left").join(by_rendered, "url", "left").join(
        looked_up.select("url", "_rendered_api"), "url", "left")
    page = F.col("_page")
    short = F.col("_rendered").isNotNull() & ~is_full(F.col("_rendered"))
    rows = rows.withColumn("_rendered", F.coalesce(F.when(short, F.col("_rendered_api")), F.col("_rendered")))
    rows = rows.withColumn("_longer", better(page, F.col("_rendered")))
    rows = rows.withColumn("_chosen", F.when(F.col("_is_rendered"), better(F.col("_longer"), F.col("_text"))).otherwise(page))
    if responses is not None:
        answers = responses.select("url", extracted_posting(F.col("text"), F.col("url")).alias("_extracted"))
        rows = rows.join(answers, "url", "left")
    else:
        rows = rows.withColumn("_extracted", F.lit(None).cast(rows.schema["_chosen"].dataType))
    enough = _length(F.col("_chosen")) >= fv.MIN_DESCRIPTION
    rest = rows.select(F.coalesce(F.when(enough, F.col("_chosen")), F.when(F.col("_asked"), F.col("_extracted")), "_chosen").alias("posting"))
    every = by_board.select("posting").unionByName(full.select("posting")).unionByName(rest)
    return every.filter(F.col("posting").isNotNull()).select("posting.*")
