"""Postings looked up by url in landed detail records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill import fixed_values as fv
from gristmill.functions import urls as U
from gristmill.functions import variants as V
from gristmill.functions.html import page_title, with_text
from gristmill.functions.postings import posting
from gristmill.functions.text import clean_text, first_truthy, strip_blank, truthy
from gristmill.operators.limits import union_sources
from gristmill.sources.boards import one_record


def requested(urls: DataFrame, url: str = "url") -> DataFrame:
    """Distinct urls with their lookup key. Repeats of a url combine before the shuffle."""
    return urls.select(F.col(url).alias("url")).distinct().withColumn("key", U.board_key(F.col("url")))


def _matched(urls: DataFrame, details: DataFrame, board: str) -> DataFrame:
    wanted = urls.filter((F.col("key.board") == board) & F.col("key.job_id").isNotNull())
    records = one_record(details.filter(F.col("board") == board)).select(
        F.col("slug").alias("d_slug"), F.col("job_id").alias("d_job"), F.try_parse_json("body").alias("data"),
        F.col("body").alias("raw"))
    return wanted.join(records, (F.col("key.slug") == F.col("d_slug")) & (F.col("key.job_id") == F.col("d_job")))


def _text(path: str) -> Column:
    return V.get(F.col("data"), path)


def greenhouse(urls: DataFrame, details: DataFrame) -> DataFrame:
    """S11."""
    rows = _matched(urls, details, "greenhouse").filter(truthy(_text("$.content")))
    data = F.col("data")
    location = F.when(V.is_object(data, "$.location"), F.coalesce(_text("$.location.name"), F.lit("Unknown"))) \
        .otherwise(_text("$.location"))
    return with_text(rows, "description", _text("$.content")).select("url", posting(
        _text("$.title"), first_truthy(_text("$.company_name"), F.col("key.slug")), F.col("url"),
        F.col("description"), "greenhouse", location).alias("posting"))


def lever(urls: DataFrame, details: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """A record without a title takes that of its page. `pages` has url, html."""
    rows = _matched(urls, details, "lever").withColumn("description", clean_text(first_truthy(
        _text("$.descriptionBodyPlain"), _text("$.descriptionPlain"), _text("$.text"), default=""))).filter(
        F.col("description") != "")
    title = _text("$.title")
    if pages is not None:
        titles = pages.select(F.col("url").alias("page_url"), page_title(F.col("html")).alias("page_title"))
        rows = rows.withColumn("title_url", first_truthy(_text("$.hostedUrl"), F.col("url"))).join(
            titles, F.col("title_url") == F.col("page_url"), "left")
        title = first_truthy(title, F.col("page_title"))
    return rows.select("url", posting(title, F.col("key.slug"), F.col("url"), F.col("description"), "lever",
                                      _text("$.categories.location")).alias("posting"))


def ashby(urls: DataFrame, boards: DataFrame) -> DataFrame:
    """The first board row of the company whose jobUrl contains the job id.

    `boards` holds board payloads (slug, body, ord). Containment becomes an equi-join: each row is
    indexed by the substrings of its jobUrl that are as long as some id asked of its company (for the
    usual fixed-length ids that is one per path part), and only the place of the first row per substring is kept.
    No pairs of ids and rows of a company are formed, and no job is shuffled with the substrings of its link.
    """
    wanted = urls.filter((F.col("key.board") == "ashby") & F.col("key.job_id").isNotNull()).select(
        "url", F.col("key.slug").alias("slug"), F.col("key.job_id").alias("job_id"))
    # At most as many lengths as a url has characters.
    lengths = wanted.groupBy("slug").agg(F.collect_set(F.length("job_id")).alias("lengths"))
    rows = boards.withColumn("data", F.try_parse_json("body")).select(
        "slug", "ord", F.posexplode(V.items(F.col("data"), "$.jobs")).alias("pos", "job")).withColumn(
        "ord", U.two_part_order(F.col("ord"), F.col("pos"))).drop("pos")
    # A job id is a path part, so it lies within one part of the link. The index holds places alone; jobs are fetched by them.
    link = F.coalesce(V.get(F.col("job"), "$.jobUrl"), F.lit(""))
    listed = rows.select("slug", "ord", F.explode(F.split(link, "[/?#]")).alias("part")).join(lengths, "slug")
    sized = listed.select("slug", "ord", "part", F.explode("lengths").alias("n")).filter(F.length("part") >= F.col("n"))
    indexed = sized.select("slug", "ord", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("part") - F.col("n") + 1),
        lambda i: F.substring(F.col("part"), i, F.col("n")))).alias("job_id"))
    first = indexed.groupBy("slug", "job_id").agg(F.min("ord").alias("ord"))
    data = wanted.join(first, ["slug", "job_id"]).join(rows.withColumnRenamed("job", "data"), ["slug", "ord"])
    return data.select("url", posting(
        _text("$.title"), F.col("slug"), F.col("url"), F.coalesce(_text("$.descriptionPlain"), F.lit("")), "ashby",
        F.coalesce(V.text_if_string(F.col("data"), "$.location"), F.lit("Unknown"))).alias("posting"))


def smartrecruiters(urls: DataFrame, details: DataFrame) -> DataFrame:
    """Section texts in the record's order; sections may be an object or an array. The order of an object's keys
    is read from the text, as a VARIANT sorts them."""
    rows = _matched(urls, details, "smartrecruiters")
    data = F.col("data")
    path = "$.jobAd.sections"
    names = F.json_object_keys(F.get_json_object("raw", path))
    as_object = F.transform(names, lambda name: V.get(data, path, "map<string,variant>")[name])
    sections = F.when(V.is_array(data, path), V.get(data, path, "array<variant>")).otherwise(as_object)
    texts = with_text(rows.select("url", "key", "data", "raw", F.posexplode(sections).alias("pos", "section")), "text",
                      V.text_if_string(F.col("section"), "$.text"))
    # One record's sections: a few rows per url.
    joined = texts.groupBy("url").agg(
        F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("parts"), F.first(F.to_json("data")).alias("body"),
        F.first("key").alias("key"))
    rows = joined.withColumn("description", clean_text(F.array_join("parts.text", "\n"))).filter(
        F.col("description") != "").withColumn("data", F.try_parse_json("body"))
    place = strip_blank(F.concat(F.coalesce(_text("$.location.city"), F.lit("")), F.lit(" "),
                                 F.coalesce(_text("$.location.country"), F.lit(""))))
    return rows.select("url", posting(_text("$.name"), F.col("key.slug"), F.col("url"), F.col("description"),
                                      "smartrecruiters", place).alias("posting"))


def careers(urls: DataFrame, details: DataFrame, sites=fv.CAREERS_SITES) -> DataFrame:
    """Careers sites with their own API. Detail rows have board 'careers', the company as slug."""
    company = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, name in sites:
        company = company.when(U.host(F.col("url")).rlike(pattern), F.lit(name))
    wanted = urls.select("url", company.alias("company"), U.job_id(F.col("url")).alias("job_id")).filter(
        F.col("company").isNotNull() & F.col("job_id").isNotNull())
    records = one_record(details.filter(F.col("board") == "careers")).select(
        F.col("slug").alias("d_slug"), F.col("job_id").alias("d_job"), F.try_parse_json("body").alias("data"))
    rows = wanted.join(records, (F.col("company") == F.col("d_slug")) & (F.col("job_id") == F.col("d_job"))).filter(
        truthy(_text("$.description")))
    return with_text(rows, "description", _text("$.description")).select("url", posting(
        _text("$.title"), F.col("company"), F.col("url"), F.col("description"), "careers-api",
        first_truthy(_text("$.groupedLocation"), _text("$.location"), default="Unknown")).alias("posting"))


def board_postings(urls: DataFrame, details: DataFrame, boards: DataFrame, pages: DataFrame | None = None,
                   url: str = "url") -> DataFrame:
    """(url, posting) of every url whose board has a record for it."""
    wanted = requested(urls, url)
    return union_sources(greenhouse(wanted, details), lever(wanted, details, pages), ashby(wanted, boards),
                         smartrecruiters(wanted, details))
