"""Landed board payloads to normalised postings.

Input is a payload table: source, slug, branch, page_no, body, ord (see schemas.PAYLOAD), or RSS
items. Each reader parses bodies as VARIANT, explodes the job array and returns ordered postings. A
malformed body or job is skipped on its own; it never cuts off the rest of its source.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill import fixed_values as fv
from gristmill import schemas
from gristmill.functions import predicates as P
from gristmill.functions import urls as U
from gristmill.functions import variants as V
from gristmill.functions.html import with_text
from gristmill.functions.text import first_truthy, split_feed_title, strip_blank, truthy


def _entries(payloads: DataFrame, *paths: str, whole: bool = True) -> DataFrame:
    """One row per array entry: the payload columns, job (VARIANT) and ord over all payloads."""
    parsed = payloads.withColumn("payload", F.try_parse_json("body")).drop("body")
    return parsed.select("*", F.posexplode(V.items(F.col("payload"), *paths, whole=whole)).alias("pos", "job")).withColumn(
        "ord", U.two_part_order(F.col("ord"), F.col("pos"))).filter(V.is_object(F.col("job"), "$"))


def _text(path: str) -> Column:
    return V.get(F.col("job"), path)


def _rank(source_rank: int | Column) -> Column:
    """The rank of a source, or a payload column that has it."""
    return F.lit(source_rank).cast("int").alias("source_rank")


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.select(*schemas.ORDERED_POSTING.fieldNames())


def _board_titles(rows: DataFrame, terms: Sequence[str]) -> DataFrame:
    """F1, F3 for company boards; empty titles stay."""
    titled = rows.withColumn("title", F.lower(F.coalesce(_text("$.title"), F.lit(""))))
    return titled.filter(~P.senior_board_title(F.col("title")) & P.matches_role(F.col("title"), terms))


def _kept_title(title: Column, terms: Sequence[str]) -> Column:
    """F2, F3, F5 for remote boards."""
    return truthy(title) & ~P.senior_remote_title(title) & P.matches_role(title, terms)


def one_record(details: DataFrame) -> DataFrame:
    """Detail records, one per board, slug and job: of several, the least body. Copies combine before the shuffle."""
    return details.groupBy("board", "slug", "job_id").agg(F.min("body").alias("body"))


def greenhouse(payloads: DataFrame, details: DataFrame, terms: Sequence[str] = (), source_rank: int | Column = 0) -> DataFrame:
    """List rows with the raw content of their detail record, '' where there is none. Title
    filters run before the join."""
    listed = _board_titles(_entries(payloads, "$.jobs", whole=False), terms).withColumn("job_id", _text("$.id"))
    content = one_record(details.filter(F.col("board") == "greenhouse")).select(
        F.col("slug").alias("d_slug"), F.col("job_id").alias("d_job"),
        V.get(F.try_parse_json("body"), "$.content").alias("content"))
    joined = listed.join(content, (F.col("slug") == F.col("d_slug")) & (F.col("job_id") == F.col("d_job")), "left")
    location = F.col("job")
    return _ordered(joined.select(
        "title", F.col("slug").alias("company"),
        U.listing_url(_text("$.jobUrl"), "https://boards.greenhouse.io/", F.col("slug"), "/jobs/", F.col("job_id")).alias("url"),
        F.coalesce("content", F.lit("")).alias("description"),
        F.coalesce(V.get(location, "$.location.name"), F.lit("Unknown")).alias("location"),
        F.lit("greenhouse").alias("source"), "ord", _rank(source_rank)))


def lever(payloads: DataFrame, terms: Sequence[str] = (), source_rank: int | Column = 0) -> DataFrame:
    """S4."""
    rows = _board_titles(_entries(payloads, "$.jobs"), terms)
    return _ordered(rows.select(
        "title", F.col("slug").alias("company"),
        U.listing_url(_text("$.hostedUrl"), "https://jobs.lever.co/", F.col("slug"), "/", _text("$.id")).alias("url"),
        F.coalesce(_text("$.description"), F.lit("")).alias("description"),
        F.coalesce(_text("$.categories.location"), F.lit("Unknown")).alias("location"),
        F.lit("lever").alias("source"), "ord", _rank(source_rank)))


def ashby(payloads: DataFrame, terms: Sequence[str] = (), source_rank: int | Column = 0) -> DataFrame:
    """Only a string counts as a location."""
    rows = _board_titles(_entries(payloads, "$.jobs"), terms)
    return _ordered(rows.select(
        "title", F.col("slug").alias("company"),
        U.listing_url(_text("$.jobUrl"), "https://boards.ashbyhq.com/", F.col("slug"), "/", _text("$.id")).alias("url"),
        first_truthy(_text("$.descriptionPlain"), _text("$.description"), default="").alias("description"),
        F.coalesce(V.text_if_string(F.col("job"), "$.location"), F.lit("Unknown")).alias("location"),
        F.lit("ashby").alias("source"), "ord", _rank(source_rank)))


# Fields of the remote boards' jobs: title, company, url, place as given, location, text. Each reads one VARIANT.
def _himalayas_fields(get) -> dict[str, Column]:
    place = F.coalesce(V.join_list_or_text(get(None), "$.locationRestrictions"), F.lit(""))
    return {"title": F.lower(F.coalesce(get("$.title"), F.lit(""))), "company": first_truthy(get("$.companyName"), get("$.companySlug"), default="Unknown"),
            "url": first_truthy(get("$.applicationLink"), get("$.guid"), default=""), "place": place, "location": first_truthy(place, default="Remote"),
            "about": get("$.description")}


def _remotive_fields(get) -> dict[str, Column]:
    place = first_truthy(get("$.candidate_required_location"), default="Remote")
    return {"title": strip_blank(F.coalesce(get("$.title"), F.lit(""))), "company": first_truthy(get("$.company_name"), default="Unknown"),
            "url": F.coalesce(get("$.url"), F.lit("")), "place": place, "location": place, "about": get("$.description")}


def _remoteok_fields(get) -> dict[str, Column]:
    place = first_truthy(get("$.location"), default="Remote")
    return {"title": strip_blank(F.coalesce(get("$.position"), F.lit(""))), "company": first_truthy(get("$.company"), default="Unknown"),
            "url": U.remoteok_url(first_truthy(get("$.url"), get("$.apply_url"), default=""), get("$.slug")), "place": place, "location": place,
            "about": get("$.description")}


def _jobicy_fields(get) -> dict[str, Column]:
    job = get(None)
    places = [F.when(V.is_array(job, p) & (F.size(V.get(job, p, "array<variant>")) == 0), F.lit(None)).otherwise(V.join_list_or_text(job, p))
              for p in ("$.jobGeo", "$.jobLocation", "$.location", "$.candidate_required_location")]
    place = first_truthy(*places, default="Remote")
    return {"title": strip_blank(first_truthy(get("$.jobTitle"), get("$.title"), default="")),
            "company": first_truthy(get("$.companyName"), get("$.company"), default="Unknown"),
            "url": first_truthy(get("$.jobLink"), get("$.url"), get("$.link"), default=""), "place": place, "location": place,
            "about": first_truthy(get("$.jobDescription"), get("$.description"), get("$.jobExcerpt"), default="")}


REMOTE_FIELDS = {"himalayas": _himalayas_fields, "remotive": _remotive_fields, "remoteok": _remoteok_fields, "jobicy": _jobicy_fields}
#: Where the jobs of a payload are, and whether the payload itself may be their array.
REMOTE_ITEMS = {"himalayas": (("$.jobs",), False), "remotive": (("$.jobs",), False), "remoteok": ((), True), "jobicy": (("$.jobs", "$.data"), True)}


def _by_source(values: dict[str, Column]) -> Column:
    """The value of the row's source; of the only one, whatever the row says."""
    if len(values) == 1:
        return next(iter(values.values()))
    out = F
    for source, value in values.items():
        out = out.when(F.col("source") == source, value)
    return out


def _himalayas_pages(parsed: DataFrame, terms: Sequence[str], searched: bool, only: bool) -> DataFrame:
    """The pages of himalayas that count, and all of other sources: one aggregate over the pages of each fetch tells where its
    branches end and whether its search pages give any row."""
    body, search = F.col("payload"), F.col("branch") == "search"
    own = F.lit(True) if only else F.col("source") == "himalayas"
    size = F.coalesce(F.size(V.get(body, "$.jobs", "array<variant>")), F.lit(0))
    total = F.coalesce(V.get(body, "$.totalCount", "bigint"), F.lit(0))
    ends = F.when(search, (size <= 0) | ((total > 0) & (F.col("page_no") * fv.PAGE_SIZE >= total))).otherwise(~truthy(V.get(body, "$.nextCursor")))
    title = lambda job: F.lower(F.coalesce(V.get(job, "$.title"), F.lit("")))
    gives = F.exists(V.items(body, "$.jobs", whole=False), lambda job: _kept_title(title(job), terms))
    page, late = F.col("page_no"), F.lit((1 << 31) - 1)
    pages = parsed.filter(own & body.isNotNull()).groupBy(F.col("slug").alias("_fetch")).agg(
        F.min(F.when(search & ends, page)).alias("_last_search"), F.min(F.when((F.col("branch") == "browse") & ends, page)).alias("_last_browse"),
        F.min(F.when(search & gives, F.coalesce(page, late))).alias("_first_row"))
    found = F.lit(searched) & F.col("_first_row").isNotNull() & (F.col("_last_search").isNull() | (F.col("_first_row") <= F.col("_last_search")))
    within = lambda last: F.col(last).isNull() | (page <= F.col(last))
    counts = (search & found & within("_last_search")) | ((F.col("branch") == "browse") & ~found & within("_last_browse"))
    joined = parsed.join(pages, own & F.col("slug").eqNullSafe(F.col("_fetch")), "left")
    return joined.filter(~own | counts).drop("_fetch", "_last_search", "_last_browse", "_first_row")


def remote(payloads: DataFrame, ranks: dict[str, int | Column], terms: Sequence[str] = (), worldwide_only: bool = False, searched: bool = True,
           max_pages: int | None = None, search: str | None = None) -> DataFrame:
    """S6, S8 to S10 for the sources that `ranks` names: each body is parsed once to one table of jobs, whatever its source, and each field is
    taken by the source's rule. `searched` and `max_pages` are those of himalayas, `search` is that of remotive."""
    names = list(ranks)
    rows = payloads if len(names) == 1 else payloads.filter(F.col("source").isin(*names))
    own = F.lit(names == ["himalayas"]) if len(names) == 1 else F.col("source") == "himalayas"
    if max_pages is not None and "himalayas" in names:
        rows = rows.filter(~own | (F.col("page_no") <= max_pages))
    parsed = rows.withColumn("payload", F.try_parse_json("body")).drop("body")
    if "himalayas" in names:
        parsed = _himalayas_pages(parsed, terms, searched, len(names) == 1)
    def listed(source: str) -> Column:
        paths, whole = REMOTE_ITEMS[source]

        def job(value: Column) -> Column:
            fields = REMOTE_FIELDS[source](lambda path: value if path is None else V.get(value, path))
            return F.struct(*(column.alias(name) for name, column in fields.items()))

        return F.transform(V.items(F.col("payload"), *paths, whole=whole), job)

    # The fields are taken inside the array: outside it, filters on the title would repeat the rules of all sources.
    jobs = parsed.select("source", "branch", "ord", F.posexplode(_by_source({s: listed(s) for s in names})).alias("pos", "job"))
    # A search (given, or exactly one term) already matched title and text at remotive, so its terms are not tested again.
    skip = (F.lit(names == ["remotive"]) if len(names) == 1 else F.col("source") == "remotive") & F.lit(bool(search) or len(terms) == 1)
    title, place = F.col("job.title"), F.col("job.place")
    rows = jobs.filter(truthy(title) & ~P.senior_remote_title(title) & (skip | P.matches_role(title, terms)))
    if worldwide_only:
        # Of himalayas, only browse rows are tested, before the default is filled in.
        rows = rows.filter((own & (F.col("branch") == "search")) | P.worldwide(place))
    rank = _by_source({s: _rank(r) for s, r in ranks.items()}).alias("source_rank")
    label = F.col("source") if len(names) > 1 else F.lit(names[0])
    whole = rows.select("job.title", "job.company", "job.url", "job.location", "job.about", label.alias("source"),
                        U.two_part_order(F.col("ord"), F.col("pos")).alias("ord"), rank)
    return _ordered(with_text(whole, "description", F.col("about")))


def himalayas(payloads: DataFrame, terms: Sequence[str] = (), worldwide_only: bool = False, searched: bool = True,
              max_pages: int | None = None, source_rank: int | Column = 0) -> DataFrame:
    """Of each fetch, the search pages if they give any row, else the browse pages. `slug` tells the
    fetches of a payload table apart. Pages after the one that ends a fetch's branch (empty, or reaching the
    total) do not count; a malformed body loses its own page only. Only browse rows are tested for a worldwide
    location, before the default is filled in. With `max_pages` later pages do not count (L5)."""
    return remote(payloads, {"himalayas": source_rank}, terms, worldwide_only, searched, max_pages)


def read_rss(spark, path: str) -> DataFrame:
    """Feed items of landed RSS files, ordered by file and position."""
    items = spark.read.format("xml").option("rowTag", "item").schema(schemas.RSS_ITEM).load(path)
    return items.withColumn("ord", F.monotonically_increasing_id())


def weworkremotely(items: DataFrame, terms: Sequence[str] = (), source_rank: int | Column = 0) -> DataFrame:
    """S7, P12: 'Company: Title' items; the title keeps its case and no worldwide test applies."""
    parts = split_feed_title(strip_blank(F.coalesce("title", F.lit(""))))
    # As a generator's output the parts are columns of their own: filters do not repeat the rule that made them.
    rows = items.select("*", F.explode(F.array(parts)).alias("parts")).withColumn("company", F.col("parts.company"))
    kept = rows.withColumn("title", F.col("parts.title")).filter(_kept_title(F.col("title"), terms))
    return _ordered(with_text(kept, "description", F.col("description")).select(
        "title", "company", first_truthy(F.col("link"), F.col("guid"), default="").alias("url"), "description",
        first_truthy(F.col("region"), default="Remote").alias("location"),
        F.lit("weworkremotely").alias("source"), "ord", _rank(source_rank)))


def remotive(payloads: DataFrame, terms: Sequence[str] = (), worldwide_only: bool = False, search: str | None = None,
             source_rank: int | Column = 0) -> DataFrame:
    """Only object payloads. A search (given, or exactly one term) already matched title and text
    at the board, so the title terms are not tested again."""
    return remote(payloads, {"remotive": source_rank}, terms, worldwide_only, search=search)


def remoteok(payloads: DataFrame, terms: Sequence[str] = (), worldwide_only: bool = False, source_rank: int | Column = 0) -> DataFrame:
    """Only array payloads; entries without a position (the legal notice) are dropped."""
    return remote(payloads, {"remoteok": source_rank}, terms, worldwide_only)


def jobicy(payloads: DataFrame, terms: Sequence[str] = (), worldwide_only: bool = False, source_rank: int | Column = 0) -> DataFrame:
    """Array payload, or `jobs` or `data` of an object; several names per field."""
    return remote(payloads, {"jobicy": source_rank}, terms, worldwide_only)
