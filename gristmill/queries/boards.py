"""Board payloads and detail records, composed row by row from the driver tables."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill import fixed_values as fv
from gristmill.operators import roles as R
from gristmill.operators.dedup import dedup_by_url
from gristmill.operators.limits import union_sources
from gristmill.plans import fetch as FT
from gristmill.queries import query, table
from gristmill.session import spread
from gristmill.sources import boards as B
from gristmill.sources import details as D
from gristmill.sources import files as FL

TERMS = ["anvil", "bolt", "ring"]
TERMS_SQL = "anvil|bolt|ring"
BOARD_SENIOR, REMOTE_SENIOR = "|".join(fv.BOARD_SENIOR_WORDS), "|".join(fv.REMOTE_SENIOR_WORDS)

# One payload per part: a job array of one or two jobs, the second one senior or role-less.
TITLE = "CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 4 = 0 THEN 'Lead ' || p_name ELSE upper(p_name) END"


def _payloads(part, source, body, where="true"):
    return part.filter(where).selectExpr(
        f"'{source}' AS source", "p_brand AS slug", "'search' AS branch", "1 AS page_no", f"{body} AS body", "p_partkey AS ord")


def _board_body(second, wrapper):
    return f"""'{{"jobs": [{{"id": ' || p_partkey || ', "title": "' || {TITLE} || '"{second}}}]}}'""" if wrapper else \
        f"""'[{{"id": ' || p_partkey || ', "title": "' || {TITLE} || '"{second}}}]'"""


def _picked(df):
    return df.select("title", "company", "url", "description", "location", "source", F.col("ord").cast("bigint").alias("ord"))


def _board_sql(url, description, location, source):
    return f"""SELECT title, company, url, description, location, source, ord * 4294967296 AS ord FROM (
  SELECT lower({TITLE}) AS title, p_brand AS company, {url} AS url, {description} AS description, {location} AS location,
  '{source}' AS source, p_partkey AS ord FROM part) WHERE NOT regexp_matches(title, '{BOARD_SENIOR}') AND regexp_matches(title, '{TERMS_SQL}')"""


GREENHOUSE_BODY = _board_body("""' || CASE WHEN p_partkey % 3 = 0 THEN ', "jobUrl": "http://g/' || p_partkey || '"' ELSE '' END ||
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ', "location": {"name": "' || p_type || '"}' END || '""", True)


@query(_board_sql("CASE WHEN p_partkey % 3 = 0 THEN 'http://g/' || p_partkey ELSE 'https://boards.greenhouse.io/' || p_brand || '/jobs/' || p_partkey END",
                  "CASE WHEN p_size % 2 = 0 THEN '<p>' || p_type || '</p>' ELSE '' END",
                  "CASE WHEN p_partkey % 5 = 0 THEN 'Unknown' ELSE p_type END", "greenhouse"))
def greenhouse_list(spark, folder):
    """List rows with the raw content of the detail record."""
    part = table(spark, folder, "part")
    details = part.filter("p_size % 2 = 0").selectExpr(
        "'greenhouse' AS board", "p_brand AS slug", "CAST(p_partkey AS STRING) AS job_id",
        """'{"content": "<p>' || p_type || '</p>"}' AS body""")
    return _picked(B.greenhouse(_payloads(part, "greenhouse", GREENHOUSE_BODY), details, TERMS))


LEVER_FIELDS = """, "hostedUrl": ' || CASE WHEN p_partkey % 3 = 0 THEN 'null' WHEN p_partkey % 3 = 1 THEN '""' ELSE '"http://l/' || p_partkey || '"' END ||
  ', "description": "<b>' || p_type || '</b>"' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ', "categories": {"location": "' || p_type || '"}' END || '"""
LEVER_BODY = f"CASE WHEN p_partkey % 2 = 0 THEN {_board_body(LEVER_FIELDS, True)} ELSE {_board_body(LEVER_FIELDS, False)} END"


@query(_board_sql("CASE WHEN p_partkey % 3 = 2 THEN 'http://l/' || p_partkey ELSE 'https://jobs.lever.co/' || p_brand || '/' || p_partkey END",
                  "'<b>' || p_type || '</b>'", "CASE WHEN p_partkey % 5 = 0 THEN 'Unknown' ELSE p_type END", "lever"))
def lever_list(spark, folder):
    """Payload is a list or an object."""
    return _picked(B.lever(_payloads(table(spark, folder, "part"), "lever", LEVER_BODY), TERMS))


ASHBY_FIELDS = """, "jobUrl": "' || CASE WHEN p_partkey % 3 = 2 THEN 'http://a/' || p_partkey ELSE '' END || '", "descriptionPlain": "' ||
  CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_type END || '", "description": "alt ' || p_size || '", "location": ' ||
  CASE p_partkey % 4 WHEN 0 THEN 'null' WHEN 1 THEN '"' || p_type || '"' WHEN 2 THEN '{"name": "x"}' ELSE '["y"]' END || '"""
ASHBY_BODY = f"CASE WHEN p_partkey % 2 = 0 THEN {_board_body(ASHBY_FIELDS, True)} ELSE {_board_body(ASHBY_FIELDS, False)} END"


@query(_board_sql("CASE WHEN p_partkey % 3 = 2 THEN 'http://a/' || p_partkey ELSE 'https://boards.ashbyhq.com/' || p_brand || '/' || p_partkey END",
                  "CASE WHEN p_partkey % 2 = 0 THEN 'alt ' || p_size ELSE p_type END",
                  "CASE WHEN p_partkey % 4 = 1 THEN p_type ELSE 'Unknown' END", "ashby"))
def ashby_list(spark, folder):
    """Only a string is a location."""
    return _picked(B.ashby(_payloads(table(spark, folder, "part"), "ashby", ASHBY_BODY), TERMS))


def _remote_sql(title, company, url, location, source, extra="true", shift=True):
    return f"""SELECT title, company, url, description, location, source, ord FROM (
  SELECT {title} AS title, {company} AS company, {url} AS url, 'About ' || p_type || ' & more' AS description, {location} AS location,
  '{source}' AS source, p_partkey{' * 4294967296' if shift else ''} AS ord, p_partkey, p_type, p_size FROM part)
  WHERE title <> '' AND NOT regexp_matches(lower(title), '{REMOTE_SENIOR}') AND regexp_matches(lower(title), '{TERMS_SQL}') AND {extra}"""


DESCRIPTION = "<p>About <b>' || p_type || '</b> &amp; more</p>"
HIMALAYAS_BODY = f"""'{{"totalCount": 0, "nextCursor": "c", "jobs": [{{"title": "' || {TITLE} || '", "companyName": "' ||
  CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END || '", "companySlug": "' || CASE WHEN p_size % 6 = 0 THEN '' ELSE 'slug' END ||
  '", "applicationLink": "' || CASE WHEN p_size % 2 = 0 THEN '' ELSE 'http://h/' || p_partkey END || '", "guid": "g' || p_partkey ||
  '", "description": "{DESCRIPTION}", "locationRestrictions": ' || CASE p_size % 4 WHEN 0 THEN '[]' WHEN 1 THEN '["' || p_type || '", "Worldwide"]'
  WHEN 2 THEN 'null' ELSE '["' || p_type || '"]' END || '}}]}}'"""
HIMALAYAS_COMPANY = "CASE WHEN p_size % 3 <> 0 THEN p_brand WHEN p_size % 6 <> 0 THEN 'slug' ELSE 'Unknown' END"
HIMALAYAS_URL = "CASE WHEN p_size % 2 = 0 THEN 'g' || p_partkey ELSE 'http://h/' || p_partkey END"
HIMALAYAS_PLACE = "CASE p_size % 4 WHEN 1 THEN p_type || ', Worldwide' WHEN 3 THEN p_type ELSE 'Remote' END"


@query(_remote_sql(f"lower({TITLE})", HIMALAYAS_COMPANY, HIMALAYAS_URL, HIMALAYAS_PLACE, "himalayas"))
def himalayas_search(spark, folder):
    """One fetch's search pages, whose worldwide test is the board's; they match, so browse pages do not count."""
    part = table(spark, folder, "part")
    search = _payloads(part, "himalayas", HIMALAYAS_BODY).withColumn("slug", F.lit("one fetch"))
    browse = _payloads(part, "himalayas", """'{"jobs": [{"title": "' || p_name || '"}], "nextCursor": "c"}'""").withColumns(
        {"branch": F.lit("browse"), "slug": F.lit("one fetch")})
    return _picked(B.himalayas(search.unionByName(browse), TERMS, worldwide_only=True))


@query(f"""WITH pages AS (SELECT *, p_partkey % 7 + 1 AS page_no, p_partkey % 13 = 0 AS broken, p_partkey % 29 = 0 AS nothing FROM part),
ends AS (SELECT p_brand, min(page_no) AS last_page FROM pages WHERE nothing AND NOT broken GROUP BY p_brand)
SELECT p_brand AS company, CAST(p_partkey AS VARCHAR) AS url, lower(p_name) AS title FROM pages LEFT JOIN ends USING (p_brand)
WHERE NOT broken AND NOT nothing AND page_no <= {fv.PAGE_CAP} AND page_no <= coalesce(last_page, page_no)
  AND NOT regexp_matches(lower(p_name), '{REMOTE_SENIOR}')""")
def himalayas_pages(spark, folder):
    """A fetch per brand with pages 1 to 7, of which five count; broken pages, and empty ones that end their own fetch."""
    pages = table(spark, folder, "part").selectExpr(
        "'himalayas' AS source", "p_brand AS slug", "'search' AS branch", "CAST(p_partkey % 7 + 1 AS INT) AS page_no",
        """CASE WHEN p_partkey % 13 = 0 THEN 'broken' WHEN p_partkey % 29 = 0 THEN '{"jobs": []}' ELSE '{"jobs": [{"title": "' || p_name ||
        '", "companyName": "' || p_brand || '", "guid": "' || p_partkey || '"}]}' END AS body""", "p_partkey AS ord")
    return B.himalayas(pages, max_pages=fv.PAGE_CAP).select("company", "url", "title")


@query(_remote_sql(f"lower({TITLE})", HIMALAYAS_COMPANY, HIMALAYAS_URL, HIMALAYAS_PLACE, "himalayas",
                   "NOT (p_size % 4 = 3)"))
def himalayas_browse(spark, folder):
    """Search pages without a match, so the browse pages count and are tested for worldwide."""
    part = table(spark, folder, "part")
    search = _payloads(part, "himalayas", """'{"jobs": [{"title": "Director of ' || p_name || '"}]}'""")
    browse = _payloads(part, "himalayas", HIMALAYAS_BODY).withColumn("branch", F.lit("browse"))
    return _picked(B.himalayas(search.unionByName(browse), TERMS, worldwide_only=True))


@query(_remote_sql(f"CASE WHEN p_partkey % 3 = 1 THEN 'x: ' || {TITLE} ELSE {TITLE} END",
                   "CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE CASE WHEN p_partkey % 3 = 1 THEN 'Co' ELSE 'Unknown' END END",
                   "CASE WHEN p_size % 2 = 0 THEN 'g' || p_partkey ELSE 'http://w/' || p_partkey END",
                   "CASE WHEN p_size % 3 = 0 THEN 'Remote' ELSE p_type END", "weworkremotely", shift=False)
       .replace("title <> ''", "p_partkey % 11 <> 0"))
def weworkremotely_feed(spark, folder):
    """Feed items; the title splits at the first ': '."""
    items = table(spark, folder, "part").selectExpr(
        f"CASE p_partkey % 3 WHEN 0 THEN '  ' || p_brand || ': ' || {TITLE} WHEN 1 THEN 'Co: x: ' || {TITLE} ELSE {TITLE} END AS title",
        "CASE WHEN p_size % 2 = 0 THEN NULL ELSE 'http://w/' || p_partkey END AS link", "'g' || p_partkey AS guid",
        f"'{DESCRIPTION}' AS description", "CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS region", "p_partkey AS ord")
    return _picked(B.weworkremotely(items, TERMS))


REMOTIVE_BODY = f"""'{{"jobs": [{{"title": " ' || {TITLE} || ' ", "company_name": "' || CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END ||
  '", "url": "http://r/' || p_partkey || '", "description": "{DESCRIPTION}", "candidate_required_location": "' ||
  CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'Anywhere' ELSE p_type END || '"}}]}}'"""
REMOTIVE = (f"trim({TITLE})", "CASE WHEN p_size % 3 = 0 THEN 'Unknown' ELSE p_brand END", "'http://r/' || p_partkey",
            "CASE p_size % 3 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Anywhere' ELSE p_type END", "remotive", "p_size % 3 <> 2")


@query(_remote_sql(*REMOTIVE))
def remotive_list(spark, folder):
    """Several terms, so titles are tested here."""
    return _picked(B.remotive(_payloads(table(spark, folder, "part"), "remotive", REMOTIVE_BODY), TERMS, worldwide_only=True))


@query(_remote_sql(*REMOTIVE).replace(f"regexp_matches(lower(title), '{TERMS_SQL}')", "true"))
def remotive_search(spark, folder):
    """One term was searched at the board, so titles are not tested again."""
    return _picked(B.remotive(_payloads(table(spark, folder, "part"), "remotive", REMOTIVE_BODY), ["anvil"], worldwide_only=True))


REMOTEOK_BODY = f"""'[{{"legal": "notice"}}, {{"position": "' || {TITLE} || '", "company": "' || p_brand || '", "slug": "s' || p_partkey ||
  '", "url": "' || CASE p_size % 3 WHEN 0 THEN '/x' || p_partkey WHEN 1 THEN '' ELSE 'http://o/' || p_partkey END ||
  '", "description": "{DESCRIPTION}", "location": "' || CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END || '"}}]'"""


@query(_remote_sql(TITLE, "p_brand", """CASE p_size % 3 WHEN 0 THEN 'https://remoteok.com/x' || p_partkey
  WHEN 1 THEN 'https://remoteok.com/remote-jobs/s' || p_partkey ELSE 'http://o/' || p_partkey END""",
                   "CASE WHEN p_size % 2 = 0 THEN 'Remote' ELSE p_type END", "remoteok").replace("4294967296 AS ord", "4294967296 + 1 AS ord"))
def remoteok_list(spark, folder):
    """The notice has no position; three url forms."""
    return _picked(B.remoteok(_payloads(table(spark, folder, "part"), "remoteok", REMOTEOK_BODY), TERMS))


JOBICY_JOB = f"""{{"' || CASE WHEN p_size % 2 = 0 THEN 'jobTitle' ELSE 'title' END || '": "' || {TITLE} || '", "' ||
  CASE WHEN p_size % 2 = 0 THEN 'companyName' ELSE 'company' END || '": "' || p_brand || '", "jobGeo": ' ||
  CASE p_size % 3 WHEN 0 THEN '""' WHEN 1 THEN '["' || p_type || '", "Global"]' ELSE '"' || p_type || '"' END ||
  ', "location": "L' || p_size || '", "link": "http://j/' || p_partkey || '", "jobExcerpt": "{DESCRIPTION}"}}"""
JOBICY_BODY = f"""CASE p_partkey % 3 WHEN 0 THEN '[17, {JOBICY_JOB}]' WHEN 1 THEN '{{"jobs": [17, {JOBICY_JOB}]}}'
  ELSE '{{"jobs": [], "data": [17, {JOBICY_JOB}]}}' END"""


@query(_remote_sql(TITLE, "p_brand", "'http://j/' || p_partkey",
                   "CASE p_size % 3 WHEN 0 THEN 'L' || p_size WHEN 1 THEN p_type || ', Global' ELSE p_type END", "jobicy")
       .replace("4294967296 AS ord", "4294967296 + 1 AS ord"))
def jobicy_list(spark, folder):
    """Three wrappers, alternative field names, list locations."""
    return _picked(B.jobicy(_payloads(table(spark, folder, "part"), "jobicy", JOBICY_BODY), TERMS))


def _remote_inputs(spark, folder):
    part = spread(table(spark, folder, "part"), "p_partkey")
    bodies = {"himalayas": HIMALAYAS_BODY, "remotive": REMOTIVE_BODY, "remoteok": REMOTEOK_BODY, "jobicy": JOBICY_BODY}
    landed = F.inline(F.array(*[F.struct(F.lit(s).alias("source"), F.expr(sql).alias("body")) for s, sql in bodies.items()]))
    payloads = part.select(landed, F.col("p_brand").alias("slug"), F.lit("search").alias("branch"), F.lit(1).alias("page_no"), F.col("p_partkey").alias("ord"))
    # Feed links repeat those of another board, so the union has urls in common.
    items = part.selectExpr("p_name AS title", "'http://r/' || p_partkey AS link", "NULL AS guid", f"'{DESCRIPTION}' AS description",
                            "'' AS region", "p_partkey AS ord")
    return payloads, items


@query(f"""WITH rows AS (
  SELECT 0 AS r, * FROM ({_remote_sql(f"lower({TITLE})", HIMALAYAS_COMPANY, HIMALAYAS_URL, HIMALAYAS_PLACE, "himalayas")})
  UNION ALL SELECT 1, * FROM ({_remote_sql("p_name", "'Unknown'", "'http://r/' || p_partkey", "'Remote'", "weworkremotely", shift=False)})
  UNION ALL SELECT 2, * FROM ({_remote_sql(*REMOTIVE[:5])})
  UNION ALL SELECT 3, * FROM ({_remote_sql(TITLE, "p_brand", '''CASE p_size % 3 WHEN 0 THEN 'https://remoteok.com/x' || p_partkey
  WHEN 1 THEN 'https://remoteok.com/remote-jobs/s' || p_partkey ELSE 'http://o/' || p_partkey END''',
  "CASE WHEN p_size % 2 = 0 THEN 'Remote' ELSE p_type END", "remoteok")})
  UNION ALL SELECT 4, * FROM ({_remote_sql(TITLE, "p_brand", "'http://j/' || p_partkey",
  "CASE p_size % 3 WHEN 0 THEN 'L' || p_size WHEN 1 THEN p_type || ', Global' ELSE p_type END", "jobicy")}))
SELECT source, title, company, url, location FROM rows QUALIFY row_number() OVER (PARTITION BY url ORDER BY r, ord) = 1""")
def remote_union(spark, folder):
    """Five remote boards, first row per url."""
    synonyms = {"tools": TERMS}
    payloads, items = _remote_inputs(spark, folder)
    terms = R.terms_of(spark, "Tools", synonyms)
    ranks = {"himalayas": 0, "remotive": 2, "remoteok": 3, "jobicy": 4}
    rows = union_sources(B.remote(payloads, ranks, terms), B.weworkremotely(items, terms, 1))
    return dedup_by_url(rows).select("source", "title", "company", "url", "location")


@query(f"""WITH roster AS (SELECT 'Brand#' || s_suppkey AS slug, CAST(s_suppkey AS INTEGER) AS ord, CASE s_suppkey % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'ashby' END AS ats
  FROM supplier),
rows AS (SELECT ats AS source, slug AS company, lower({TITLE}) AS title, r.ord AS roster_ord, p_partkey,
  CASE WHEN ats = 'greenhouse' AND p_size % 2 = 0 THEN '<p>' || p_type || '</p>' WHEN ats = 'greenhouse' THEN '' END AS content FROM part JOIN roster r ON p_brand = slug
  WHERE p_partkey % 3 = CASE ats WHEN 'greenhouse' THEN 0 WHEN 'lever' THEN 1 ELSE 2 END)
SELECT source, company, title, p_partkey, content, roster_ord, CAST(row_number() OVER (PARTITION BY roster_ord ORDER BY p_partkey) AS INTEGER) AS place
  FROM rows WHERE NOT regexp_matches(title, '{BOARD_SENIOR}') AND contains(title, 'ring')""")
def role_board_union(spark, folder):
    """Company boards in roster order, each from the board detected for it, for a role that is its own only term, with the detail
    records of greenhouse; companies with and without a slug. `place` is the place within a company."""
    part, supplier = table(spark, folder, "part"), table(spark, folder, "supplier")
    roster = R.with_slugs(supplier.selectExpr("'Brand#' || s_suppkey AS name", "CASE WHEN s_suppkey % 2 = 0 THEN 'Brand#' || s_suppkey END AS slug", "CAST(s_suppkey AS INT) AS ord"))
    detected = supplier.selectExpr(
        "'Brand#' || s_suppkey AS slug", "CASE s_suppkey % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'ashby' END AS ats")
    payloads = _payloads(part, "greenhouse", GREENHOUSE_BODY, "p_partkey % 3 = 0").unionByName(
        _payloads(part, "lever", LEVER_BODY, "p_partkey % 3 = 1")).unionByName(_payloads(part, "ashby", ASHBY_BODY, "p_partkey % 3 = 2"))
    details = part.filter("p_size % 2 = 0").selectExpr(
        "'greenhouse' AS board", "p_brand AS slug", "CAST(p_partkey AS STRING) AS job_id", """'{"content": "<p>' || p_type || '</p>"}' AS body""")
    rows = FT.board_postings(payloads, details.unionByName(details), roster, detected, role="Ring")
    ident = F.regexp_extract("url", r"(\d+)$", 1).cast("bigint")
    place = F.row_number().over(Window.partitionBy("source_rank").orderBy("ord"))
    return rows.select("source", "company", "title", ident.alias("p_partkey"), F.when(F.col("source") == "greenhouse", F.col("description")).alias("content"),
                       F.col("source_rank").alias("roster_ord"), place.alias("place"))


# Detail records of orders; the posting url names the board, the company and the id.
DETAIL_URL = """CASE o_orderkey % 5 WHEN 0 THEN 'https://boards.greenhouse.io/' || c_mktsegment || '/jobs/' || o_orderkey
  WHEN 1 THEN 'https://jobs.lever.co/' || c_mktsegment || '/L' || o_orderkey WHEN 2 THEN 'https://jobs.smartrecruiters.com/' || c_mktsegment || '/' || o_orderkey || '-title'
  WHEN 3 THEN 'https://careers.celonis.com/job-detail?jobId=' || o_orderkey ELSE 'https://boards.greenhouse.io/' || c_mktsegment || '/jobs/none' END"""
DETAIL_BOARD = "CASE o_orderkey % 5 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'smartrecruiters' WHEN 3 THEN 'careers' END"
DETAIL_SLUG = "CASE WHEN o_orderkey % 5 = 3 THEN 'Celonis' ELSE c_mktsegment END"
DETAIL_ID = "CASE WHEN o_orderkey % 5 = 1 THEN 'L' ELSE '' END || o_orderkey"
DETAIL_BODY = """CASE o_orderkey % 5
  WHEN 0 THEN '{"title": "' || c_name || '", "content": "' || CASE WHEN o_custkey % 4 = 0 THEN '' ELSE '&lt;p&gt;Order&lt;/p&gt;  <b>' || o_orderpriority || '</b>' END ||
    '", "location": {"name": "' || o_orderstatus || '"}}'
  WHEN 1 THEN '{"title": "' || c_name || '", "descriptionBodyPlain": "", "descriptionPlain": "' || CASE WHEN o_custkey % 4 = 0 THEN '' ELSE 'Order  ' || o_orderpriority END ||
    '", "categories": {"location": "' || o_orderstatus || '"}}'
  WHEN 2 THEN '{"name": "' || c_name || '", "jobAd": {"sections": ' || CASE WHEN o_custkey % 4 = 0 THEN '[]' WHEN o_custkey % 4 = 1 THEN
    '{"a": {"text": "<p>Order</p>"}, "b": {"text": "' || o_orderpriority || '"}}' ELSE '[{"text": "Order"}, 5, {"text": "<i>' || o_orderpriority || '</i>"}]' END ||
    '}, "location": {"city": "' || o_orderstatus || '"}}'
  WHEN 3 THEN '{"title": "' || c_name || '", "description": "' || CASE WHEN o_custkey % 4 = 0 THEN '' ELSE 'Order <br/> ' || o_orderpriority END ||
    '", "groupedLocation": "", "location": "' || o_orderstatus || '"}' END"""
DETAIL_ROWS = "orders JOIN customer ON o_custkey = c_custkey"


@query(f"""SELECT {DETAIL_URL} AS url, c_name AS title, {DETAIL_SLUG} AS company, 'Order ' || o_orderpriority AS description, o_orderstatus AS location,
  CASE WHEN o_orderkey % 5 = 3 THEN 'careers-api' ELSE {DETAIL_BOARD} END AS source FROM {DETAIL_ROWS} WHERE o_orderkey % 5 < 4 AND o_custkey % 4 > 0""")
def detail_lookup(spark, folder):
    """Postings found by url in detail records."""
    rows = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    urls = D.requested(rows.selectExpr(f"{DETAIL_URL} AS url"))
    details = rows.filter("o_orderkey % 5 < 4").selectExpr(
        f"{DETAIL_BOARD} AS board", f"{DETAIL_SLUG} AS slug", f"{DETAIL_ID} AS job_id", f"{DETAIL_BODY} AS body")
    found = D.greenhouse(urls, details).unionByName(D.lever(urls, details)).unionByName(
        D.smartrecruiters(urls, details)).unionByName(D.careers(urls, details))
    return found.select("posting.*")


@query("""WITH rows AS (SELECT replace(p_brand, '#', '') AS slug, 'id' || p_size AS id, p_name, p_partkey FROM part),
wanted AS (SELECT DISTINCT slug, id FROM rows)
SELECT 'https://jobs.ashbyhq.com/' || w.slug || '/' || w.id AS url, arg_min(p_name, p_partkey) AS title, w.slug AS company
FROM wanted w JOIN rows r ON r.slug = w.slug AND contains('http://a/' || r.slug || '/' || r.id, w.id) GROUP BY w.slug, w.id""")
def ashby_by_containment(spark, folder):
    """The first board row whose link contains the id, so 'id1' also matches 'id12'."""
    part = table(spark, folder, "part").withColumn("slug", F.expr("replace(p_brand, '#', '')"))
    urls = D.requested(part.selectExpr("'https://jobs.ashbyhq.com/' || slug || '/id' || p_size AS url"))
    payloads = part.select("slug", F.to_json(F.struct(F.array(F.struct(
        F.col("p_name").alias("title"), F.expr("'http://a/' || slug || '/id' || p_size").alias("jobUrl"))).alias("jobs"))).alias("body"),
        F.col("p_partkey").alias("ord"))
    return D.ashby(urls, payloads).select("posting.url", "posting.title", "posting.company")


@query("""SELECT CASE WHEN hit THEN 'doc ' || conv_id ELSE 'm' || conv_id || '/' || turn END AS title,
  CASE WHEN hit THEN 'doc' ELSE 'manual' END AS source, md5(CASE WHEN hit THEN d.text ELSE regexp_replace(c.text, '^\\s+|\\s+$', '', 'g') END) AS digest,
  conv_id * 1000 + turn AS ord
FROM (SELECT c.*, turn % 2 = 0 AND EXISTS (SELECT 1 FROM documents WHERE doc_id = conv_id AND length(text) > 100) AS hit FROM conversations c) c
LEFT JOIN documents d ON d.doc_id = conv_id""")
def manual_entries(spark, folder):
    """Typed rows, or the scraped posting of a link when it is long enough."""
    entries = table(spark, folder, "conversations").selectExpr(
        "'m' || conv_id || '/' || turn AS title", "role AS company", "'  ' || text || '  ' AS description",
        "'http://u/' || conv_id AS url", "conv_id * 1000 + turn AS ord",
        "CASE WHEN turn % 2 = 0 THEN ' http://s/' || conv_id || ' ' ELSE '' END AS input")
    scraped = table(spark, folder, "documents").selectExpr(
        "'http://s/' || doc_id AS url", "'doc ' || doc_id AS title", "source AS company", "text AS description", "lang AS location",
        "'doc' AS source")
    return FL.manual_postings(entries, scraped).select("title", "source", F.md5("description").alias("digest"), "ord")


@query(f"""SELECT 'm' || conv_id || '/' || turn AS title, md5(left(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), {fv.MANUAL_DESCRIPTION})) AS digest
  FROM conversations""")
def manual_bulk(spark, folder):
    """S20, bulk form: descriptions cut to 1500 characters."""
    entries = table(spark, folder, "conversations").selectExpr(
        "'m' || conv_id || '/' || turn AS title", "role AS company", "'  ' || text || '  ' AS description", "'' AS url")
    return FL.bulk_manual_postings(entries).select("title", F.md5("description").alias("digest"))
