"""Filters, deduplication, roles, unions and caps."""

from pyspark.sql import functions as F

from gristmill import fixed_values as fv
from gristmill.functions import predicates as P
from gristmill.functions import urls as U
from gristmill.functions.text import first_truthy
from gristmill.operators import dedup as DD
from gristmill.operators import limits as L
from gristmill.operators import roles as R
from gristmill.queries import query, table

BOARD_SENIOR, REMOTE_SENIOR = "|".join(fv.BOARD_SENIOR_WORDS), "|".join(fv.REMOTE_SENIOR_WORDS)

# Titles composed from part columns, the same way on both sides.
TITLE = """CASE p_partkey % 9 WHEN 0 THEN 'Senior ' || p_name WHEN 1 THEN 'Leading ' || p_name WHEN 2 THEN 'Principal ' || p_name
  WHEN 3 THEN 'Head of ' || p_name WHEN 4 THEN '' WHEN 5 THEN p_name || ' Manager' WHEN 6 THEN NULL ELSE p_name END"""


@query(f"""SELECT p_partkey, regexp_matches(t, '{BOARD_SENIOR}') AS senior_board, regexp_matches(t, '{REMOTE_SENIOR}') AS senior_remote,
  t <> '' AS has_title FROM (SELECT p_partkey, lower(coalesce({TITLE}, '')) AS t FROM part)""")
def senior_title_filter(spark, folder):
    """F1, F2, F5."""
    rows = table(spark, folder, "part").select("p_partkey", F.expr(TITLE).alias("title"))
    return rows.select("p_partkey", P.senior_board_title(F.col("title")).alias("senior_board"),
                       P.senior_remote_title(F.col("title")).alias("senior_remote"),
                       (F.coalesce("title", F.lit("")) != "").alias("has_title"))


LOCATION = """CASE c_custkey % 6 WHEN 0 THEN 'Worldwide' WHEN 1 THEN n_name WHEN 2 THEN '' WHEN 3 THEN NULL
  WHEN 4 THEN n_name || ' (Remote)' ELSE 'GLOBAL, ' || r_name END"""


@query(f"""SELECT c_custkey, coalesce(loc, '') = '' OR regexp_matches(lower(loc), 'worldwide|anywhere|global|remote') AS worldwide
  FROM (SELECT c_custkey, {LOCATION} AS loc FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey)""")
def worldwide_filter(spark, folder):
    """F4."""
    rows = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("c_custkey", P.worldwide(F.expr(LOCATION)).alias("worldwide"))


# Synonyms: a part type stands for the first words of its part names; every third row asks for an unknown role.
ROLE = "CASE p_partkey % 3 WHEN 0 THEN p_brand || '/x' WHEN 1 THEN '  ' || p_type || ' ' ELSE CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END END"


@query(f"""WITH syn AS (SELECT lower(p_type) AS role_key, list(DISTINCT lower(split_part(p_name, ' ', 1))) AS terms
  FROM part GROUP BY 1),
rows AS (SELECT p_partkey, p_name, {ROLE} AS role FROM part),
expanded AS (SELECT p_partkey, p_name, CASE WHEN terms IS NOT NULL THEN terms WHEN role = '' THEN []::VARCHAR[] ELSE [lower(role)] END AS terms
  FROM rows LEFT JOIN syn ON role_key = replace(replace(trim(lower(role)), ' ', '_'), '/', '_'))
SELECT p_partkey, CAST(len(terms) AS INTEGER) AS n_terms,
  len(terms) = 0 OR len(list_filter(terms, lambda x: contains(lower(p_name), x))) > 0 AS matched FROM expanded""")
def role_match(spark, folder):
    """D1, F3 with roles that differ by row."""
    part = table(spark, folder, "part")
    synonyms = part.select(
        F.lower("p_type").alias("role_key"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("term")).distinct().withColumn(
        "ord", F.lit(0))
    rows = R.expand_roles(part.select("p_partkey", "p_name", F.expr(ROLE).alias("role")), "role", synonyms)
    return rows.select("p_partkey", F.size("terms").alias("n_terms"),
                       P.matches_role_terms(F.col("p_name"), F.col("terms")).alias("matched"))


@query("""SELECT p_partkey, p_name FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS p_name, p_brand FROM part)
  QUALIFY row_number() OVER (PARTITION BY lower(p_name), lower(p_brand) ORDER BY p_partkey) = 1""")
def dedup_by_posting(spark, folder):
    """W2."""
    rows = table(spark, folder, "part").select(
        "p_partkey", F.expr("CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END").alias("p_name"), "p_brand")
    return DD.dedup_by_posting(rows, "p_name", "p_brand", "p_partkey").select("p_partkey", "p_name")


PAGE_URL = """CASE WHEN page_id % 7 = 0 THEN '' WHEN page_id % 5 = 0 THEN '  http://' || split_part(url, '/', 3)
  ELSE 'http://' || split_part(url, '/', 3) END"""
PAGE_RANK = "CAST(page_id % 3 AS INT)"


@query(f"""SELECT page_id, url FROM (SELECT page_id, url, row_number() OVER (PARTITION BY trim(url) ORDER BY r, page_id) AS rn
  FROM (SELECT page_id, {PAGE_URL} AS url, {PAGE_RANK} AS r FROM pages)) WHERE rn = 1 OR trim(url) = ''""")
def dedup_by_url(spark, folder):
    """W1 over pages, whose urls repeat and are sometimes empty."""
    rows = table(spark, folder, "pages").select(
        "page_id", F.expr(PAGE_URL).alias("url"), F.expr(PAGE_RANK).alias("source_rank"), F.col("page_id").alias("ord"))
    return DD.dedup_by_url(rows).select("page_id", "url")


@query("""SELECT doc_id, md5(text) AS digest FROM documents
  QUALIFY row_number() OVER (PARTITION BY trim(text, ' ' || chr(10) || chr(9) || chr(13)) ORDER BY source, doc_id) = 1""")
def dedup_by_text(spark, folder):
    """W1 with the whole text as key: groups of copies keep their first."""
    rows = table(spark, folder, "documents").select("doc_id", "text", "source")
    return DD.dedup_by_url(rows, "text", "source", "doc_id").select("doc_id", F.md5("text").alias("digest"))


# Three tables as three ordered sources.
SOURCES_SQL = """SELECT 'customer' AS source, 0 AS source_rank, c_custkey AS ord, c_name AS title, 'u/' || (c_custkey % 97) AS url FROM customer
  UNION ALL SELECT 'supplier', 1, s_suppkey, s_name, 'u/' || s_suppkey FROM supplier
  UNION ALL SELECT 'part', 2, p_partkey, p_name, 'u/' || (p_partkey % 501) FROM part"""


def _sources(spark, folder):
    def source(name, rank, key, title, url):
        return table(spark, folder, name).select(
            F.lit(name).alias("source"), F.lit(rank).alias("source_rank"), F.col(key).alias("ord"), F.col(title).alias("title"),
            F.expr(f"'u/' || {url}").alias("url"))

    return L.union_sources(source("customer", 0, "c_custkey", "c_name", "(c_custkey % 97)"),
                           source("supplier", 1, "s_suppkey", "s_name", "s_suppkey"),
                           source("part", 2, "p_partkey", "p_name", "(p_partkey % 501)"))


@query(f"""WITH s AS ({SOURCES_SQL}), d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY url ORDER BY source_rank, ord) = 1)
SELECT source, ord, title, url FROM d ORDER BY source_rank, ord LIMIT {fv.REMOTE_CAP}""")
def union_limit(spark, folder):
    """Union, dedup and the global cap of 50."""
    kept = DD.dedup_by_url(_sources(spark, folder))
    return L.first_rows(kept, fv.REMOTE_CAP, "source_rank", "ord").select("source", "ord", "title", "url")


@query(f"""WITH s AS ({SOURCES_SQL}), d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY url ORDER BY source_rank, ord) = 1)
SELECT source, count(*) AS n FROM d GROUP BY 1""")
def fetch_counts(spark, folder):
    """Fresh rows per source."""
    return L.counts_per_source(DD.dedup_by_url(_sources(spark, folder)))


@query(f"""SELECT o_orderkey, score FROM (SELECT o_orderkey, CAST(1 + o_orderkey % 10 AS INTEGER) AS score FROM orders WHERE o_orderstatus = 'F')
  ORDER BY score DESC, o_orderkey LIMIT {fv.RUN_CAP}""")
def score_sort_cap(spark, folder):
    """Flagged rows, best score first with ties in input order, capped."""
    rows = table(spark, folder, "orders").filter("o_orderstatus = 'F'").select(
        "o_orderkey", F.expr("CAST(1 + o_orderkey % 10 AS INT)").alias("score"))
    return L.by_score(rows, "score", "o_orderkey").limit(fv.RUN_CAP)


NAMES = "(SELECT DISTINCT p_type AS grp, p_name AS name FROM part WHERE p_size <= 12)"


@query(f"""WITH small AS {NAMES}, large AS (SELECT DISTINCT p_type AS grp, p_name AS name FROM part WHERE p_size >= 40),
totals AS (SELECT p_type AS grp, count(DISTINCT p_name) AS n_distinct FROM part GROUP BY 1)
SELECT grp, n_distinct, coalesce(n_common, 0) AS n_common, coalesce(n_small_only, 0) AS n_small_only FROM totals
LEFT JOIN (SELECT grp, count(*) AS n_common FROM small JOIN large USING (grp, name) GROUP BY 1) USING (grp)
LEFT JOIN (SELECT grp, count(*) AS n_small_only FROM small ANTI JOIN large USING (grp, name) GROUP BY 1) USING (grp)""")
def title_sets(spark, folder):
    """Intersection, distinct and difference of title sets per group."""
    part = table(spark, folder, "part").select(F.col("p_type").alias("grp"), F.col("p_name").alias("name"), "p_size")
    small = part.filter("p_size <= 12").select("grp", "name")
    large = part.filter("p_size >= 40").select("grp", "name")
    total = part.select("grp", "name").distinct().groupBy("grp").agg(F.count("name").alias("n_distinct"))
    common = small.intersect(large).groupBy("grp").agg(F.count("name").alias("n_common"))
    only = small.distinct().join(large, ["grp", "name"], "left_anti").groupBy("grp").agg(F.count("name").alias("n_small_only"))
    return total.join(common, "grp", "left").join(only, "grp", "left").na.fill(0)


# Page urls moved to the known hosts.
BOARD_URL = """CASE page_id % 9
  WHEN 0 THEN 'https://boards.greenhouse.io/acme/jobs/' || page_id WHEN 1 THEN 'https://JOBS.lever.co/acme//' || page_id || '?lever=1'
  WHEN 2 THEN 'https://jobs.ashbyhq.com/acme/' || page_id || '#top' WHEN 3 THEN 'https://jobs.smartrecruiters.com/acme/' || page_id || '-title'
  WHEN 4 THEN 'https://acme.wd5.myworkdayjobs.com:443/x' WHEN 5 THEN 'https://jobs.jobvite.com/acme/job/' || page_id
  WHEN 6 THEN 'https://careers.example.org/job-' || page_id || '/view?jobId=' WHEN 7 THEN url || '&jobId=J' || page_id ELSE url END"""
URL_PATTERN = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


@query(f"""WITH u AS (SELECT page_id, {BOARD_URL} AS u FROM pages),
p AS (SELECT page_id, lower(regexp_extract(u, '{URL_PATTERN}', 1)) AS host, regexp_extract(u, '{URL_PATTERN}', 2) AS path,
  regexp_extract(u, '{URL_PATTERN}', 3) AS q FROM u)
SELECT page_id, host, array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '|') AS parts,
  CASE WHEN contains(host, 'greenhouse.io') THEN 'greenhouse' WHEN contains(host, 'lever.co') THEN 'lever'
       WHEN contains(host, 'ashbyhq.com') THEN 'ashby' WHEN contains(host, 'smartrecruiters.com') THEN 'smartrecruiters'
       WHEN contains(host, 'myworkdayjobs.com') THEN 'workday' WHEN contains(host, 'jobvite.com') THEN 'jobvite' END AS board,
  coalesce(nullif(regexp_extract(q, '(?:^|&)jobId=([^&]+)', 1), ''), nullif(regexp_extract(path, '/job[/-](\\d+)', 1), '')) AS job_id
FROM p""")
def url_parts(spark, folder):
    """P4, P5, P6."""
    url = F.expr(BOARD_URL)
    return table(spark, folder, "pages").select(
        "page_id", U.host(url).alias("host"), F.array_join(U.path_parts(url), "|").alias("parts"),
        U.detect_board(url).alias("board"), U.job_id(url).alias("job_id"))


@query(f"""WITH u AS (SELECT page_id, {BOARD_URL} AS u FROM pages)
SELECT coalesce(CASE WHEN contains(host, 'greenhouse.io') THEN 'greenhouse' WHEN contains(host, 'lever.co') THEN 'lever'
  WHEN contains(host, 'ashbyhq.com') THEN 'ashby' WHEN contains(host, 'smartrecruiters.com') THEN 'smartrecruiters'
  WHEN contains(host, 'myworkdayjobs.com') THEN 'workday' WHEN contains(host, 'jobvite.com') THEN 'jobvite' END, 'none') AS board, count(*) AS n
FROM (SELECT lower(regexp_extract(u, '{URL_PATTERN}', 1)) AS host FROM u) GROUP BY 1""")
def board_detect(spark, folder):
    """P5: pages per detected board."""
    board = F.coalesce(U.detect_board(F.expr(BOARD_URL)), F.lit("none"))
    return table(spark, folder, "pages").groupBy(board.alias("board")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT slug, ats FROM (SELECT 's' || s_suppkey AS slug, CASE WHEN s_suppkey % 2 = 0 THEN 'greenhouse' WHEN s_suppkey % 3 = 0 THEN 'lever'
  WHEN s_suppkey % 5 = 0 THEN 'ashby' END AS ats FROM supplier) WHERE ats IS NOT NULL""")
def detect_ats(spark, folder):
    """Probe results composed from suppliers, first board that answered."""
    probes = table(spark, folder, "supplier").select(
        F.expr("'s' || s_suppkey").alias("slug"), F.explode(F.array(
            F.struct(F.lit("ashby").alias("ats"), F.lit(4).alias("probe_rank"), F.expr("s_suppkey % 5 = 0").alias("ok")),
            F.struct(F.lit("lever").alias("ats"), F.lit(3).alias("probe_rank"), F.expr("s_suppkey % 3 = 0").alias("ok")),
            F.struct(F.lit("greenhouse").alias("ats"), F.lit(2).alias("probe_rank"), F.expr("s_suppkey % 4 = 0").alias("ok")),
            F.struct(F.lit("greenhouse").alias("ats"), F.lit(0).alias("probe_rank"), F.expr("s_suppkey % 2 = 0").alias("ok")),
        )).alias("p")).select("slug", "p.*")
    return R.detect_ats(probes)


@query("""SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE NULL END, ''),
  nullif(CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN ' ' ELSE c_name END, ''), 'Unknown') AS value FROM customer""")
def falsy_chain(spark, folder):
    """The first value that is neither NULL nor empty; blanks count."""
    return table(spark, folder, "customer").select("c_custkey", first_truthy(
        F.expr("CASE WHEN c_custkey % 2 = 0 THEN '' ELSE NULL END"),
        F.expr("CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN ' ' ELSE c_name END"),
        default="Unknown").alias("value"))
