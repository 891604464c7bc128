"""Application log: lookups, upsert, statistics, gates."""

from pyspark.sql import functions as F

from gristmill import fixed_values as fv
from gristmill.functions import predicates as P
from gristmill.operators import limits as L
from gristmill.operators import log as LG
from gristmill.operators import stats as ST
from gristmill.plans import application as A
from gristmill.plans import reports as RP
from gristmill.queries import query, table
from gristmill.queries.similarity import pairs_sql
from gristmill.queries.text import YEARS_TEXT, years_sql

# Orders as an application log.
LOG_COLUMNS = [
    "o_orderpriority AS company", "'order ' || (o_orderkey % 400) AS title", "'c/' || o_custkey AS url",
    "CASE WHEN o_orderstatus = 'F' AND o_totalprice > 400000 THEN 'applied' WHEN o_orderstatus = 'O' THEN 'pending' END AS status",
    "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 10 + o_custkey % 2 AS INT) END AS score",
    "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority || o_orderstatus END AS cover_letter",
    "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderstatus END AS fit_reason", "o_orderkey AS ord",
]
LOG_SQL = f"(SELECT {', '.join(LOG_COLUMNS)} FROM orders)"


def _log(spark, folder):
    return table(spark, folder, "orders").selectExpr(*LOG_COLUMNS)


def _postings(spark, folder):
    return table(spark, folder, "customer").select(F.expr("'c/' || c_custkey").alias("url"), F.col("c_name").alias("title"))


@query(f"SELECT 'c/' || c_custkey AS url, c_name AS title FROM customer WHERE 'c/' || c_custkey NOT IN (SELECT url FROM {LOG_SQL} WHERE status = 'applied')")
def anti_join_applied(spark, folder):
    """D3, F6."""
    return LG.without_applied(_postings(spark, folder), _log(spark, folder))


@query(f"""SELECT 'c/' || c_custkey AS url, c_name AS title, a.url IS NOT NULL AS already_applied, coalesce(company, '') AS applied_company
  FROM customer LEFT JOIN (SELECT url, arg_min(company, ord) AS company FROM {LOG_SQL} WHERE status = 'applied' GROUP BY 1) a
  ON a.url = 'c/' || c_custkey""")
def applied_company(spark, folder):
    """D3, F6 with the company logged."""
    return LG.with_applied_company(_postings(spark, folder), _log(spark, folder))


# Updates from events: which keys a record has depends on its type.
UPDATE = """CASE event_type
  WHEN 'click' THEN '{"url": "u/' || user_id || '", "status": "applied"}'
  WHEN 'view' THEN '{"url": "u/' || user_id || '", "score": ' || CAST(event_id % 10 AS VARCHAR(20)) || '}'
  WHEN 'purchase' THEN '{"url": "u/' || user_id || '", "cover_letter": null, "fit_reason": "r' || event_id || '"}'
  WHEN 'error' THEN '{"url": "u/' || user_id || '", "title": "t' || event_id || '", "company": "c' || (event_id % 50) || '"}'
  ELSE '{"url": "n/' || user_id || '", "score": ' || CAST(event_id % 7 AS VARCHAR(20)) || ', "status": "pending"}' END"""


def _upsert_sql():
    present = {"status": "('click', 'signup')", "score": "('view', 'signup')", "cover_letter": "('purchase')",
               "fit_reason": "('purchase')", "title": "('error')", "company": "('error')"}
    value = {"status": "CASE event_type WHEN 'click' THEN 'applied' ELSE 'pending' END",
             "score": "CAST(CASE event_type WHEN 'view' THEN event_id % 10 ELSE event_id % 7 END AS INTEGER)",
             "cover_letter": "CAST(NULL AS VARCHAR)", "fit_reason": "'r' || event_id", "title": "'t' || event_id",
             "company": "'c' || (event_id % 50)"}
    aggs = ", ".join(f"arg_max_null({value[c]}, event_id) FILTER (WHERE event_type IN {present[c]}) AS new_{c}, "
                     f"count_if(event_type IN {present[c]}) > 0 AS has_{c}" for c in present)
    merged = ", ".join(f"CASE WHEN has_{c} AND first THEN new_{c} ELSE b.{c} END AS {c}" for c in present)
    return f"""WITH b AS (SELECT 'u/' || (c_custkey % 200) AS url, c_name AS title, c_mktsegment AS company, CAST(c_custkey % 11 AS INTEGER) AS score,
  'letter' AS cover_letter, CAST(NULL AS VARCHAR) AS fit_reason, 'pending' AS status, c_custkey - 10000000 AS ord,
  row_number() OVER (PARTITION BY c_custkey % 200 ORDER BY c_custkey) = 1 AS first FROM customer),
p AS (SELECT CASE WHEN event_type = 'signup' THEN 'n/' ELSE 'u/' END || user_id AS url, {aggs}, min(event_id) AS patch_ord FROM events GROUP BY 1)
SELECT b.url, {merged}, b.ord FROM b LEFT JOIN p ON b.url = p.url
UNION ALL SELECT p.url, {", ".join("new_" + c for c in present)}, patch_ord FROM p WHERE p.url NOT IN (SELECT url FROM b)"""


@query(_upsert_sql())
def upsert_log(spark, folder):
    """Partial records, explicit nulls, repeated updates, repeated base urls and new urls."""
    base = table(spark, folder, "customer").selectExpr(
        "'u/' || (c_custkey % 200) AS url", "c_name AS title", "c_mktsegment AS company", "CAST(c_custkey % 11 AS INT) AS score",
        "'letter' AS cover_letter", "CAST(NULL AS STRING) AS fit_reason", "'pending' AS status", "c_custkey - 10000000 AS ord")
    updates = table(spark, folder, "events").select(F.expr(UPDATE).alias("body"), F.col("event_id").alias("ord"))
    return LG.upsert(base, LG.parse_updates(updates))


@query(f"SELECT coalesce(status, 'unknown') AS status, count(*) AS n FROM {LOG_SQL} GROUP BY 1")
def status_counts(spark, folder):
    """E1."""
    return ST.status_counts(_log(spark, folder))


@query("""SELECT company, count(*) AS n, min(ord) AS first_ord FROM (SELECT c_name AS company, o_orderkey AS ord FROM orders
  JOIN customer ON o_custkey = c_custkey) GROUP BY 1 ORDER BY n DESC, first_ord LIMIT 10""")
def top_companies(spark, folder):
    """E2, L4."""
    log = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return ST.top_companies(log.select(F.col("c_name").alias("company"), F.col("o_orderkey").alias("ord")))


@query(f"""SELECT count(*) AS n_jobs, count_if(coalesce(cover_letter, '') <> '') AS n_with_cover_letter,
  count_if(coalesce(fit_reason, '') <> '') AS n_with_fit_reason, count(DISTINCT title) AS n_distinct_titles,
  count(DISTINCT company) AS n_companies FROM {LOG_SQL}""")
def distinct_counts(spark, folder):
    """E3, E4."""
    return ST.dataset_summary(_log(spark, folder))


def _statistics_sql(source, value, group=None):
    keys = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    return f"""SELECT {keys}count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median,
  round(coalesce(stddev_samp(v), 0), 6) AS stdev, min(v) AS min, max(v) AS max,
  list_sort(list(v))[CAST(least(count(v), floor(0.95 * count(v)) + 1) AS BIGINT)] AS p95
  FROM (SELECT {keys}{value} AS v FROM {source}) WHERE v IS NOT NULL {by}"""


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


@query(_statistics_sql(LOG_SQL, "score"))
def score_stats(spark, folder):
    """E5 to E9."""
    return _rounded(ST.score_statistics(_log(spark, folder), "score"))


@query(_statistics_sql("lineitem", "CAST(l_quantity AS INTEGER)", "l_returnflag"))
def quantity_stats(spark, folder):
    """E5 to E9 per group at lineitem scale."""
    rows = table(spark, folder, "lineitem").select("l_returnflag", F.col("l_quantity").cast("int").alias("v"))
    return _rounded(ST.score_statistics(rows, "v", "l_returnflag"))


@query("""SELECT l_returnflag, l_linestatus, list_sort(list(v))[CAST(least(count(v), floor(0.95 * count(v)) + 1) AS BIGINT)] AS p95
  FROM (SELECT l_returnflag, l_linestatus, CAST(round(l_extendedprice / 100) AS INTEGER) AS v FROM lineitem) GROUP BY 1, 2""")
def p95(spark, folder):
    """E8 per group: the value at rank min(n - 1, int(0.95 n)) from 0."""
    rows = table(spark, folder, "lineitem").select(
        "l_returnflag", "l_linestatus", F.round(F.col("l_extendedprice") / 100, 0).cast("int").alias("v"))
    return ST.score_statistics(rows, "v", "l_returnflag", "l_linestatus").select("l_returnflag", "l_linestatus", "p95")


@query(f"SELECT score AS value, count(*) AS n FROM {LOG_SQL} WHERE score IS NOT NULL GROUP BY 1 ORDER BY 1")
def score_distribution(spark, folder):
    """E10."""
    return ST.distribution(_log(spark, folder), "score").orderBy("value")


@query(_statistics_sql(f"""(SELECT CASE WHEN status = 'applied' THEN 'applied' ELSE 'pending' END AS "group", score FROM {LOG_SQL})""",
                       "score", '"group"'))
def score_by_status(spark, folder):
    """E11."""
    return _rounded(ST.score_by_status(_log(spark, folder)))


@query(f"SELECT CAST(floor(score + 0.5) AS BIGINT) AS bin, count(*) AS n FROM {LOG_SQL} WHERE score IS NOT NULL GROUP BY 1")
def score_histogram(spark, folder):
    """E24."""
    return ST.score_histogram(_log(spark, folder))


@query("""WITH v AS (SELECT l_returnflag, CAST(l_quantity * l_quantity AS INTEGER) AS x FROM lineitem),
q AS (SELECT l_returnflag, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY 1)
SELECT l_returnflag, count(*) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
  min(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low_whisker,
  max(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high_whisker,
  count(*) FILTER (WHERE NOT x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM v JOIN q USING (l_returnflag) GROUP BY 1""")
def boxplot(spark, folder):
    """E26."""
    rows = table(spark, folder, "lineitem").select("l_returnflag", (F.col("l_quantity") * F.col("l_quantity")).cast("int").alias("x"))
    return _rounded(ST.box_plot(rows, "l_returnflag", "x"))


@query("SELECT count(*) AS n, round(avg(length(text)), 6) AS mean_len_chars FROM conversations WHERE text <> ''")
def mean_text_length(spark, folder):
    """E15."""
    return _rounded(ST.mean_length(table(spark, folder, "conversations"), "text"))


@query("""SELECT 4 AS calls_per_resume, 750 AS tokens_per_resume, CAST(0.0006 AS DOUBLE) AS cost_per_resume_usd, count(*) * 4 AS total_calls,
  count(*) * 750 AS total_tokens, round(count(*) * CAST(0.00057 AS DOUBLE), 2) AS total_cost_usd FROM documents""")
def cost_model(spark, folder):
    """E16."""
    return ST.cost_model(table(spark, folder, "documents"))


FILL_SQL = """WITH d AS (SELECT 'p/' || doc_id AS url, text AS description, CASE WHEN doc_id % 3 = 0 THEN 'Unknown' ELSE lang END AS location,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS company FROM documents)
SELECT p.url, title, CASE WHEN needs AND coalesce(d.company, '') NOT IN ('', 'Unknown') THEN d.company ELSE p.company END AS company,
  CASE WHEN needs AND coalesce(d.location, '') NOT IN ('', 'Unknown') THEN d.location ELSE p.location END AS location,
  md5(CASE WHEN needs AND coalesce(d.description, '') NOT IN ('', 'Unknown') THEN d.description ELSE p.description END) AS digest
FROM (SELECT 'p/' || p_partkey AS url, p_name AS title, p_brand AS company, p_type AS location,
  CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN p_name ELSE repeat(p_name || ' ', 20) END AS description,
  p_size % 4 <= 1 AS needs FROM part) p LEFT JOIN d ON d.url = p.url"""


@query(FILL_SQL)
def fill_description(spark, folder):
    """D9, F7."""
    postings = table(spark, folder, "part").selectExpr(
        "'p/' || p_partkey AS url", "p_name AS title", "p_brand AS company", "p_type AS location",
        "CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN p_name ELSE repeat(p_name || ' ', 20) END AS description")
    scraped = table(spark, folder, "documents").selectExpr(
        "'p/' || doc_id AS url", "text AS description", "CASE WHEN doc_id % 3 = 0 THEN 'Unknown' ELSE lang END AS location",
        "CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS company")
    filled = LG.fill_from_scraped(postings, scraped, ["company", "location", "description"])
    return filled.select("url", "title", "company", "location", F.md5("description").alias("digest"))


# Responses of the gates: verdicts from labels, scores and results from part columns.
SCORE_TEXT = """CASE p_partkey % 4 WHEN 0 THEN '{"score": ' || (p_size % 11) || '}' WHEN 1 THEN 'Score: ' || (p_size % 11) || '/10'
  WHEN 2 THEN 'Sure! {"score": "' || (p_size % 11) || '"} done' ELSE 'none' END"""
RESULT_TEXT = """CASE WHEN p_partkey % 6 = 0 THEN 'no json' WHEN p_partkey % 6 = 1 THEN '{}'
  ELSE 'ok {"cover_letter": "' || p_name || '", "fit_reason": "' || p_type || '"}' END"""


# Every third posting was scraped: even ones without a usable description, odd ones with a text of their own.
SCRAPED_TEXT = "CASE WHEN p_partkey % 2 = 0 THEN 'Unknown' ELSE 'at least ' || (p_size % 4) || ' years, ' || p_name END"
GATE_TEXT = f"CASE WHEN p_partkey % 6 = 3 AND length({YEARS_TEXT}) < 100 THEN {SCRAPED_TEXT} ELSE {YEARS_TEXT} END"


def _gate_inputs(spark, folder):
    part = table(spark, folder, "part")
    postings = part.selectExpr(
        "'p/' || p_partkey AS url", "p_name AS title", "p_brand AS company", f"{YEARS_TEXT} AS description", "'x' AS location",
        "'part' AS source", "0 AS source_rank", "p_partkey AS ord")
    log = table(spark, folder, "orders").selectExpr(
        "'p/' || o_orderkey AS url", "o_orderpriority AS company",
        "CASE WHEN o_orderstatus = 'F' THEN 'applied' ELSE 'pending' END AS status", "o_orderkey AS ord")
    verdicts = A.seniority_verdicts(table(spark, folder, "labels").selectExpr(
        "'p/' || doc_id AS url", "CASE WHEN quality = 0 THEN '  Yes ' ELSE 'no' END AS text"))
    scores = part.selectExpr("'p/' || p_partkey AS url", f"{SCORE_TEXT} AS text")
    results = part.selectExpr("'p/' || p_partkey AS url", f"{RESULT_TEXT} AS text")
    scraped = part.filter("p_partkey % 3 = 0").selectExpr(
        "'p/' || p_partkey AS url", "'' AS title", f"{SCRAPED_TEXT} AS description", "'' AS location", "'' AS source",
        "p_brand AS company", "p_partkey AS ord")
    return postings, log, scraped, verdicts, scores, results


GATES_SQL = f"""WITH y AS ({years_sql(GATE_TEXT)}), s AS (SELECT p_partkey, CAST(CASE WHEN p_partkey % 4 = 3 THEN 0 ELSE p_size % 11 END AS INTEGER) AS score FROM part),
kept AS (SELECT 'p/' || p_partkey AS url, p_partkey AS ord, p_name, p_type, score FROM part JOIN y USING (p_partkey) JOIN s USING (p_partkey)
  WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = p_partkey AND o_orderstatus = 'F')
  AND (years BETWEEN 1 AND 2 OR (years = 0 AND NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = p_partkey AND quality = 0)))
  AND score >= 6)"""


@query(GATES_SQL + " SELECT url, score, ord FROM kept")
def posting_gates(spark, folder):
    """Applied, description, seniority and score gates in order."""
    postings, log, scraped, verdicts, scores, _ = _gate_inputs(spark, folder)
    return A.candidates_to_apply(postings, log, scraped, verdicts, scores).select("url", "score", "ord")


@query(GATES_SQL + """ SELECT url, score, p_name AS cover_letter, p_type AS fit_reason, 'pending' AS status FROM kept WHERE ord % 6 > 1
  ORDER BY ord LIMIT 50""")
def application_updates(spark, folder):
    """Log records of the first 50 gated postings with a usable response."""
    postings, log, scraped, verdicts, scores, results = _gate_inputs(spark, folder)
    accepted = A.candidates_to_apply(postings, log, scraped, verdicts, scores)
    return A.log_updates(accepted, results, cap=fv.RUN_CAP).select("url", "score", "cover_letter", "fit_reason", "status")


def _similarity_sql(name: str, text: str) -> str:
    """mean, deviation, least and largest similarity of a text of the unique postings."""
    source = f"(SELECT ord, {text} AS text FROM u WHERE coalesce({text}, '') <> '')"
    return ", ".join(f"(WITH {pairs_sql(source, 'ord')} SELECT round({sql}, 3) FROM pairs) AS {name}_{part}" for part, sql in (
        ("mean", "avg(sim)"), ("stdev", "stddev_samp(sim)"), ("min", "min(sim)"), ("max", "max(sim)")))


_APPLIED = "score IS NOT NULL AND coalesce(status, '') = 'applied'"
_OTHERS = "score IS NOT NULL AND coalesce(status, '') <> 'applied'"


@query(f"""WITH l AS (SELECT * FROM {LOG_SQL}),
u AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY lower(title), lower(company) ORDER BY ord) = 1)
SELECT {_similarity_sql("cover", "cover_letter")}, {_similarity_sql("reason", "fit_reason")},
  count(*) FILTER ({_APPLIED}) AS applied_n, round(avg(score) FILTER ({_APPLIED}), 2) AS applied_mean, median(score) FILTER ({_APPLIED}) AS applied_median,
  count(*) FILTER ({_OTHERS}) AS others_n, round(avg(score) FILTER ({_OTHERS}), 2) AS others_mean, median(score) FILTER ({_OTHERS}) AS others_median,
  median(score) AS median, round(stddev_samp(score), 2) AS stdev, min(score) AS min, max(score) AS max,
  round((SELECT avg(length(cover_letter)) FROM u WHERE coalesce(cover_letter, '') <> ''), 6) AS cover_len, count(*) AS n_jobs, (SELECT count(*) FROM u) AS n_unique_postings, CAST((SELECT count(DISTINCT title) FROM l) AS BIGINT) AS n_distinct_titles,
  round(avg(score), 2) AS mean, (SELECT count(*) FROM u WHERE coalesce(cover_letter, '') <> '') AS n_cover,
  round((SELECT avg(length(fit_reason)) FROM u WHERE coalesce(fit_reason, '') <> ''), 6) AS reason_len, count(*) * 4 AS total_calls,
  (SELECT string_agg(CAST(score AS VARCHAR) || ':' || n, ',' ORDER BY score) FROM (SELECT score, count(*) AS n FROM l WHERE score IS NOT NULL GROUP BY 1)) AS distribution,
  (SELECT string_agg(status || ':' || n, ',' ORDER BY status) FROM (SELECT coalesce(status, 'unknown') AS status, count(*) AS n FROM l GROUP BY 1)) AS statuses,
  (SELECT string_agg(company || ':' || n, ',' ORDER BY n DESC, first_ord) FROM (SELECT coalesce(company, '') AS company, count(*) AS n, min(ord) AS first_ord FROM l
     GROUP BY 1 ORDER BY n DESC, first_ord LIMIT 10)) AS companies FROM l""")
def statistics_report(spark, folder):
    """The nested report, read back at fields of all its sections."""
    def listed(rows, key):
        return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x[key].cast("string"), x["n"].cast("string"))), ",")

    def group(name):
        return F.get(F.filter("score_vs_status", lambda x: x["group"] == name), F.lit(0))

    similar = [F.col(f"{section}_similarity.cosine_{part}").alias(f"{name}_{part}") for name, section in (("cover", "cover_letter"), ("reason", "fit_reason"))
               for part in ("mean", "stdev", "min", "max")]
    by_status = [group(name)[field].alias(f"{label}_{field}") for label, name in (("applied", "applied"), ("others", "pending")) for field in ("n", "mean", "median")]
    return RP.statistics_report(_log(spark, folder)).select(
        *similar, *by_status, "scores.median", "scores.stdev", "scores.min", "scores.max", F.round("cover_letter_length.mean_len_chars", 6).alias("cover_len"),
        "dataset.n_jobs", "unique.n_unique_postings", "dataset.n_distinct_titles", "scores.mean",
        F.col("cover_letter_length.n").alias("n_cover"),
        F.round("fit_reason_length.mean_len_chars", 6).alias("reason_len"), "cost_model.total_calls",
        listed(F.col("distribution"), "value").alias("distribution"), listed(F.col("statuses"), "status").alias("statuses"),
        listed(F.col("top_companies"), "company").alias("companies"))
