"""Keywords, tokens and text rules."""

from pyspark.sql import functions as F

from gristmill import fixed_values as fv
from gristmill.functions import text as X
from gristmill.operators import keywords as K
from gristmill.operators import recall as R
from gristmill.plans import reports as RP
from gristmill.queries import query, sql_list, table
from gristmill.session import spread

STOP = sql_list(fv.KEYWORD_STOPWORDS)
TOKEN_STOP = sql_list(fv.TOKEN_STOPWORDS)


def ranked_keywords_sql(source: str = "documents", ident: str = "doc_id", text: str = "text") -> str:
    """Common tables up to `ranked` (ident, kind, gram, n, place)."""
    return f"""
words AS (SELECT {ident}, regexp_extract_all(lower({text}), '[a-z0-9-]+') AS ws FROM {source}),
placed AS (SELECT {ident}, unnest(ws) AS w, unnest(ws[2:]) AS nx, unnest(range(len(ws))) AS pos FROM words),
grams AS (
  SELECT {ident}, 0 AS kind, w AS gram, pos FROM placed WHERE length(w) > 2 AND w NOT IN ({STOP})
  UNION ALL
  SELECT {ident}, 1, w || ' ' || nx, pos FROM placed WHERE nx IS NOT NULL AND w NOT IN ({STOP}) AND nx NOT IN ({STOP})),
counted AS (SELECT {ident}, kind, gram, count(*) AS n, min(pos) AS first_pos FROM grams GROUP BY ALL),
ranked AS (SELECT {ident}, kind, gram, n, row_number() OVER (PARTITION BY {ident}, kind ORDER BY n DESC, first_pos) AS place
           FROM counted QUALIFY place <= CASE kind WHEN 0 THEN 20 ELSE 10 END)"""


def keyword_lists_sql(source: str = "documents", ident: str = "doc_id", text: str = "text") -> str:
    """Common tables up to `lists` (ident, kws), one row per source row."""
    return ranked_keywords_sql(source, ident, text) + f""",
lists AS (SELECT s.{ident}, coalesce(l.kws, []::VARCHAR[]) AS kws FROM {source} s
          LEFT JOIN (SELECT {ident}, list(gram ORDER BY kind, place) AS kws FROM ranked GROUP BY 1) l USING ({ident}))"""


TOKENS_SQL = f"""
tokens AS (SELECT doc_id, source, token FROM (
  SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9-]{{2,}}')) AS token FROM documents)
  WHERE token NOT IN ({TOKEN_STOP}))"""


@query(f"""WITH {ranked_keywords_sql()}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY kind, place) AS INTEGER) AS rank,
       gram AS keyword, n FROM ranked""")
def top_keywords(spark, folder):
    """P21, P22, F12, E17, W3, U6."""
    return K.top_keywords(table(spark, folder, "documents"), "doc_id", "text")


@query(f"""WITH {keyword_lists_sql()}
SELECT doc_id, CAST(len(kws) AS INTEGER) AS n_keywords,
       round(len(list_filter(kws, lambda k: contains(k, ' '))) / greatest(1, len(kws)), 6) AS bigram_share,
       array_to_string(kws, '|') AS keywords FROM lists""")
def keyword_list_shape(spark, folder):
    """E18, E19 per document, documents without keywords included."""
    lists = K.keyword_lists(table(spark, folder, "documents"), "doc_id", "text")
    kw = F.col("keywords")
    share = F.size(F.filter(kw, lambda k: F.contains(k, F.lit(" ")))) / F.greatest(F.lit(1), F.size(kw))
    return lists.select("doc_id", F.size(kw).alias("n_keywords"), F.round(share, 6).alias("bigram_share"),
                        F.array_join(kw, "|").alias("keywords"))


@query(f"WITH {TOKENS_SQL} SELECT doc_id, token, count(*) AS tf FROM tokens GROUP BY doc_id, token")
def tokenize_counts(spark, folder):
    """P20, E13."""
    return K.term_frequencies(table(spark, folder, "documents"), "doc_id", "text")


@query(f"""WITH {TOKENS_SQL}, c AS (SELECT source, token, count(*) AS n FROM tokens GROUP BY 1, 2)
SELECT source, token, n, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, token) AS INTEGER) AS rank
FROM c QUALIFY rank <= 10""")
def top_terms_by_source(spark, folder):
    """E13, L4."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return K.top_terms(spread(docs, "doc_id"), "source", "text", 10)


# Years text composed from part columns, the same way on both sides.
YEARS_TEXT = """CASE p_partkey % 7
  WHEN 0 THEN p_name || ' requires ' || p_size || '+ years of experience'
  WHEN 1 THEN p_name || ' with ' || p_size || '-' || (p_size + 2) || ' years in the field'
  WHEN 2 THEN 'Minimum ' || p_size || ' yrs of professional related work experience for ' || p_name
  WHEN 3 THEN p_type || ' at least ' || p_size || ' years industry experience'
  WHEN 4 THEN p_size || ' to ' || (p_size + 1) || ' yrs, ' || p_name
  WHEN 5 THEN '0-2 years ' || p_name
  ELSE p_name || ' ' || p_size || ' years' END"""
RANGE_SQL, SINGLE_SQL = (p.removeprefix("(?U)") for p in (fv.YEARS_RANGE_PATTERN, fv.YEARS_SINGLE_PATTERN))


def years_sql(text):
    """Years of experience in a text composed from columns of part."""
    return f"""SELECT p_partkey, TRY_CAST(coalesce(nullif(regexp_extract(t, '{RANGE_SQL}', 1), ''),
  nullif(regexp_extract(t, '{SINGLE_SQL}', 1), ''), nullif(regexp_extract(t, '{SINGLE_SQL}', 2), ''),
  nullif(regexp_extract(t, '{SINGLE_SQL}', 3), ''), '0') AS INTEGER) AS years
  FROM (SELECT p_partkey, lower({text}) AS t FROM part)"""


YEARS_SQL = years_sql(YEARS_TEXT)


@query(f"SELECT p_partkey, years, CASE WHEN years >= 3 THEN true WHEN years > 0 THEN false END AS senior FROM ({YEARS_SQL})")
def min_years(spark, folder):
    """P18, P19."""
    rows = table(spark, folder, "part").select("p_partkey", X.min_years(F.expr(YEARS_TEXT)).alias("years"))
    return rows.withColumn("senior", X.seniority(F.col("years")))


@query("""SELECT c_custkey, regexp_replace(lower(c_name || '/' || c_mktsegment), '[^a-z0-9]', '-', 'g') AS slug,
  trim(regexp_replace('  ' || c_name || chr(10) || chr(9) || c_mktsegment || '  ', '\\s+', ' ', 'g')) AS cleaned FROM customer""")
def slugs(spark, folder):
    """P1, P23."""
    rows = table(spark, folder, "customer")
    return rows.select("c_custkey", X.slugify(F.expr("c_name || '/' || c_mktsegment")).alias("slug"),
                       X.clean_text(F.expr("'  ' || c_name || '\\n\\t' || c_mktsegment || '  '")).alias("cleaned"))


# Skills of a family: the source's three most frequent tokens and two fixed words, one of them empty of matches.
FAMILY_SQL = f"""{TOKENS_SQL}, term_counts AS (SELECT source, token, count(*) AS n FROM tokens GROUP BY 1, 2),
skills AS (SELECT source, list_concat(list(token ORDER BY rn), ['CI/CD', 'ING']) AS skills FROM (
  SELECT source, upper(token) AS token, row_number() OVER (PARTITION BY source ORDER BY n DESC, token) AS rn FROM term_counts
  QUALIFY rn <= 3) GROUP BY 1)"""
RECALL_SQL = f"""{keyword_lists_sql()}, {FAMILY_SQL},
recalls AS (SELECT d.doc_id, d.source AS role_family, kws, skills,
  len(list_filter(skills, lambda s: len(list_filter(kws, lambda k: contains(k, lower(s)))) > 0)) / len(skills) AS recall,
  len(kws) AS n_keywords, len(list_filter(kws, lambda k: contains(k, ' '))) / greatest(1, len(kws)) AS bigram_share
  FROM documents d JOIN lists USING (doc_id) JOIN skills s ON d.source = s.source)"""


def _family_inputs(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    terms = K.top_terms(spread(docs, "doc_id"), "source", "text", 3)
    skills = terms.groupBy(F.col("source").alias("role_family")).agg(
        F.array_sort(F.collect_list(F.struct("rank", F.upper("token").alias("s")))).alias("ranked")).select(
        "role_family", F.concat(F.col("ranked.s"), F.array(F.lit("CI/CD"), F.lit("ING"))).alias("skills"))
    return docs.withColumnRenamed("source", "role_family"), skills


def _recall_rows(spark, folder):
    docs, skills = _family_inputs(spark, folder)
    placed = K.by_document(docs, "doc_id", "role_family", "text")
    return R.recall_rows(placed, K.keyword_lists(placed, "doc_id", "text", placed=True), skills, "doc_id")


@query(f"""WITH {RECALL_SQL} SELECT doc_id, role_family, round(recall, 6) AS recall, CAST(n_keywords AS INTEGER) AS n_keywords,
  round(bigram_share, 6) AS bigram_share FROM recalls""")
def skill_recall(spark, folder):
    """D6, D7, E18 to E20."""
    return _recall_rows(spark, folder).withColumns({
        "recall": F.round("recall", 6), "bigram_share": F.round("bigram_share", 6)})


@query(f"""WITH {RECALL_SQL} SELECT count(*) AS n_docs, round(avg(n_keywords), 6) AS keywords_mean,
  CAST(min(n_keywords) AS INTEGER) AS keywords_min, CAST(max(n_keywords) AS INTEGER) AS keywords_max,
  round(avg(bigram_share), 6) AS bigram_share_mean, round(avg(recall), 6) AS recall_mean, round(min(recall), 6) AS recall_min,
  round(max(recall), 6) AS recall_max, count_if(recall = 1.0) AS perfect_docs FROM recalls""")
def recall_summary(spark, folder):
    """E18, E19, E21."""
    summary = R.recall_summary(_recall_rows(spark, folder))
    return summary.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in summary.dtypes])


@query(f"""WITH {RECALL_SQL} SELECT role_family, count(*) AS n, round(avg(recall), 6) AS recall_mean FROM recalls GROUP BY 1""")
def recall_by_family(spark, folder):
    """E22."""
    return R.recall_by_family(_recall_rows(spark, folder)).withColumn("recall_mean", F.round("recall_mean", 6))


@query(f"""WITH {RECALL_SQL}, families AS (SELECT role_family, count(*) AS n, round(avg(recall), 3) AS recall_mean FROM recalls GROUP BY 1)
SELECT count(*) AS n_docs, round(avg(n_keywords), 2) AS keywords_mean, CAST(min(n_keywords) AS INTEGER) AS keywords_min, CAST(max(n_keywords) AS INTEGER) AS keywords_max,
  round(avg(bigram_share), 3) AS bigram_share_mean, round(avg(recall), 3) AS recall_mean, round(min(recall), 3) AS recall_min,
  round(max(recall), 3) AS recall_max, count_if(recall = 1.0) AS perfect_docs,
  (SELECT string_agg(role_family || ':' || n || ':' || recall_mean, ',' ORDER BY role_family) FROM families) AS families FROM recalls""")
def recall_report(spark, folder):
    """K3: the nested report, read back at all its fields."""
    docs, skills = _family_inputs(spark, folder)
    family = lambda x: F.concat_ws(":", x["role_family"], x["n"].cast("string"), x["recall_mean"].cast("string"))
    return RP.recall_report(docs, skills, "doc_id", "text").select("summary.*", F.array_join(F.transform("by_family", family), ",").alias("families"))
