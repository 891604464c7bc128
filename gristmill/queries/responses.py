"""Batches of requests and responses."""

from pyspark.sql import functions as F

from gristmill.functions import responses as RS
from gristmill.operators import requests as RQ
from gristmill.queries import query, table

# Event properties wrapped in the ways responses come back.
WRAPPED = """CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN 'Sure: ' || props || ' bye' WHEN 2 THEN replace(props, '"k"', '"score"')
  WHEN 3 THEN 'x ' || replace(replace(props, '"k": ', '"score": "'), '}', '"}') || ' y' WHEN 4 THEN 'I say ' || user_id || ' of 10'
  WHEN 5 THEN '{"score": ' || value || '}' WHEN 6 THEN 'none' ELSE NULL END"""
K = "CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER)"


@query(f"""SELECT event_id, coalesce(CASE event_id % 8 WHEN 4 THEN user_id WHEN 5 THEN CAST(trunc(value) AS INTEGER) WHEN 6 THEN 0 WHEN 7 THEN 0
  ELSE {K} END, 0)::INTEGER AS score FROM events""")
def score_from_response(spark, folder):
    """P25: JSON score, digits of the text, or 0."""
    return table(spark, folder, "events").select("event_id", RS.score_from_response(F.expr(WRAPPED)).alias("score"))


@query(f"""SELECT event_id, event_id % 8 IN (0, 1, 2, 3, 5) AS parsed, CASE WHEN event_id % 8 <= 1 THEN {K} END AS k FROM events""")
def json_salvage(spark, folder):
    """P24."""
    data = RS.salvage_json(F.expr(WRAPPED))
    return table(spark, folder, "events").select(
        "event_id", data.isNotNull().alias("parsed"), F.try_variant_get(data, "$.k", "int").alias("k"))


LIST_TEXT = "p_size || '. ' || p_name || chr(10) || 'note' || chr(10) || '  2. ' || p_type || '. x  ' || chr(10) || '- 3. no'"
PICKS = "p_size % 5 || ', 1 ,x, 9,' || p_size % 3 || ', ,1'"


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'a|b' ELSE p_size || '|' || p_name || '|' || p_type || '. x' END AS reordered,
  array_to_string(list_filter([p_size % 5, 1, p_size % 3, 1], lambda i: i BETWEEN 1 AND 3)[1:3], '|') AS picked,
  array_to_string(list_filter([p_name, p_type, 'c', 'd', 'e', 'f', 'g', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'h' END, 'i', 'j'], lambda x: x <> '')[1:8], '|') AS skills
  FROM part""".replace("p_size || '|' || p_name", "p_name"))
def list_parsers(spark, folder):
    """P26, P27, P28, L7."""
    items = F.array(F.lit("1"), F.lit("2"), F.lit("3"))
    return table(spark, folder, "part").select(
        "p_partkey",
        F.array_join(RS.reordered_list(F.expr(f"CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE {LIST_TEXT} END"),
                                       F.array(F.lit("a"), F.lit("b"))), "|").alias("reordered"),
        F.array_join(RS.picked_items(F.expr(PICKS), items), "|").alias("picked"),
        F.array_join(RS.comma_list(F.expr("p_name || ' , ' || p_type || ',c,,d, e ,f,g,' || CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE 'h' END || ',i,j'")),
                     "|").alias("skills"))


RESULT = """CASE event_id % 6 WHEN 0 THEN '{"cover_letter": "L' || event_id || '", "fit_reason": "R"}' WHEN 1 THEN 'text only' WHEN 2 THEN '{}'
  WHEN 3 THEN 'a {"cover_letter": "M", "title": "' || event_type || '", "description": " some  text ' || event_id || '"} b'
  WHEN 4 THEN '{"error": "busy"}' ELSE 'null' END"""


@query(f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'L' || event_id WHEN 3 THEN 'M' END AS cover_letter, CASE event_id % 6 WHEN 0 THEN 'R' END AS fit_reason,
  CASE event_id % 6 WHEN 1 THEN 'text only' WHEN 2 THEN '{{}}' WHEN 4 THEN 'busy' WHEN 5 THEN 'null' END AS error,
  CASE event_id % 6 WHEN 3 THEN event_type END AS title, CASE event_id % 6 WHEN 3 THEN 'some text ' || event_id END AS description FROM events""")
def response_rows(spark, folder):
    """Application results, error rows and extracted postings."""
    text = F.expr(RESULT)
    rows = table(spark, folder, "events").select(
        "event_id", RS.application_result(text).alias("r"), RS.extracted_posting(text, F.lit("u")).alias("p"))
    return rows.select("event_id", "r.*", "p.title", "p.description")


@query("""SELECT kind || ':' || doc_id AS request_id, kind, CAST(head + least(cut, length(text)) AS INTEGER) AS n_chars FROM documents,
  (VALUES ('seniority', 55, 1500), ('extraction', 58, 6000), ('summary', 48, 800)) k(kind, head, cut)""")
def request_rows(spark, folder):
    """Texts are cut at the length of each request kind."""
    docs = table(spark, folder, "documents")
    ident, text = F.col("doc_id"), F.col("text")
    rows = RQ.request_rows(docs, RQ.seniority_request(ident, text), RQ.extraction_request(ident, text),
                           RQ.summary_request(ident, F.lit("A summary"), text))
    return rows.select("request_id", "kind", F.length("text").alias("n_chars"))


# The text of each kind of request, from a document; cuts are 800 characters but for those named.
REQUEST_TEXT = {
    "score": "'Rate from 1 to 10 how well the resume fits the posting. Answer as {\"score\": n}.' || nl || 'resume of ' || source || nl || block",
    "application": "'Write a short letter and reason. Answer as {\"cover_letter\": ..., \"fit_reason\": ...}.' || nl || 'resume of ' || source || nl || block",
    "advice": "'Say what to highlight, add, remove and rewrite, as JSON with those four lists.' || nl || 'resume of ' || source || nl || block",
    "summary": "'Rewrite the summary for this posting.' || nl || 'A summary' || nl || left(text, 800)",
    "seniority": "'Does this ask for 2.5 or more years? Answer yes or no.' || nl || left(text, 1500)",
    "reorder": "'Order these lines by relevance, as a numbered list.' || nl || '1. first' || nl || '2. line ' || doc_id || nl || left(text, 600)",
    "projects": "'Pick the best 3; answer with their numbers, comma separated.' || nl || '1. P' || doc_id || ': a b' || nl || '2. Q: ' || nl || left(text, 800)",
    "competencies": "'Name 6 to 8 matching skills, comma separated.' || nl || lang || ', x, ' || source || nl || left(text, 800)",
    "extraction": "'Extract title, company, location and description as JSON.' || nl || left(text, 6000)",
}


@query("WITH d AS (SELECT *, chr(10) AS nl, 'Title: ' || source || chr(10) || 'Company: ' || lang || chr(10) || 'Description: ' || left(text, 800) AS block FROM documents) "
       + " UNION ALL ".join(f"SELECT '{kind}:' || doc_id AS request_id, '{kind}' AS kind, md5({sql}) AS digest FROM d" for kind, sql in REQUEST_TEXT.items()))
def score_requests(spark, folder):
    """All nine kinds of request per document, by the digest of their text."""
    docs = table(spark, folder, "documents")
    ident, text, title, company = (F.col(c) for c in ("doc_id", "text", "source", "lang"))
    resume = F.concat(F.lit("resume of "), title)
    bullets = F.array(F.lit("first"), F.concat(F.lit("line "), ident.cast("string")))
    none = F.array().cast("array<string>")
    projects = F.array(F.struct(F.concat(F.lit("P"), ident.cast("string")).alias("name"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("bullets")),
                       F.struct(F.lit("Q").alias("name"), none.alias("bullets")))
    skills = F.array(F.struct(F.array(company, F.lit("x")).alias("skills")), F.struct(F.array(title).alias("skills")))
    asked = [make(ident, resume, title, company, text) for make in (RQ.score_request, RQ.application_request, RQ.advice_request)]
    rows = RQ.request_rows(docs, *asked, RQ.summary_request(ident, F.lit("A summary"), text), RQ.seniority_request(ident, text), RQ.reorder_request(ident, bullets, text),
                           RQ.projects_request(ident, projects, text), RQ.competencies_request(ident, skills, text), RQ.extraction_request(ident, text))
    return rows.select("request_id", "kind", F.md5("text").alias("digest"))
