"""The operators as registered queries over whole tables."""

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import bpe, chat_format, divergence, fingerprints, langid, lexical_search, license_scan, line_dedup, mixing, quality_rules, simhash, suffix_dedup, token_files
from gristmill.llm.rows import id_back

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixing.mix_report(table(spark, folder, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query()
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, folder, "documents"))
    return rows.select(id_back().alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                       F.col("component").alias("component_id"))


SHARED_LINES = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS line_key FROM lines),
shared AS (SELECT line_key, max(doc_id) AS keeper FROM keyed WHERE length(line_key) >= 20
           GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, s.keeper IS NOT NULL AND s.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN shared s USING (line_key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query(SHARED_LINES)
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = line_dedup.without_shared_lines(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op4_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    rows = bpe.encode_documents(table(spark, folder, "documents"), decode=True)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.report(table(spark, folder, "documents"))


@query()
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality_rules.judge(docs, quality_rules.train(docs, table(spark, folder, "labels")))


@query()
def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_documents(table(spark, folder, "documents"))


@query()
def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = token_files.new_folder(spark)
    token_files.write_token_files(table(spark, folder, "documents"), files)
    rows = token_files.read_token_files(spark, files).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return token_files.with_starts(spark, files, rows).select("doc_id", "start", "n_tokens", "ids_crc32")


@query()
def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, folder, "documents"))


_LOWERED = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
DIVERGENCE = rf"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     regexp_extract_all({_LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
places AS (SELECT row, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM places GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM places JOIN kept USING (lang, term) GROUP BY lang, source, term),
dense AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
shares AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER w + count(*) OVER w) AS p FROM dense WINDOW w AS (PARTITION BY lang, source)),
whole AS (SELECT lang, term, sum(n) AS n FROM dense GROUP BY lang, term),
wide AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER w + count(*) OVER w) AS q FROM whole WINDOW w AS (PARTITION BY lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
          UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares JOIN wide USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
       (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= 200"""


@query(DIVERGENCE)
def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


SEARCH = rf"""
WITH held AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{lexical_search.TERM}') AS terms FROM documents),
items AS (SELECT item_id, unnest(list_distinct(regexp_extract_all({_LOWERED}, '{lexical_search.TERM}'))) AS term FROM benchmark),
total AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_all FROM held WHERE len(terms) > 0),
found AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM held)
          WHERE term IN (SELECT term FROM items) GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM found, total GROUP BY term, n_docs),
lengths AS (SELECT doc_id, 100 - 50 + (50 * len(terms) * n_docs) // n_all AS m FROM held, total),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
           FROM items JOIN weights USING (term) JOIN found USING (term) JOIN lengths USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50"""


@query(SEARCH)
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


CHATS = """
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -7, k, r, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(k, r)),
seen AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM turns),
marked AS (SELECT *, CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user'
                          WHEN before = 'user' THEN role = 'assistant' ELSE role = 'user' END AS in_order FROM seen)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || role || ': </turn>' || chr(10)) + CASE WHEN in_order THEN 0 ELSE length(' (out of turn)') END
                + length(replace(replace(replace(text, '\\', '\\\\'), '### ', '\\0'), '</turn>', '\\1'))) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id"""


@query(CHATS)
def op13_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"),
                                    F.lit("\\### Assistant: </turn> ok").alias("text"))
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    rows = chat_format.format_conversations(turns).select("conv_id", chat_format.formatted().alias("formatted"), chat_format.loss_text().alias("loss"))
    rows = rows.withColumn("turns", chat_format.turns_back(F.col("formatted")))
    listed = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
