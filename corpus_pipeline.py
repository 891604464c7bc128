"""A pipeline over documents: language, shared lines, near duplicates, mixture, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import bpe, langid, line_dedup, mixing, simhash
from gristmill.llm.rows import NULL_ID, id_key, staged, tie_key

#: A text whose likeliest language is less probable than this is rejected, as is one without a letter.
LEAST_SCORE = 0.5
_KEYS = ("_of_id", "_of_tie")


def _matched(docs: DataFrame, decisions: DataFrame, *columns: str) -> DataFrame:
    """``docs`` as one struct ``_row`` with the decisions of their row key. Equal rows have equal decisions."""
    row = docs.select(F.struct(*docs.columns).alias("_row"), id_key("doc_id").alias("_of_id"), tie_key("text").alias("_of_tie"))
    one = decisions.groupBy(F.col("_id").alias("_of_id"), F.col("_tie").alias("_of_tie")).agg(*(F.first(c).alias(f"_of_{c}") for c in columns))
    return row.join(one, list(_KEYS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language is likely enough. A null text goes. Nothing else changes."""
    found = langid.annotate(docs, langid.learned(docs))
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("_row.*")


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more share, but for the one with the largest id; ``n_chars`` follows.
    A null text stays null."""
    found = _matched(docs, line_dedup.drop_shared_lines(docs), "text", "n_dropped")
    cut = F.when(F.col("_of_n_dropped") > 0, F.col("_of_text")).otherwise(F.col("_row.text"))
    changed = {"text": cut, "n_chars": F.when(F.col("_of_n_dropped") > 0, F.length("_of_text").cast("long")).otherwise(F.col("_row.n_chars"))}
    return found.select(*(changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, texts whose SimHash fingerprints reach each other by steps of 2 or fewer bits:
    the one with the least id, a null id last. Where rows share that id, or it is null, the one with the smallest hash of its
    text; of equal rows one stays. Texts without words are near copies of each other."""
    groups = simhash.near_duplicates(docs)
    heads = (groups.groupBy("root").agg(F.min(F.struct((F.col("_id") == NULL_ID).alias("unnamed"), "_id", "_tie")).alias("head"))
             .select("head._id", "head._tie"))
    row = docs.select(F.struct(*docs.columns).alias("_row"), id_key("doc_id").alias("_id"), tie_key("text").alias("_tie"))
    return row.join(heads, ["_id", "_tie"]).dropDuplicates(["_id", "_tie"]).select("_row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of their sources takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    rows = bpe.encode_documents(docs, decode=True)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language id", language_id), ("line dedup", shared_lines), ("near duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]
#: Drawing by hash, learned languages and token ids have no SQL; the tests hold each stage and run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
