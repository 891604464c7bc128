"""How well extracted keywords recover the skills a text is known to ask for."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill import fixed_values as fv


def skills_table(spark: SparkSession, families: Mapping[str, Sequence[str]] = fv.FAMILY_SKILLS) -> DataFrame:
    """One row per family with its skills, a handful of rows by construction."""
    return spark.createDataFrame([(k, list(v)) for k, v in families.items()], "role_family STRING, skills ARRAY<STRING>")


def skill_recall(skills: Column, keywords: Column) -> Column:
    """Share of skills that are part of a keyword; 1.0 when none are required."""
    hits = F.size(F.filter(skills, lambda s: F.exists(keywords, lambda k: F.contains(k, F.lower(s)))))
    return F.when(F.coalesce(F.size(skills), F.lit(0)) <= 0, F.lit(1.0)).otherwise(hits / F.size(skills))


def recall_rows(docs: DataFrame, keyword_lists: DataFrame, skills: DataFrame, doc_id: str = "id") -> DataFrame:
    """D6, E18 to E20 per document: recall, n_keywords, bigram_share."""
    kw = F.col("keywords")
    pairs = F.size(F.filter(kw, lambda k: F.contains(k, F.lit(" "))))
    return docs.select(doc_id, "role_family").join(keyword_lists, doc_id).join(skills, "role_family").select(
        doc_id, "role_family", skill_recall(F.col("skills"), kw).alias("recall"),
        F.size(kw).alias("n_keywords"),
        (pairs / F.greatest(F.lit(1), F.size(kw))).alias("bigram_share"))


def recall_summary(rows: DataFrame) -> DataFrame:
    """E18, E19, E21."""
    return rows.agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("n_keywords").alias("keywords_mean"),
        F.min("n_keywords").alias("keywords_min"), F.max("n_keywords").alias("keywords_max"),
        F.avg("bigram_share").alias("bigram_share_mean"), F.avg("recall").alias("recall_mean"),
        F.min("recall").alias("recall_min"), F.max("recall").alias("recall_max"),
        F.count_if(F.col("recall") == 1.0).alias("perfect_docs"))


def recall_by_family(rows: DataFrame) -> DataFrame:
    """E22."""
    return rows.groupBy("role_family").agg(F.count(F.lit(1)).alias("n"), F.avg("recall").alias("recall_mean"))
