"""Roles, rosters and board detection."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill import fixed_values as fv
from gristmill.functions.text import strip_blank


def role_key(role: Column) -> Column:
    return F.replace(F.replace(strip_blank(F.lower(role)), F.lit(" "), F.lit("_")), F.lit("/"), F.lit("_"))


def role_terms(synonyms: DataFrame) -> DataFrame:
    """One row per role key with its terms in order. Input: role_key, ord, term."""
    pairs = F.array_sort(F.collect_list(F.struct("ord", F.lower("term").alias("term"))))
    return synonyms.groupBy("role_key").agg(pairs.alias("pairs")).select(
        "role_key", F.col("pairs.term").alias("terms"))


def expand_roles(rows: DataFrame, role: str, synonyms: DataFrame) -> DataFrame:
    """D1 when the role differs by row: adds `terms`. An unknown role matches itself untrimmed; an
    empty role has no terms."""
    terms = role_terms(synonyms)
    keyed = rows.withColumn("role_key", role_key(F.col(role)))
    fallback = F.when(F.coalesce(F.col(role), F.lit("")) == "", F.array().cast("array<string>")) \
        .otherwise(F.array(F.lower(F.col(role))))
    return keyed.join(terms, "role_key", "left").withColumn("terms", F.coalesce("terms", fallback)).drop("role_key")


def terms_of(spark: SparkSession, role: str | None, synonyms: Mapping[str, Sequence[str]] = fv.ROLE_SYNONYMS) -> list[str]:
    """D1 for the one role of a run: `expand_roles` over a table of one row."""
    row = spark.createDataFrame([(role,)], "role STRING")
    return expand_roles(row, "role", synonyms_table(spark, synonyms)).first().terms


def synonyms_table(spark: SparkSession, synonyms: Mapping[str, Sequence[str]] = fv.ROLE_SYNONYMS) -> DataFrame:
    """The synonym dimension, a handful of rows by construction."""
    rows = [(key, i, term) for key, terms in synonyms.items() for i, term in enumerate(terms)]
    return spark.createDataFrame(rows, "role_key STRING, ord INT, term STRING")


def roster_table(spark: SparkSession, india_only: bool = False, roster: Sequence | None = None) -> DataFrame:
    """Company roster (name, slug, ord). A plain name is its own slug."""
    entries = roster if roster is not None else (fv.INDIA_COMPANIES if india_only else fv.COMPANIES)
    rows = [(e[0], e[1], i) if isinstance(e, (tuple, list)) else (e, None, i) for i, e in enumerate(entries)]
    return with_slugs(spark.createDataFrame(rows, "name STRING, slug STRING, ord INT"))


def with_slugs(roster: DataFrame) -> DataFrame:
    """A company without a slug has its name for one."""
    return roster.withColumn("slug", F.coalesce("slug", "name"))


def detect_ats(probes: DataFrame) -> DataFrame:
    """The first board that answered per slug. Input: slug, ats, probe_rank, ok."""
    return probes.filter("ok").groupBy("slug").agg(F.min_by("ats", "probe_rank").alias("ats"))
