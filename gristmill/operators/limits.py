"""Order, caps and unions."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_sources(*sources: DataFrame) -> DataFrame:
    """Bag union by column name. Each source carries its own source_rank."""
    return reduce(lambda a, b: a.unionByName(b), sources)


def one_row(*parts: DataFrame) -> DataFrame:
    """One-row tables with different columns side by side, gathered without a join."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return union.agg(*[F.any_value(F.col(c), True).alias(c) for c in union.columns])


def first_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in arrival order."""
    return rows.orderBy(*[F.col(c) for c in order]).limit(n)


def by_score(rows: DataFrame, score: str, ord: str = "ord") -> DataFrame:
    """L3: best first, ties in input order."""
    return rows.orderBy(F.desc(score), ord)


def counts_per_source(rows: DataFrame) -> DataFrame:
    """Rows per source."""
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
