"""First-wins deduplication in arrival order.

Both operators filter on row_number() = 1, which Spark turns into a group limit before the shuffle:
each task sends at most one row per key, so a key that holds a third of all rows costs no more than
any other.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.functions.urls import url_key


def first_per_key(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row per key. Rows with equal key and order cannot be told apart: give an order
    that is unique within the key."""
    names = [f"_key_{i}" for i in range(len(keys))]
    keyed = rows.select("*", *[k.alias(n) for k, n in zip(keys, names)])
    window = Window.partitionBy(*names).orderBy(*order)
    return keyed.withColumn("_place", F.row_number().over(window)).filter("_place = 1").drop("_place", *names)


def dedup_by_url(postings: DataFrame, url: str = "url", source_rank: str = "source_rank",
                 ord: str = "ord") -> DataFrame:
    """First row per trimmed url; rows without a url all stay. (source_rank, ord) is the arrival
    order and identifies a row; rows without a url use it as their key, which also spreads them."""
    key = url_key(F.col(url))
    alone = key == ""
    return first_per_key(
        postings,
        [key, F.when(alone, F.col(source_rank)), F.when(alone, F.col(ord))],
        [F.col(source_rank), F.col(ord)],
    )


def dedup_by_posting(postings: DataFrame, title: str = "title", company: str = "company", ord: str = "ord",
                     missing: dict[str, str] | None = None) -> DataFrame:
    """First row per title and company, ignoring case. A NULL stands for an explicit null in the
    record and reads 'none'; name a boolean column in `missing` to mark absent fields, which read ''."""
    def key(name: str) -> Column:
        explicit = F.lower(F.coalesce(F.col(name), F.lit("none")))
        absent = (missing or {}).get(name)
        return F.when(F.col(absent), F.lit("")).otherwise(explicit) if absent else explicit

    return first_per_key(postings, [key(title), key(company)], [F.col(ord)])
