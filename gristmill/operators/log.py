"""The application log: lookups and partial-merge upsert.

A log row has an `ord`, its place in the log; updates carry an `ord` after all rows of the base.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill import fixed_values as fv
from gristmill import schemas
from gristmill.functions import variants as V
from gristmill.functions.text import first_truthy
from gristmill.operators.dedup import first_per_key

#: Parts of a key whose rows are ranked apart.
SLOTS = 256


def applied_urls(log: DataFrame) -> DataFrame:
    """One row per applied url with the company of its first entry. Combines before the shuffle, so a
    url logged many times stays one row."""
    return log.filter(F.col("status") == "applied").groupBy("url").agg(F.min_by("company", "ord").alias("applied_company"))


def without_applied(postings: DataFrame, log: DataFrame) -> DataFrame:
    """Postings whose url is not applied for yet. A missing url equals a missing url."""
    done = applied_urls(log).select(F.col("url").alias("done_url"))
    return postings.join(done, F.col("url").eqNullSafe(F.col("done_url")), "left_anti")


def with_applied_company(postings: DataFrame, log: DataFrame) -> DataFrame:
    """D3, reporting form: adds `already_applied` and the company logged for it ('' if none)."""
    done = applied_urls(log).select(F.col("url").alias("done_url"), "applied_company", F.lit(True).alias("hit"))
    return postings.join(done, F.col("url").eqNullSafe(F.col("done_url")), "left").select(
        postings["*"], F.coalesce("hit", F.lit(False)).alias("already_applied"),
        F.when(F.col("hit"), F.col("applied_company")).otherwise(F.lit("")).alias("applied_company"))


def parse_updates(updates: DataFrame, body: str = "body", ord: str = "ord",
                  fields: Sequence = tuple(schemas.APP_LOG.fields)) -> DataFrame:
    """JSON updates as columns plus `present`, the names of the keys the record has. A key with a
    JSON null is present and overwrites."""
    record = F.try_parse_json(F.col(body))
    keys = F.json_object_keys(F.col(body))
    return updates.select(
        *[V.get(record, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in fields],
        F.coalesce(keys, F.array().cast("array<string>")).alias("present"), F.col(ord).alias("ord"))


def combine_updates(updates: DataFrame, columns: Sequence[str], key: str = "url", order: str = "ord") -> DataFrame:
    """One patch per key, in the shape of an update: for each column the last value given, by `order`, `present` for the
    columns that any update has, and the first `ord`. The updates of a hot key combine before the shuffle."""
    aggregates = []
    for name in columns:
        aggregates.append(F.expr(f"max_by({name}, {order}) FILTER (WHERE array_contains(present, '{name}'))").alias(name))
        aggregates.append(F.max(F.array_contains("present", name)).alias(f"has_{name}"))
    combined = updates.groupBy(key).agg(*aggregates, F.min("ord").alias("ord"))
    present = F.array_compact(F.array(*[F.when(F.col(f"has_{c}"), F.lit(c)) for c in columns]))
    return combined.select(key, *columns, present.alias("present"), "ord")


def _with_slots(base: DataFrame, key: str) -> DataFrame:
    """Where rows with `is_first` meet patches: the first row of a key in slot -1, others spread by their `ord`."""
    slot = F.when(F.col("is_first"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("ord"), F.lit(SLOTS)).cast("int"))
    return base.withColumns({"_key": F.coalesce(F.col(key), F.lit("")), "_none": F.col(key).isNull(), "_slot": slot})


def _ranked(base: DataFrame, key: str) -> DataFrame:
    """The base with `is_first` and slots. Rows of a key are ranked in SLOTS parts, then the first of each part, in slot -1,
    once more, so a key that holds a third of all rows is in no single task."""
    order = Window.partitionBy("_key", "_none", "_slot").orderBy("ord")
    parts = _with_slots(base.withColumn("is_first", F.lit(False)), key).withColumn("_place", F.row_number().over(order))
    parts = parts.withColumn("_slot", F.when(F.col("_place") == 1, F.lit(-1)).otherwise(F.col("_slot")))
    return parts.withColumn("is_first", (F.row_number().over(order) == 1) & (F.col("_slot") == -1)).drop("_place")


def mark_first(base: DataFrame, key: str = "url") -> DataFrame:
    """Adds `is_first`: whether the row has the least `ord` of its key; a missing key is a key."""
    return _ranked(base, key).drop("_key", "_none", "_slot")


def _patched(slotted: DataFrame, patches: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    left = slotted.select(F.struct(key, *columns, "ord").alias("_old"), "_key", "_none", "_slot", "is_first")
    # A literal would be taken out of the join's keys, and rows of one key would no longer be spread.
    first = F.when(F.col("ord").isNull(), F.lit(-2)).otherwise(F.lit(-1))
    right = patches.select(F.struct(key, *columns, "present", "ord").alias("_new"), F.coalesce(F.col(key), F.lit("")).alias("_to_key"),
                           F.col(key).isNull().alias("_to_none"), first.alias("_to_slot"))
    met = [F.col(f"_{c}") == F.col(f"_to_{c}") for c in ("key", "none", "slot")]
    joined = left.join(right, [*met, F.col("is_first")], "full_outer")
    is_new = F.col("_old").isNull()

    def merged(name: str) -> Column:
        given = F.coalesce(F.array_contains("_new.present", name), F.lit(False))
        return F.when(is_new | given, F.col(f"_new.{name}")).otherwise(F.col(f"_old.{name}")).alias(name)

    return joined.select(F.when(is_new, F.col(f"_new.{key}")).otherwise(F.col(f"_old.{key}")).alias(key), *map(merged, columns),
                         F.coalesce("_old.ord", "_new.ord").alias("ord"), F.coalesce("is_first", F.lit(True)).alias("is_first"))


def apply_patches(base: DataFrame, patches: DataFrame, columns: Sequence[str], key: str = "url") -> DataFrame:
    """The base (with `is_first`) and its patches (see combine_updates) in one full outer join: a patch meets the first row
    of its key, or none and is a new row, the first of its key."""
    return _patched(_with_slots(base, key), patches, columns, key)


def upsert(base: DataFrame, updates: DataFrame, columns: Sequence[str] | None = None, key: str = "url") -> DataFrame:
    """Each update overwrites, in order, the columns it has, in the first base row with its key; a new key appends a
    row. Base rows keep their `ord`; a new row takes that of its first update.

    `base` has `ord`, which identifies a row, and the columns; `updates` also has `present` (see parse_updates). Both are
    read once. The whole base is shuffled, to find the first rows of its keys: a log that takes many small batches is kept in
    a store that knows them (streaming.incremental).
    """
    columns = list(columns or [c for c in base.columns if c not in (key, "ord")])
    slotted = _ranked(base.select(key, *columns, "ord"), key)
    return _patched(slotted, combine_updates(updates, columns, key), columns, key).drop("is_first")


def fill_from_scraped(postings: DataFrame, scraped: DataFrame, columns: Sequence[str] = (
        "title", "company", "description", "location", "source")) -> DataFrame:
    """Rows with a short description take each scraped value that is neither empty nor
    Unknown. A url scraped more than once gives its first row: by `ord` if there is one, else by value."""
    order = [F.col(c) for c in (["ord"] if "ord" in scraped.columns else []) + list(columns)]
    found = first_per_key(scraped, [F.col("url")], order).select(F.col("url").alias("scraped_url"), *[F.col(c).alias(f"scraped_{c}") for c in columns])
    needs = F.length(F.coalesce("description", F.lit(""))) < fv.MIN_DESCRIPTION
    joined = postings.join(found, needs & (F.col("url") == F.col("scraped_url")), "left")

    def taken(name: str) -> Column:
        value = F.col(f"scraped_{name}")
        return F.when(first_truthy(value, default="Unknown") != "Unknown", value).otherwise(F.col(name))

    return joined.select(*[taken(c).alias(c) if c in columns else F.col(c) for c in postings.columns])
