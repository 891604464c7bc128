"""The two incremental jobs, with the batch operators inside foreachBatch.

State lives in bucketed tables (see buckets.py), not in the stream. A batch writes its own delta and reads, if it reads
at all, the buckets of its own keys; a repeated batch writes the same delta again, so a restart neither loses nor
doubles rows. A store belongs to one stream and its checkpoint, whose batch numbers name the deltas.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gristmill.functions.urls import url_key
from gristmill.operators import log as L
from gristmill.operators.dedup import dedup_by_url
from gristmill.streaming.buckets import BUCKETS, BucketTable

LOG_SCHEMA = "title STRING, company STRING, score INT, cover_letter STRING, fit_reason STRING, url STRING, status STRING, ord BIGINT"
_NAMES = [c.split()[0] for c in LOG_SCHEMA.split(", ")]
_COLUMNS = [c for c in _NAMES if c not in ("url", "ord")]


def log_store(spark: SparkSession, store: str, buckets: int = BUCKETS) -> BucketTable:
    """K1: a log by bucket of its url. Generations know the first row of each url; deltas hold one patch per url and batch."""
    return BucketTable(spark, store, f"{LOG_SCHEMA}, is_first BOOLEAN", f"{LOG_SCHEMA}, present ARRAY<STRING>", buckets)


def start_log(spark: SparkSession, base: DataFrame, store: str, buckets: int = BUCKETS) -> None:
    """K1: generation 0 of a log store."""
    log_store(spark, store, buckets).write_generation(L.mark_first(base.select(*_NAMES)), F.col("url"), 0)


def latest_snapshot(spark: SparkSession, store: str, before: int | None = None, buckets: int = BUCKETS) -> int | None:
    """Number of the last complete batch (below `before`) that the log holds, 0 for its start, None when there is none."""
    table = log_store(spark, store, buckets)
    numbers = [n for n in {*table.batches(), *table.generations().values()} if before is None or n < before]
    return max(numbers, default=None)


def _merged(table: BucketTable, buckets: list[int] | None, before: int | None) -> DataFrame:
    deltas = table.deltas(buckets, before)
    patches = L.combine_updates(deltas, _COLUMNS, order="batch")
    return L.apply_patches(table.base(buckets), patches, _COLUMNS)


def read_log(spark: SparkSession, store: str, buckets: int = BUCKETS, only: list[int] | None = None, before: int | None = None) -> DataFrame:
    """The log as of now, or as of the batches below `before`: generations with their pending patches. `only` names buckets to
    read. Buckets without a pending patch go into no join."""
    table = log_store(spark, store, buckets)
    dirty = sorted(table.pending(before))
    dirty = [b for b in dirty if only is None or b in set(only)]
    clean = table.base([b for b in (table.generations() if only is None else only) if b not in set(dirty)]).select(*_NAMES)
    return clean.unionByName(_merged(table, dirty, before).select(*_NAMES)) if dirty else clean


def read_snapshot(spark: SparkSession, store: str, schema=LOG_SCHEMA, before: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The log as of the batches below `before`."""
    return read_log(spark, store, buckets, before=before)


def compact_log(spark: SparkSession, store: str, before: int | None = None, buckets: int = BUCKETS) -> list[int]:
    """Merges the pending patches of batches below `before` (all complete ones) into new generations of their buckets. The first
    row of a url stays its first."""
    table = log_store(spark, store, buckets)
    before = before if before is not None else max(table.batches(), default=-1) + 1
    return table.compact(lambda dirty, end: _merged(table, dirty, end), F.col("url"), before)


def stream_upserts(updates: DataFrame, store: str, checkpoint: str, buckets: int = BUCKETS, compact_every: int | None = None) -> StreamingQuery:
    """K1 on a stream of JSON updates (body, ord): batch b leaves delta b + 1 with one patch per url, and reads nothing of
    the log. Updates apply in the order of batches, and of `ord` in a batch. Every `compact_every` batches the deltas of
    finished batches are merged. Runs what is available, then stops."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        table = log_store(batch.sparkSession, store, buckets)
        if compact_every and batch_id and batch_id % compact_every == 0:
            compact_log(batch.sparkSession, store, batch_id + 1, buckets)
        table.write_delta(L.combine_updates(L.parse_updates(batch), _COLUMNS), F.col("url"), batch_id + 1)

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()


def key_store(spark: SparkSession, out: str, buckets: int = BUCKETS) -> BucketTable:
    """The url keys that an ingest has taken in, beside its output; readers of the output don't see the folder."""
    return BucketTable(spark, f"{out}/_keys", "known STRING", "known STRING", buckets)


def known_keys(table: BucketTable, only: list[int] | None, before: int) -> DataFrame:
    return table.base(only).select("known").unionByName(table.deltas(only, before).select("known"))


def compact_keys(spark: SparkSession, out: str, before: int | None = None, buckets: int = BUCKETS) -> list[int]:
    """Merges the keys of batches below `before` into new generations of their buckets."""
    table = key_store(spark, out, buckets)
    before = before if before is not None else max(table.batches(), default=-1) + 1
    return table.compact(lambda dirty, end: known_keys(table, dirty, end), F.col("known"), before)


def ingest_batch(batch: DataFrame, batch_id: int, log: str, out: str, buckets: int = BUCKETS) -> None:
    """One batch of landed postings: the first row per url, without urls applied for or taken in by earlier batches, in folder
    batch=b of the output. Of the log and of the known keys, only the buckets of the batch's own urls are read. A missing
    or blank url is no key: such rows all stay, but a missing url that was applied for is left out as any other."""
    spark = batch.sparkSession
    first = dedup_by_url(batch).persist()
    try:
        url, key = F.col("url"), url_key(F.col("url"))
        fresh = L.without_applied(first, read_log(spark, log, buckets, only=log_store(spark, log, buckets).touched(first, url)))
        keys = key_store(spark, out, buckets)
        own = keys.touched(first.filter(key != ""), key)
        fresh = fresh.join(known_keys(keys, own, batch_id), key == F.col("known"), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        taken = spark.read.schema("url STRING").parquet(f"{out}/batch={batch_id}").select(key.alias("known")).filter("known <> ''")
        keys.write_delta(taken, F.col("known"), batch_id)
    finally:
        first.unpersist()


def stream_new_postings(postings: DataFrame, log_store: str, out: str, checkpoint: str, buckets: int = BUCKETS,
                        compact_every: int | None = None) -> StreamingQuery:
    """Landed postings, batch by batch (see ingest_batch). Every `compact_every` batches the keys of finished batches are merged."""
    def ingest(batch: DataFrame, batch_id: int) -> None:
        if compact_every and batch_id and batch_id % compact_every == 0:
            compact_keys(batch.sparkSession, out, batch_id, buckets)
        ingest_batch(batch, batch_id, log_store, out, buckets)

    return postings.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()
