"""Helpers of the operators: Arrow row functions, row keys, and tables staged in the shared folder.

A document is identified by ``_id`` (its id; a null id is the smallest number) and ``_tie`` (the 64-bit hash of its
text), so rows that share an id but not a text are told apart. Rows equal in both are taken to have the same text: among
a million rows of one id, two texts share a hash with a chance of about 3 in 100 million.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
    "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
    "array<double>": pa.list_(pa.float64()),
}
#: Rows taken out of an Arrow batch at a time, and rows put into one.
SLICE, FLUSH = 128, 1024
#: Arrow batches end after so many bytes of output.
FLUSH_BYTES = 8 << 20
#: A group is ranked in so many parts before it is ranked as a whole.
RANKED_PARTS = 256
NULL_ID = -(1 << 63)


def id_key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def tie_key(column: str) -> Column:
    return F.xxhash64(F.col(column))


def keyed(docs: DataFrame, id_column: str, text_column: str, *more: str) -> DataFrame:
    """(_id, _tie, _text, more...); a null text is empty. Other columns are left out, so none can clash."""
    return docs.select(id_key(id_column).alias("_id"), tie_key(text_column).alias("_tie"),
                       F.coalesce(F.col(text_column), F.lit("")).alias("_text"), *more)


def id_back(column: str = "_id") -> Column:
    """The document's id again: the key of a null id is null."""
    return F.when(F.col(column) != NULL_ID, F.col(column))


def batches_of(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(4 * len(v) if hasattr(v, "dtype") else len(v) for v in row if hasattr(v, "__len__"))
        if len(held) >= FLUSH or size >= FLUSH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def tuples(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield from zip(*(c.to_pylist() for c in batch.slice(start, SLICE).columns))


def map_rows(df: DataFrame, out: str, function: Callable[[Iterator[tuple]], Iterable[tuple]], read=tuples) -> DataFrame:
    """``function`` turns the rows of a partition, as a stream of tuples, into rows of the schema ``out``
    ("name type, ..."). Batches are cut by rows and bytes, so a task holds a few documents at a time."""
    fields = [f.strip().rsplit(" ", 1) for f in out.split(", ")]
    schema = pa.schema([(n, ARROW[t]) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(function(read(batches)), schema)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, out)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. A local session without it gets one beside its warehouse;
    a cluster must name one, since its machines share no local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return f"{warehouse}/_shared"


def staged(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """``df`` written as Parquet to a new folder below the shared one and read again: the lineage is cut, and
    the rows survive the loss of any executor."""
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hashed_sample(rows: DataFrame, group: str, size: int) -> DataFrame:
    """The ``size`` rows of each group with the smallest hashes of ``_id``, which is unique within a group. Parts of a group
    are ranked first, so no task ends up with more than RANKED_PARTS * ``size`` rows of a group, however large it is."""
    order = [F.xxhash64("_id"), F.col("_id")]
    part = F.pmod(F.hash("_id"), F.lit(RANKED_PARTS))
    first = (rows.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)))
             .filter(F.col("_rank") <= size).drop("_part", "_rank"))
    return (first.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
            .filter(F.col("_rank") <= size).drop("_rank"))


def spread(docs: DataFrame, column: str) -> DataFrame:
    """Rows dealt evenly over the session's shuffle partitions when the caller asks for it: a table in few
    files leaves cores idle in row-by-row work."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartition(n, F.xxhash64(column))
