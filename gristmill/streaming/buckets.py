"""A table kept in buckets of its key: generations of whole buckets, and the deltas of later batches.

    path/base/gen=G/bucket=B/    bucket B with everything of the batches up to G
    path/delta/batch=N/bucket=B/ what batch N has for bucket B

A bucket's rows are those of its newest generation and of the deltas after it. Folders count once they are complete, so
a batch that is repeated, or a compaction that broke off, changes nothing. The driver lists folders and never rows; a
compaction leaves one folder per bucket.
"""

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


@dataclass(frozen=True)
class BucketTable:
    """`schema` names the columns of a generation, `delta_schema` those of a delta. The number of buckets is part of the
    table: all its readers and writers give the same."""

    spark: SparkSession
    path: str
    schema: str
    delta_schema: str
    buckets: int = BUCKETS

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(key, F.lit(""))), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, key: Column) -> list[int]:
        """Buckets that the rows' keys are in: a number for each, at most."""
        return sorted(r[0] for r in rows.select(self.bucket(key)).distinct().collect())

    def write_generation(self, rows: DataFrame, key: Column, upto: int) -> None:
        self._write(rows, key, f"base/gen={upto:012d}")

    def write_delta(self, rows: DataFrame, key: Column, batch: int) -> None:
        self._write(rows, key, f"delta/batch={batch:012d}")

    def generations(self) -> dict[int, int]:
        """Newest generation of each bucket."""
        found: dict[int, int] = {}
        for gen in self._complete("base", "gen"):
            found |= dict.fromkeys(self._buckets_in(f"base/gen={gen:012d}"), gen)
        return found

    def batches(self, before: int | None = None) -> list[int]:
        """Complete deltas, in order."""
        return [n for n in self._complete("delta", "batch") if before is None or n < before]

    def pending(self, before: int | None = None) -> dict[int, list[int]]:
        """By bucket, the batches after its generation."""
        gens, found = self.generations(), {}
        for batch in self.batches(before):
            for bucket in self._buckets_in(f"delta/batch={batch:012d}"):
                if batch > gens.get(bucket, -1):
                    found.setdefault(bucket, []).append(batch)
        return found

    def base(self, buckets: Iterable[int] | None = None) -> DataFrame:
        gens = self.generations()
        wanted = gens if buckets is None else [b for b in buckets if b in gens]
        return self._read("base", [f"base/gen={gens[b]:012d}/bucket={b}" for b in wanted], self.schema, "gen BIGINT")

    def deltas(self, buckets: Iterable[int] | None = None, before: int | None = None) -> DataFrame:
        """Rows of the pending deltas, with `batch`."""
        pending = self.pending(before)
        wanted = pending if buckets is None else [b for b in buckets if b in pending]
        return self._read("delta", [f"delta/batch={n:012d}/bucket={b}" for b in wanted for n in pending[b]], self.delta_schema, "batch BIGINT")

    def compact(self, merged: Callable[[list[int], int], DataFrame], key: Column, before: int) -> list[int]:
        """Writes a new generation of every bucket with deltas of batches below `before`, which must be final; `merged` gives the
        rows of the buckets with those deltas. Other buckets are neither read nor written."""
        dirty = sorted(self.pending(before))
        if dirty:
            self.write_generation(merged(dirty, before), key, before - 1)
        return dirty

    def vacuum(self) -> None:
        """Deletes what newer generations replace. No reader of the older state may be left."""
        gens = self.generations()
        for gen in self._complete("base", "gen"):
            self._delete([f"base/gen={gen:012d}/bucket={b}" for b in self._buckets_in(f"base/gen={gen:012d}") if gens[b] > gen])
        for batch in self.batches():
            self._delete([f"delta/batch={batch:012d}/bucket={b}" for b in self._buckets_in(f"delta/batch={batch:012d}") if gens.get(b, -1) >= batch])

    def _write(self, rows: DataFrame, key: Column, folder: str) -> None:
        dealt = rows.withColumn("bucket", self.bucket(key)).repartition("bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.path}/{folder}")

    def _read(self, part: str, folders: list[str], schema: str, number: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], f"{schema}, {number}")
        names = [c.strip().split()[0] for c in f"{schema}, {number}".split(",")]
        read = self.spark.read.schema(f"{schema}, {number}, bucket INT").option("basePath", f"{self.path}/{part}")
        return read.parquet(*(f"{self.path}/{f}" for f in folders)).select(*names)

    def _hadoop(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self, folder: str, name: str) -> list[int]:
        fs, path = self._hadoop(folder)
        if not fs.exists(path):
            return []
        found = (re.fullmatch(rf"{name}=(\d+)", s.getPath().getName()) for s in fs.listStatus(path))
        return sorted(int(m.group(1)) for m in found if m)

    def _complete(self, part: str, name: str) -> list[int]:
        def done(n: int) -> bool:
            fs, path = self._hadoop(f"{part}/{name}={n:012d}/_SUCCESS")
            return fs.exists(path)

        return [n for n in self._numbers(part, name) if done(n)]

    def _buckets_in(self, folder: str) -> list[int]:
        return self._numbers(folder, "bucket")

    def _delete(self, folders: list[str]) -> None:
        for folder in folders:
            fs, path = self._hadoop(folder)
            fs.delete(path, True)
