"""Token ids in files of Simple-8b words (operator 8).

A file set is a Parquet table with one row per block. A block holds the ids of consecutive documents as 64-bit
words: the upper four bits of a word are its selector, which says how many ids of how many bits the lower sixty
hold. An id of more than sixty bits follows an escape word as a word of its own; ``escapes`` lists the places of
those. ``doc_ids`` and ``counts`` are the block's documents with their numbers of ids, so offsets inside a block
are running sums. ``part`` and ``block`` ascend with the document's id. Words of one selector are unpacked together.

The table is written by Spark's committer, so a task that is run again leaves one copy of its blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm.bpe import DEFAULT_VOCABULARY, encoded_rows
from gristmill.llm.rows import id_back, keyed, map_rows, shared_folder

# Ids in a word and bits of an id, by selector. Selector 1 is the escape.
COUNTS = [240, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
BITS = [0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
ESCAPE = 1
#: A block ends with the document that fills so many ids.
BLOCK_IDS = 1 << 16
SCHEMA = "part int, block int, n_ids long, doc_ids array<long>, counts array<long>, escapes array<int>, words binary"
_POWERS = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
_COUNTS = np.array(COUNTS, np.int64)
_COUNTS[ESCAPE] = 1
_WIDTHS = np.searchsorted(_POWERS, np.arange(1 << 17, dtype=np.uint64), side="right").astype(np.uint8)


def all_of_next(flags: np.ndarray, count: int) -> np.ndarray:
    """Whether each place and the ``count - 1`` after it are all set; places beyond the end count as set."""
    held, width = flags, 1
    while width < count:
        step = min(width, count - width)
        held = held & np.append(held[step:], np.ones(min(step, len(held)), bool))
        width += step
    return held


def pack(ids: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Words of the ids, and the places of those that stand alone after an escape."""
    ids, n = np.ascontiguousarray(ids, np.uint64), len(ids)
    if not n:
        return np.zeros(0, np.uint64), []
    bits = _WIDTHS[ids] if int(ids.max()) < len(_WIDTHS) else np.searchsorted(_POWERS, ids, side="right").astype(np.uint8)
    choice = np.where(bits > 60, ESCAPE, 15).astype(np.uint8)
    for s in range(14, -1, -1):
        if s == ESCAPE:
            continue
        fits = all_of_next(bits <= BITS[s], COUNTS[s])
        if not fits.any():
            break
        choice[fits] = s
    step = _COUNTS[choice].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts)
    chosen = choice[starts]
    slot = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(chosen == ESCAPE)[:-1]])
    words = np.zeros(len(starts) + int((chosen == ESCAPE).sum()), np.uint64)
    padded = np.concatenate([ids, np.zeros(max(COUNTS), np.uint64)])
    for s in np.unique(chosen).tolist():
        here = chosen == s
        if s == ESCAPE:
            words[slot[here]], words[slot[here] + 1] = np.uint64(ESCAPE << 60), ids[starts[here]]
            continue
        k = np.arange(COUNTS[s], dtype=np.int64)
        held = padded[starts[here][:, None] + k] << (k * BITS[s]).astype(np.uint64) if BITS[s] else np.zeros((1, 1), np.uint64)
        words[slot[here]] = np.bitwise_or.reduce(held, axis=1) | np.uint64(s << 60)
    return words, (slot[chosen == ESCAPE] + 1).tolist()


def unpack(words: np.ndarray, escapes: Iterable[int], n: int) -> np.ndarray:
    """The first ``n`` ids of the words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    alone = np.array(list(escapes), np.int64)
    counts = _COUNTS[selector]
    if len(alone):
        counts[alone], selector[alone] = 0, -1
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in set(selector.tolist()) - {-1}:
        here = np.flatnonzero(selector == s)
        first = ends[here] - counts[here]
        if s == ESCAPE:
            out[first] = words[here + 1]
        elif BITS[s]:
            k = np.arange(COUNTS[s], dtype=np.int64)
            mask = np.uint64((1 << BITS[s]) - 1)
            out[first[:, None] + k] = (words[here][:, None] >> (k * BITS[s]).astype(np.uint64)) & mask
    return out[:n]


def write_token_files(docs: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text",
                      path: str | None = None, end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Encodes every whole text (null: empty), ends each with ``end_id`` and writes the ids below ``folder`` in
    ascending order of the document's id; a null id comes first, rows of one id follow by the hash of their text."""
    path = path or public_tokenizers.path(DEFAULT_VOCABULARY)
    end = np.uint32(end_id).tobytes()

    def blocks(rows: Iterator[tuple]) -> Iterator[tuple]:
        part, block = TaskContext.get().partitionId(), 0
        ids, counts, held, size = [], [], [], 0

        def block_row() -> tuple:
            words, escapes = pack(np.frombuffer(b"".join(held), np.uint32))
            return part, block, size, list(ids), list(counts), escapes, words.tobytes()

        for i, _, encoded in rows:
            ids.append(i)
            counts.append(len(encoded) + 1)
            held += [encoded.tobytes(), end]
            size += counts[-1]
            if size >= block_ids:
                yield block_row()
                ids, counts, held, size, block = [], [], [], 0, block + 1
        if ids:
            yield block_row()

    ordered = keyed(docs, id_column, text_column).repartitionByRange("_id", "_tie").sortWithinPartitions("_id", "_tie")
    map_rows(ordered, SCHEMA, blocks, lambda batches: encoded_rows(batches, path)).write.option("compression", "none").parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, part, block, at, n_tokens, ids binary) of each document; ids are unsigned 32-bit little-endian, and
    ``at`` is the document's place in its block."""
    def documents(rows: Iterator[tuple]) -> Iterator[tuple]:
        for part, block, n, doc_ids, counts, escapes, words in rows:
            ids = unpack(np.frombuffer(words, np.uint64), escapes, n).astype("<u4")
            at = 0
            for i, count in zip(doc_ids, counts):
                yield i, part, block, at, count, ids[at:at + count].tobytes()
                at += count

    return map_rows(spark.read.schema(SCHEMA).parquet(folder),
                    "doc_id long, part int, block int, at long, n_tokens long, ids binary", documents
                    ).withColumn("doc_id", id_back("doc_id"))


def with_starts(spark: SparkSession, folder: str, documents: DataFrame) -> DataFrame:
    """Adds ``start``, the number of ids in the files before each document, to rows of ``read_token_files``: what stands
    in the parts and blocks before it. Parts are as many as the tasks that wrote; only their sums meet in one task.
    Leave out the ids first, as the rows are joined by part and block."""
    blocks = spark.read.schema(SCHEMA).parquet(folder).select("part", "block", "n_ids")
    before = lambda order: F.coalesce(F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("part_start"))
    starts = blocks.select("part", "block", before(Window.partitionBy("part").orderBy("block")).alias("block_start"))
    return (documents.join(starts.join(parts, "part"), ["part", "block"])
            .withColumn("start", F.col("part_start") + F.col("block_start") + F.col("at"))
            .drop("part", "block", "at", "part_start", "block_start"))


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
