"""Repeated byte strings (operator 9): matching of sampled fingerprints up to a threshold length.

Named strings grow from a seed of two fifths of the threshold to all of it, and only what shares a name goes on. Names
are taken from the text in every round, none from the names of the round before:

1. *Seeds.* Every string of the threshold's length holds a sampled place (a minimum of the rolling hash among the seeds
   inside it), so only sampled places are ranked first: about 3 % of all bytes. Spark sorts (name of the seed, name of
   its neighbourhood, document, place); a neighbourhood is all that strings holding that seed can reach. A seed that is
   alone is unique, and its place drops out. A place whose whole neighbourhood stands earlier in the order is past the
   threshold on both sides: all its strings are repeats. Left are the first places of each neighbourhood among several
   that share a seed.
2. *Groups.* The strings around those places go in groups of ``GROUP`` neighbouring starts. Spark sorts (name of what a
   group's strings have in common, name of all they reach, document, place), and the same three cases follow.
3. *Strings.* The strings of the groups that are left get the pair of ranks (half at i, half at i + threshold / 2), and
   equal pairs meet; all but the first are repeats.

Names are 64-bit rolling hashes, so a pair has 128 bits. The sorts are by key, document and place, so a passage that a
third of all documents share is spread over many tasks; the last step takes minima before its shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.rows import id_back, keyed, map_rows, staged

THRESHOLD = 100
#: Neighbouring starts that are ranked together in the second round.
GROUP = 8
FLUSH_PLACES = 1 << 18


def _odd_inverse(x: int) -> int:
    y = x
    for _ in range(6):
        y = y * (2 - x * y) & 0xFFFFFFFFFFFFFFFF
    return y


class Rolling:
    """Names of substrings: sum of T[b] * B^k over the bytes, modulo 2^64, brought to the same power and mixed. B is
    odd, so its powers have inverses."""

    def __init__(self, seed: int):
        random = np.random.default_rng(seed)
        self.table = random.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.base = int(random.integers(0, 1 << 64, dtype=np.uint64)) | 5
        self.powers, self.inverses = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            size = max(n, 2 * len(self.powers))
            for name, x in (("powers", self.base), ("inverses", _odd_inverse(self.base))):
                steps = np.full(size, x, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[:len(data)], out=out[1:])
        return out

    def names(self, sums: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        held = (sums[ends] - sums[starts]) * (self.inverses[:len(sums)] if len(self.inverses) >= len(sums) else self.inverses)[starts]
        held ^= held >> np.uint64(32)
        held *= np.uint64(0xD6E8FEB86659FD93)
        return held ^ held >> np.uint64(32)


FIRST, SECOND = Rolling(1), Rolling(2)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, values.max(), values.dtype)
    padded[:len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def sampled(names: np.ndarray, width: int) -> np.ndarray:
    """Places that are the minimum of some ``width`` neighbouring names; all places of a tie."""
    order = (names >> np.uint64(32)).astype(np.uint32)
    lows = sliding_minimum(order, width)
    # The largest of the minima that a place takes part in is its own value if it is one of them.
    edges = np.zeros(width - 1, np.uint32)
    highest = ~sliding_minimum(~np.concatenate([edges, lows, edges]), width)
    return np.flatnonzero(highest == order)


def cut_names(sums: np.ndarray, low: np.ndarray, high: np.ndarray, n: int, wanted: int) -> np.ndarray:
    """Names of [low, high) as far as the document reaches; one that its end cuts isn't equal to another."""
    a, b = np.maximum(low, 0), np.minimum(high, n)
    cut = ((a - low) * (wanted + 1) + (high - b)).astype(np.uint64)
    return SECOND.names(sums, a, b) + cut * np.uint64(0x9E3779B97F4A7C15)


class Ladder:
    """Lengths of the rounds for a threshold."""

    def __init__(self, threshold: int):
        self.length, self.seed, self.half = threshold, 2 * threshold // 5, threshold // 2
        self.reach = self.length - self.seed  # starts before a place whose strings hold its seed

    def places(self, data: np.ndarray) -> tuple:
        """(names of the seeds, names of the neighbourhoods, offsets) of a document's sampled places."""
        n = len(data)
        sums = FIRST.sums(data)
        names = FIRST.names(sums, slice(0, n - self.seed + 1), slice(self.seed, n + 1))
        at = sampled(names, self.reach + 1)
        around = cut_names(SECOND.sums(data), at - self.reach, at + self.length, n, self.length + self.reach)
        return names[at], around, at

    def groups(self, data: np.ndarray, at: np.ndarray) -> tuple:
        """(names in common, names of all, first start, number of starts) of the groups around places."""
        n = len(data)
        back, place = (x.ravel() for x in np.meshgrid(np.arange(0, self.reach + 1, GROUP), at, indexing="ij"))
        far = np.minimum(back + GROUP - 1, self.reach)
        common = FIRST.names(FIRST.sums(data), np.maximum(place - back, 0), np.minimum(place + self.length - far, n))
        all_of = cut_names(SECOND.sums(data), place - far, place + self.length - back, n, self.length + self.reach)
        first, last = np.maximum(place - far, 0), np.minimum(place - back, n - self.length)
        whole = (last >= first)
        return common[whole], all_of[whole], first[whole], (last - first + 1)[whole]

    def strings(self, data: np.ndarray, spans: np.ndarray) -> tuple:
        """(first rank, second rank, start) of every string of the groups."""
        starts = np.unique(np.concatenate([np.arange(x >> SPAN_BITS, (x >> SPAN_BITS) + (x & _SPAN)) for x in spans.tolist()]))
        sums = FIRST.sums(data)
        return (FIRST.names(sums, starts, starts + self.half), FIRST.names(sums, starts + self.half, starts + 2 * self.half), starts)


#: Bits below an offset that hold a number of starts or bytes.
SPAN_BITS = 16
_SPAN = (1 << SPAN_BITS) - 1
_RANKS = "one long, two long, _id long, _tie long, place long"
_SCHEMA = {n: pa.schema([(c, pa.int64()) for c in ("one", "two", "_id", "_tie", "place", "starts")[:n]]) for n in (5, 6)}


def _columns(parts: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], schema=schema)


def ranks_of(ladder: Ladder, kind: str):
    """Arrow function from documents, with a list of places or groups after the first round, to rows of ranks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                for i, t, text, *at in zip(*(c.to_pylist() for c in batch.slice(start, 64).columns)):
                    data = np.frombuffer(text.encode(), np.uint8)
                    if len(data) < ladder.length:
                        continue
                    one, two, offsets, *more = getattr(ladder, kind)(data, *(np.unique(np.array(x, np.int64)) for x in at))
                    document = (np.full(len(offsets), x, np.int64) for x in (i, t))
                    held.append((one.view(np.int64), two.view(np.int64), *document, offsets, *more))
                    size += len(offsets)
                if size >= FLUSH_PLACES:
                    yield _columns(held, _SCHEMA[len(held[0])])
                    held, size = [], 0
        if held:
            yield _columns(held, _SCHEMA[len(held[0])])

    return run


WHOLE, TEST = 0, 1


def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (one, two, document, place): WHOLE for a place whose pair stands earlier, TEST for the first
    place of a pair whose ``one`` has several. The runs at either end of a task can go on in another, so their first
    places are tested whatever follows. Between batches one row is kept."""
    last = None       # the last row seen
    first_run = None  # ``one`` of the task's first run
    held = None       # first row of the latest pair, and whether it was given out
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy() for c in batch.columns]
        one = rows[0]
        if first_run is None:
            first_run = one[0]
        before = [np.concatenate([c[:1] if last is None else [last[k]], c[:-1]]) for k, c in enumerate(rows)]
        same = (one == before[0]) & (rows[1] == before[1])
        if last is None:
            same[0] = False
        repeated = same & np.logical_or.reduce([rows[k] != before[k] for k in (2, 3, 4)])  # an equal row is the same place
        heads = np.flatnonzero(~same)
        out = [[c[repeated] for c in rows[2:]] + [np.full(int(repeated.sum()), WHOLE, np.int64)]]
        firsts = [c[heads] for c in rows]
        given = np.zeros(len(heads), bool)
        if held:
            firsts = [np.concatenate([[x], c]) for x, c in zip(held[0], firsts)]
            given = np.concatenate([[held[1]], given])
        if len(given):
            run = firsts[0]
            shared = run == first_run
            shared[1:] |= run[1:] == run[:-1]
            shared[:-1] |= run[:-1] == run[1:]
            now = shared & ~given
            out.append([c[now] for c in firsts[2:]] + [np.full(int(now.sum()), TEST, np.int64)])
            held = [c[-1] for c in firsts], bool(shared[-1] or given[-1])
        last = [c[-1] for c in rows]
        yield _found(out)
    if held and not held[1]:
        yield _found([[np.array([x]) for x in held[0][2:]] + [np.array([TEST])]])


def _found(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    columns = [pa.array(np.concatenate(c)) for c in zip(*parts)]
    names = ["_id", "_tie", "place", "starts"][:len(columns) - 1] + ["kind"]
    return pa.RecordBatch.from_arrays([c.cast(pa.int8()) if n == "kind" else c for n, c in zip(names, columns)], names=names)


def covered(n: int, spans: list[int]) -> np.ndarray:
    """Which of n bytes lie in one of the spans (offset, then length)."""
    edge = np.zeros(n + 1, np.int64)
    spans = np.array(spans, np.int64)
    np.add.at(edge, spans >> SPAN_BITS, 1)
    np.add.at(edge, np.minimum((spans >> SPAN_BITS) + (spans & _SPAN), n), -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary): every byte that a string of ``threshold`` bytes covers which
    also starts earlier, by document and offset, is removed.

    ``threshold`` is even, from 10 to 32,000. A null text is empty. A null id comes first; rows that share an id follow
    by the hash of their text; equal rows are one document, none of which is earlier than the other.
    """
    if threshold % 2 or not 10 <= threshold <= 32_000:
        raise ValueError("the threshold is an even number of bytes from 10 to 32,000")
    ladder = Ladder(threshold)
    source = keyed(docs, id_column, text_column)
    where = "_id", "_tie", "place"
    order = "one", "two", *where
    offset = F.col("place")
    span = lambda start, size: F.shiftleft(start, SPAN_BITS).bitwiseOR(size.cast("long"))

    def by_document(rows: DataFrame, value) -> DataFrame:
        return rows.groupBy("_id", "_tie").agg(F.collect_list(value).alias("at"))

    seeds = staged(source.mapInArrow(ranks_of(ladder, "places"), _RANKS).orderBy(*order).mapInArrow(ranked, "_id long, _tie long, place long, kind byte"))
    # From here on it is one plan, in which the texts are dealt out once and meet what is asked of them three times.
    near = source.join(by_document(seeds.filter(F.col("kind") == TEST), offset), ["_id", "_tie"])
    groups = (near.select("_id", "_tie", "_text", "at").mapInArrow(ranks_of(ladder, "groups"), _RANKS + ", starts long")
              .orderBy(*order).mapInArrow(ranked, "_id long, _tie long, place long, starts long, kind byte"))
    tests = by_document(groups.filter(F.col("kind") == TEST), span(offset, F.col("starts")))
    strings = source.join(tests, ["_id", "_tie"]).select("_id", "_tie", "_text", "at").mapInArrow(ranks_of(ladder, "strings"), _RANKS)
    earliest = strings.groupBy("one", "two").agg(F.min(F.struct(*where)).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = strings.join(earliest.select("one", "two", "first"), ["one", "two"]).filter(F.struct(*where) != F.col("first"))

    start = F.greatest(offset - ladder.reach, F.lit(0))
    spans = (seeds.filter(F.col("kind") == WHOLE).select(*where, span(start, offset + ladder.length - start).alias("span"))
             .unionByName(groups.filter(F.col("kind") == WHOLE).select(*where, span(offset, F.col("starts") + ladder.length - 1).alias("span")))
             .unionByName(again.select(*where, span(offset, F.lit(ladder.length)).alias("span"))))
    marks = by_document(spans, F.col("span"))

    def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
        for i, text, at in rows:
            raw = text.encode()
            if not at:
                yield i, len(raw), 0, 0, raw
                continue
            gone = covered(len(raw), at)
            runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            yield i, len(raw), int(gone.sum()), runs, np.frombuffer(raw, np.uint8)[~gone].tobytes()

    joined = source.join(marks, ["_id", "_tie"], "left").select("_id", "_text", "at")
    return map_rows(joined, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary",
                    cut).withColumn("doc_id", id_back("doc_id"))
