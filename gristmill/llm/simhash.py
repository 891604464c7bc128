"""SimHash fingerprints and near-duplicate components (operator 2).

Fingerprints are compared exactly, in tiles. A tile holds up to ``TILE`` different fingerprints whose four 16-bit
quarters have the same population counts; two fingerprints within the radius have counts that differ by no more than
the radius in all, so only tiles of such counts meet, and the rest are skipped. A pair of tiles is compared with numpy
exclusive-or and bit counts, block by block. Of the links inside a pair of tiles only a spanning forest leaves the
task: it joins the same texts, and a dense group of near copies gives as many links as members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.components import components
from gristmill.llm.rows import id_back, keyed, map_rows, staged

WORDS, SEED, RADIUS, TILE = 3, 42, 2, 2048
_BLOCK = 256


def shingle_hashes(text: str, words: int = WORDS) -> list[int]:
    """Hashes of the shingles in order; a text of fewer words is one, and none is without a word. Bytes serve: they
    lower and split exactly at A-Z and the ASCII blanks."""
    found = text.encode().lower().split()
    if not found:
        return []
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(found), SEED)]
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = [0, *(ends[:-words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1:].tolist())]


def fingerprint(text: str, words: int = WORDS) -> int:
    """64 bits, each set if it is set in over half the hashes of the shingles; 0 without a word."""
    hashes = shingle_hashes(text, words)
    if not hashes:
        return 0
    held = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for start in range(0, len(held), 4096):
        counts += np.unpackbits(held[start:start + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes())


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS) -> DataFrame:
    """(_id, _tie, fp): the fingerprint as a signed 64-bit number. A null text has no words."""
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for i, t, text in rows:
            fp = fingerprint(text, words)
            yield i, t, fp - (fp >> 63 << 64)

    return map_rows(keyed(docs, id_column, text_column), "_id long, _tie long, fp long", run)


def population(fp: Column) -> Column:
    """Population counts of the four quarters, as the digits of one number."""
    quarters = [F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
    return sum((q * 32 ** k for k, q in enumerate(quarters)), F.lit(0)).cast("int")


def neighbour_steps(radius: int) -> list[int]:
    """Differences between the numbers of a population and a later or equal one within the radius."""
    steps = (sum(d * 32 ** k for k, d in enumerate(ds)) for ds in product(range(-radius, radius + 1), repeat=4)
             if sum(map(abs, ds)) <= radius)
    return sorted(s for s in steps if s >= 0)


def forest(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over the pairs within the radius. Rounds of least labels: every node takes the least
    label among its links, and a link that lowered one is kept."""
    nodes, pairs = np.concatenate([left, right]), []
    for start in range(0, len(left), _BLOCK):
        near = np.bitwise_count(left[start:start + _BLOCK, None] ^ right[None, :]) <= radius
        a, b = np.nonzero(near)
        if len(a):
            pairs.append(_spanning(nodes, a + start, b + len(left)))
    if not pairs:
        return []
    a, b = (np.concatenate(x) for x in zip(*pairs))
    a, b = _spanning(nodes, a, b)
    return [(int(x), int(y)) for x, y in zip(nodes[a].view(np.int64), nodes[b].view(np.int64)) if x != y]


def _spanning(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links a-b that a union-find needs; the same value on either side is one node."""
    values, which = np.unique(nodes, return_inverse=True)
    parent = list(range(len(values)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for k, (x, y) in enumerate(zip(which[a].tolist(), which[b].tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(k)
    return a[keep], b[keep]


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b) over different fingerprints ``fp``: the same components as all pairs within the radius."""
    cells = distinct.select("fp", population(F.col("fp")).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("parts"))  # 17^4 cells at most
    dealt = cells.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    tiles = staged(dealt.groupBy("cell", "part").agg(F.collect_list("fp").alias("fps")))
    later = tiles.select(F.explode(F.array(*(F.lit(s) for s in neighbour_steps(radius)))).alias("step"), "cell", "part", "fps")
    left = later.select((F.col("cell") + F.col("step")).alias("other"), F.col("cell").alias("from_cell"), F.col("part").alias("from_part"), F.col("fps").alias("left"))
    right = tiles.select(F.col("cell").alias("other"), F.col("part").alias("to_part"), F.col("fps").alias("right"))
    met = left.join(right, "other").filter((F.col("from_cell") != F.col("other")) | (F.col("from_part") <= F.col("to_part")))

    def compare(rows: Iterator[tuple]) -> Iterator[tuple]:
        for a, b in rows:
            yield from forest(np.array(a, np.int64).view(np.uint64), np.array(b, np.int64).view(np.uint64), radius)

    return map_rows(met.select("left", "right"), "a long, b long", compare)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS,
                    radius: int = RADIUS) -> DataFrame:
    """(_id, _tie, fp, component, root): component is the least id that links of fingerprints reach, root the component's
    own key, its least fingerprint, which tells components of the same or no id apart.

    Every row is a document; texts without words have fingerprint zero and are linked like any other. A null id counts
    as smaller than any other and doesn't name a component that has another id. Equal rows have equal results.
    """
    marked = staged(fingerprints(docs, id_column, text_column, words))
    least = marked.groupBy("fp").agg(F.min(id_back()).alias("least"))
    found = components(links(least.select("fp"), radius))
    named = (least.join(found, F.col("fp") == F.col("node"), "left")
             .select("fp", "least", F.coalesce("component", "fp").alias("component")))
    names = named.groupBy("component").agg(F.min("least").alias("name"))
    by_print = named.join(names, "component").select("fp", F.col("name").alias("component"), F.col("component").alias("root"))
    return marked.join(by_print, "fp").select("_id", "_tie", "fp", "component", "root")
