"""Ranked lexical search (operator 12).

The terms of a block of items form one Aho-Corasick automaton, each term between two blanks. A document's bytes are
mapped so that everything but term characters is a blank, so the automaton counts whole terms straight from the text
and no index of the documents exists. The first scan sums document frequencies and lengths; the second scores each
document with the weights known, and each task keeps its ``k`` best per item. A block holds items of at most
``BLOCK_BYTES`` of terms (or a single item), whatever the number of items; every block scans the documents anew.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.rows import id_back, keyed, map_rows

K, BLOCK_BYTES, BLOCK_ITEMS, LONGEST = 50, 4 << 20, 4096, 256
# Term characters, and the constants of the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAIN, SLOPE, LENGTH, SHARE = 1_000_000_000, 1000, 20, 50
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_BATCH = 64


def terms(text: Column) -> Column:
    """The different terms of a text; none for a null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0)))


class Automaton:
    """Counts the terms in a text. A term of over ``LONGEST`` characters enters with its beginning alone, as the depth of
    the automaton is that of its longest word; where that is met, the text is compared with the whole term."""

    def __init__(self, terms: list[str]):
        self.terms, self.begun = terms, {}
        self.words = ahocorasick.Automaton()
        for k, term in enumerate(terms):
            if len(term) <= LONGEST:
                self.words.add_word(f" {term} ", k)
            else:
                self.begun.setdefault(f" {term[:LONGEST]}", []).append(k)
        for number, word in enumerate(self.begun):
            self.words.add_word(word, -1 - number)
        self.words.make_automaton()
        self.long = list(self.begun.values())

    def count(self, text: str) -> tuple[int, Counter]:
        """Number of a text's terms, and how often it has each of these."""
        raw = b" " + text.encode().translate(_TERM_BYTES) + b" "
        blank = np.frombuffer(raw, np.uint8) == 32
        n = int(np.count_nonzero(blank[:-1] & ~blank[1:]))
        if not n or not self.terms:
            return n, Counter()
        guarded = raw.decode()
        found = Counter(map(itemgetter(1), self.words.iter(guarded)))
        if self.long and min(found, default=0) < 0:
            for end, k in self.words.iter(guarded):
                if k < 0:
                    found.update(x for x in self.long[-1 - k] if guarded.startswith(f"{self.terms[x]} ", end + 1 - LONGEST))
            found = Counter({k: n for k, n in found.items() if k >= 0})
        return n, found


class Block:
    """Items whose terms share an automaton: ``names``, the different ``terms``, and by term the items that have it."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.names = np.array([i for i, _ in items], np.int64)
        self.terms = list(dict.fromkeys(t for _, ts in items for t in ts))
        place = {t: k for k, t in enumerate(self.terms)}
        pairs = sorted((place[t], k) for k, (_, ts) in enumerate(items) for t in ts)
        self.items = np.array([k for _, k in pairs], np.int64)
        self.starts = np.searchsorted([t for t, _ in pairs], np.arange(len(self.terms) + 1))

    def automaton(self) -> Automaton:
        return Automaton(self.terms)


def blocks(items: DataFrame, id_column: str, text_column: str, block_bytes: int, block_items: int) -> Iterator[Block]:
    """The items, in order of id and text, in blocks. The driver holds a block at a time."""
    rows = keyed(items, id_column, text_column).orderBy("_id", "_tie").select("_id", terms(F.col("_text")).alias("terms"))
    held, size = [], 0
    for name, found in rows.toLocalIterator(prefetchPartitions=False):
        if not found:
            continue
        more = sum(len(t.encode()) for t in found)
        if held and (size + more > block_bytes or len(held) >= block_items):
            yield Block(held)
            held, size = [], 0
        held.append((name, found))
        size += more
    if held:
        yield Block(held)


def _frequencies(docs: DataFrame, block: Block) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that have each term of the block."""
    n_terms = len(block.terms)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        automaton, sums = block.automaton(), np.zeros(n_terms + 2, np.int64)
        for _, _, text in rows:
            n, found = automaton.count(text)
            if found:
                sums[np.fromiter(found, np.int64, len(found))] += 1
            sums[n_terms:] += (n > 0, n)
        for k in np.flatnonzero(sums).tolist():
            yield k, int(sums[k])

    out = np.zeros(n_terms + 2, np.int64)
    for k, n in map_rows(docs, "term long, n long", run).groupBy("term").agg(F.sum("n")).collect():  # a row a term of the block
        out[k] = n
    return int(out[-2]), int(out[-1]), out[:-2]


class _Best:
    """The ``k`` best (score, id, tie) of every item among the rows put in."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.kept: list[np.ndarray] = []
        self.size, self.room = 0, 1 << 16

    def put(self, scores: np.ndarray, ids: list[tuple[int, int]]) -> None:
        row, item = np.nonzero(scores >= self.least)
        if len(row):
            names = np.array(ids, np.int64)[row]
            self.kept.append(np.stack([item, -scores[row, item], names[:, 0], names[:, 1]]))
            self.size += len(row)
            if self.size > self.room:
                self.cut()

    def cut(self) -> np.ndarray:
        rows = np.concatenate(self.kept, axis=1) if self.kept else np.zeros((4, 0), np.int64)
        rows = rows[:, np.lexsort(rows[::-1])]
        place = np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0])
        rows, place = rows[:, place < self.k], place[place < self.k]
        last = place == self.k - 1
        self.least[rows[0, last]] = -rows[1, last]
        self.kept, self.size = [rows], rows.shape[1]
        self.room = max(self.room, 2 * self.size)
        return rows


def _scored(docs: DataFrame, block: Block, n_docs: int, n_all: int, df: np.ndarray, k: int) -> DataFrame:
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        automaton, best = block.automaton(), _Best(len(block.names), k)
        scores, ids = np.zeros((_BATCH, len(block.names)), np.int64), []
        for i, tie, text in rows:
            n, found = automaton.count(text)
            if not found:
                continue
            t, tf = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
            m = 100 - SHARE + SHARE * n * n_docs // n_all
            gain = weights[t] * (GAIN * tf // (SLOPE * tf + LENGTH * m))
            begin, many = block.starts[t], block.starts[t + 1] - block.starts[t]
            # Places of all the items of all the terms found, one after the other.
            place = np.arange(many.sum()) + np.repeat(begin - np.cumsum(many) + many, many)
            np.add.at(scores[len(ids)], block.items[place], np.repeat(gain, many))
            ids.append((i, tie))
            if len(ids) == _BATCH:
                best.put(scores, ids)
                scores[:], ids = 0, []
        if ids:
            best.put(scores[:len(ids)], ids)
        for item, low, i, tie in best.cut().T.tolist():
            yield item, int(block.names[item]), i, tie, -low

    return map_rows(docs, "item long, item_id long, _id long, _tie long, score long", run)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, id_column: str = "doc_id", text_column: str = "text", item_id_column: str = "item_id",
                   item_text_column: str = "text", block_bytes: int = BLOCK_BYTES, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item, the ``k`` documents that score highest, above 0, from rank 1.

    Equal scores are ranked by id, a null id first, then by the hash of the text; equal rows are documents of their own and
    get ranks of their own. Every row of the items is an item, also with a repeated or null id. A null or empty text has no
    terms: such an item has no rows, such a document counts nowhere. Other columns are left out.
    """
    spark = docs.sparkSession
    texts = keyed(docs, id_column, text_column)
    out = None
    for number, block in enumerate(blocks(items, item_id_column, item_text_column, block_bytes, block_items)):
        n_docs, n_all, df = _frequencies(texts, block)
        if n_docs:
            found = _scored(texts, block, n_docs, n_all, df, k).withColumn("block", F.lit(number))
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id BIGINT, rank INT, doc_id BIGINT, score BIGINT")
    window = Window.partitionBy("block", "item").orderBy(F.desc("score"), "_id", "_tie")
    return out.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k).select(
        id_back("item_id").alias("item_id"), "rank", id_back().alias("doc_id"), "score")
