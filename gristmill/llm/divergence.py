"""Source divergence audit (operator 11).

Terms are counted by length-bucketed packing. A task reads its documents' bytes in blocks: terms of up to 8 bytes become
one uint64 and those of up to 16 two, which a radix sort by 16-bit digits brings together so that runs can be counted;
longer terms are sorted as bytes, by length. A block leaves one row per term and group, so a frequent term or a large
source costs no more than any other. Rows of a language's term meet once, in an array over its sources.

Shares are compared exactly, in 64-bit integers: a pair's sum is at most 10^18 plus 10^9 times the kept terms. Two
groups that both lack a term differ by the same amount for every such term, so only occurring (term, source) entries
are met with the sources, in blocks of terms; a task returns sums over its terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.rows import staged

# The unit of shares, the documents that a kept term is in, and the ranks of terms.
UNIT, LEAST_DOCS, TOP = 1_000_000_000, 3, 200
#: Text is packed in blocks of so many bytes or documents, and cut into pieces of so many bytes.
BLOCK_BYTES, BLOCK_DOCS, PIECE_BYTES = 24 << 20, 1 << 16, 2 << 20
#: Term and source entries that are compared at a time.
CELLS = 1 << 20
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 0 for b in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
_SUMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("both", pa.int64())])


def radix_order(words: list[np.ndarray], documents: np.ndarray) -> np.ndarray:
    """Order by the words, the first one most, then by document: stable passes over 16-bit digits, from the least on. A
    digit that is the same in all is passed over."""
    order = np.argsort(documents.astype(np.uint16), kind="stable")
    for word in reversed(words):
        for shift in range(0, 64, 16):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def runs(differs: np.ndarray, documents: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, documents) of the runs of a term in a group, where ``differs`` marks a term unlike the one before."""
    moved = differs.copy()
    moved[1:] |= documents[1:] != documents[:-1]
    head = differs.copy()
    head[1:] |= groups[1:] != groups[:-1]
    starts = np.flatnonzero(head)
    return starts, np.diff(np.append(starts, len(differs))), np.add.reduceat(moved.astype(np.int64), starts) if len(starts) else starts


class Packer:
    """Packed terms of a block of documents."""

    def __init__(self):
        self.one, self.two, self.long = [], [], {}
        self.groups: dict[tuple[str, str], int] = {}
        self.documents: list[int] = []
        self.waiting: list[bytes] = []
        self.size = self.waiting_size = 0

    def add(self, lang: str, source: str, text: str) -> None:
        self.documents.append(self.groups.setdefault((lang, source), len(self.groups)))
        self.waiting.append(text.encode().translate(_TERM_BYTES))
        self.size += len(self.waiting[-1])
        self.waiting_size += len(self.waiting[-1])
        if self.waiting_size >= PIECE_BYTES:
            self.pack()

    def pack(self) -> None:
        first = len(self.documents) - len(self.waiting)
        if len(self.waiting) == 1 and len(self.waiting[0]) > 2 * PIECE_BYTES:
            raw, start = self.waiting[0], 0
            while start < len(raw):
                end = raw.find(b"\0", start + PIECE_BYTES)
                end = len(raw) if end < 0 else end
                self._pack(raw[start:end], np.zeros(1, np.int64), first)
                start = end
        else:
            lengths = np.fromiter(map(len, self.waiting), np.int64, len(self.waiting)) + 1
            self._pack(b"\0".join(self.waiting), np.cumsum(lengths) - lengths, first)
        self.waiting, self.waiting_size = [], 0

    def _pack(self, raw: bytes, begin: np.ndarray, first: int) -> None:
        held = np.frombuffer(b"\0" + raw + bytes(24), np.uint8)
        inside = held != 0
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, lengths = edges[::2], edges[1::2] - edges[::2]
        documents = (first + np.searchsorted(begin, starts - 1, "right") - 1).astype(np.uint16)
        loaded = np.ndarray((len(held) - 7,), ">u8", held.data, 0, (1,))

        def word(which: np.ndarray, offset: int) -> np.ndarray:
            empty = (64 - 8 * np.minimum(lengths[which] - offset, 8)).astype(np.uint64)
            return loaded[starts[which] + offset].astype(np.uint64) >> empty << empty

        few = np.flatnonzero(lengths <= 8)
        self.one.append((word(few, 0), documents[few]))
        more = np.flatnonzero((lengths > 8) & (lengths <= 16))
        self.two.append((word(more, 0), word(more, 8), documents[more]))
        rest = np.flatnonzero(lengths > 16)
        for length in np.unique(lengths[rest]).tolist():
            which = rest[lengths[rest] == length]
            if length > PIECE_BYTES:
                terms = [held[s:s + length].tobytes() for s in starts[which].tolist()]
            else:
                terms = np.concatenate([held[part[:, None] + np.arange(length)] for part in np.array_split(starts[which], 1 + len(which) * length // PIECE_BYTES)])
                terms = terms.view(f"S{length}").ravel().tolist()
            self.long.setdefault(length, []).append((terms, documents[which]))

    def counts(self) -> Iterator[pa.RecordBatch]:
        """(lang, source, term, n, docs) over the block."""
        if self.waiting:
            self.pack()
        groups = np.array(self.documents, np.int64)
        # Documents are numbered by group, so that a group's lie side by side.
        rank = np.empty(len(groups), np.int64)
        rank[np.argsort(groups, kind="stable")] = np.arange(len(groups))
        of = np.empty(len(groups), np.int64)
        of[rank] = groups
        for kind in (self.one, self.two):
            if not kind:
                continue
            *words, documents = (np.concatenate(x) for x in zip(*kind))
            kind.clear()
            ranked = rank[documents]
            order = radix_order(words, ranked)
            words, ranked = [w[order] for w in words], ranked[order]
            differs = np.ones(len(order), bool)
            differs[1:] = np.any([w[1:] != w[:-1] for w in words], axis=0)
            starts, n, docs = runs(differs, ranked, of[ranked])
            terms = np.stack([w[starts] for w in words], axis=1).astype(">u8").tobytes()
            terms = np.frombuffer(terms, f"S{8 * len(words)}").tolist()
            yield from self._rows(of[ranked[starts]], terms, n, docs)
        for parts in self.long.values():
            terms = [t for held, _ in parts for t in held]
            ranked = rank[np.concatenate([d for _, d in parts])].tolist()
            order = sorted(range(len(terms)), key=lambda k: (terms[k], ranked[k]))
            terms, ranked = [terms[k] for k in order], np.array([ranked[k] for k in order])
            differs = np.array([True, *(a != b for a, b in zip(terms, terms[1:]))])
            starts, n, docs = runs(differs, ranked, of[ranked])
            yield from self._rows(of[ranked[starts]], [terms[k] for k in starts.tolist()], n, docs)

    def _rows(self, groups: np.ndarray, terms: list[bytes], n: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = [pa.array(x, pa.string()) for x in zip(*self.groups)]
        size = sum(map(len, terms))
        step = max(1, min(1 << 16, len(terms) * PIECE_BYTES // max(size, 1)))
        for k in range(0, len(terms), step):
            which = pa.array(groups[k:k + step])
            yield pa.RecordBatch.from_arrays([*(x.take(which) for x in names), pa.array(terms[k:k + step], pa.binary()), pa.array(n[k:k + step]), pa.array(docs[k:k + step])],
                                             schema=_COUNTS)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = Packer()
    for batch in batches:
        for start in range(0, batch.num_rows, 128):
            for row in zip(*(c.to_pylist() for c in batch.slice(start, 128).columns)):
                packer.add(*row)
                if packer.size >= BLOCK_BYTES or len(packer.documents) == BLOCK_DOCS:
                    yield from packer.counts()
                    packer = Packer()
    yield from packer.counts()


def kept_terms(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, n, entries): the terms in ``least_docs`` or more documents of a language, with their occurrences in all and by source, array of
    struct(source, n). A null text, lang or source is empty; every row is a document."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_column, "_lang"), (source_column, "_source"), (text_column, "_text"))))
    counted = rows.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    # One exchange, by language and term, serves both groupings.
    return (counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
            .groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("entries"))
            .filter(F.col("docs") >= least_docs).select("lang", F.col("term").cast("string").alias("term"), "n", "entries"))


def share(n: Column, total: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / total), exact for any 64-bit count."""
    wide = (n + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", wide, total.cast("decimal(20,0)")) + 1


def shares(n: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """The same in 64 bits, by two steps of long division: exact for counts below 2^47."""
    high, low = divmod(UNIT, 1 << 15)
    first, rest = np.divmod((n + 1) * high, total)
    return 1 + (first << 15) + ((rest << 15) + (n + 1) * low) // total


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def block_sums(term: np.ndarray, source: np.ndarray, n: np.ndarray, n_terms: int, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every pair of sources, the summed differences over the terms that either has, and the number of terms that both have. ``totals`` are
    the sources' occurrences and kept terms together."""
    n_sources = len(totals)
    order = np.argsort(source, kind="stable")
    term, source, n = term[order], source[order], n[order]
    p, none = shares(n, totals[source]), shares(np.zeros(n_sources, np.int64), totals)
    every, held = np.repeat(none[None, :], n_terms, axis=0), np.zeros((n_terms, n_sources), bool)
    every[term, source], held[term, source] = p, True
    sums = np.zeros((n_sources, n_sources), np.int64)
    bounds = np.searchsorted(source, np.arange(n_sources + 1))
    step = max(1, CELLS // n_sources)
    for s in range(n_sources):
        for a in range(bounds[s], bounds[s + 1], step):
            rows, mine = term[a:min(a + step, bounds[s + 1])], p[a:min(a + step, bounds[s + 1]), None]
            other = every[rows]
            sums[s] += ((mine - other) ** 2 // other).sum(axis=0)
            # Sources that lack the term, against this one.
            sums[:, s] += np.where(held[rows], 0, (none[None, :] - mine) ** 2 // mine).sum(axis=0)
    found = held.astype(np.float64)
    both = np.zeros((n_sources, n_sources))
    for a in range(0, n_terms, step):
        both += found[a:a + step].T @ found[a:a + step]
    return sums, both.astype(np.int64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            lang, kept = batch.column(0)[k].as_py(), batch.column(3)[k].as_py()
            groups, terms = batch.column(1)[k].values, batch.column(2)[k].values
            names = groups.field("source")
            entries = terms.flatten()
            lengths = terms.value_lengths().to_numpy(zero_copy_only=False)
            sums, both = block_sums(np.repeat(np.arange(len(terms)), lengths), pc.index_in(entries.field("source"), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64),
                                    entries.field("n").to_numpy(zero_copy_only=False), len(terms), groups.field("total").to_numpy(zero_copy_only=False) + kept)
            for s in range(len(names)):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names)), pa.array([names[s].as_py()] * len(names)), names, pa.array(sums[s]), pa.array(both[s])], schema=_SUMS)


def audit(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source", least_docs: int = LEAST_DOCS,
          top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of every occurring (lang, source) group.

    Part ``pair`` holds each other source of the language, so a language has a row for each pair of its sources, also of those without terms. Part
    ``term`` holds the ``top`` kept terms of the group that are more frequent in it than in the language. Ranks are by value, the largest first, then
    by the bytes of the item. Nulls read as empty; an empty table has no groups. Other columns are left out.
    """
    kept = staged(kept_terms(docs, text_column, lang_column, source_column, least_docs))
    entries = kept.select("lang", "term", F.col("n").alias("n_lang"), F.inline("entries"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("total_lang"))
    occurring = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_column, "lang"), (source_column, "source")))).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = staged(occurring.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
                    .select("lang", "source", *map(zero, ("total", "held", "v", "total_lang"))))

    p, q = share(F.col("n"), F.col("total") + F.col("v")), share(F.col("n_lang"), F.col("total_lang") + F.col("v"))
    more = entries.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (more.select("lang", "source", F.lit("term").alias("part"), "item", gap(F.col("p"), F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top))

    by_lang = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("groups"), F.first("v").alias("v"))
    size = F.size("groups")
    room = F.greatest(F.floor(F.lit(CELLS) / size), size.cast("long"))  # terms of a block
    blocks = (kept.join(by_lang.select("lang", F.ceil(F.col("v") / room).alias("blocks")), "lang")
              .groupBy("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")).agg(F.collect_list("entries").alias("terms")))
    summed = blocks.join(by_lang, "lang").select("lang", "groups", "terms", "v").mapInArrow(_summed, "lang string, source string, item string, value long, both long")
    sums = summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("both").alias("both"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("total_item"), F.col("held").alias("held_item"))
    none = lambda total: share(F.lit(0), F.col(total) + F.col("v"))
    absent = F.col("v") - F.col("held") - F.col("held_item") + F.coalesce("both", F.lit(0))
    value = F.when(F.col("v") > 0, F.coalesce("value", F.lit(0)) + absent * gap(none("total"), none("total_item"))).otherwise(0)
    pairs = (groups.join(other, "lang").filter("source <> item").join(sums, ["lang", "source", "item"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
             .withColumn("rank", F.row_number().over(by_value)))
    return pairs.unionByName(terms)
