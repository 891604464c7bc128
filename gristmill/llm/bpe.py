"""Byte-level BPE encoding and decoding (operator 4).

A long text is cut into segments that different tasks encode; a tree joins neighbouring encodings. Around each
join a window is encoded again, and it grows until both sides agree exactly:

* A cut before a blank or line end that follows a non-blank is a *strong* boundary: the pre-tokenising pattern
  never matches across it and never looks back, so a window between strong boundaries has the encoding it has
  in the whole text.
* Inside an unsplit run (of letters of any script, of digits, of symbols or of blanks) there is none. There a window may
  end between two tokens if the encoding of the window agrees with the side's in the token at that end. A sequence of
  tokens is the encoding of its text if and only if each pair of neighbours is the encoding of theirs; all pairs of the
  joined sequence are then pairs of one of the three.
* If a window of one size has neither, the next has twice as many tokens; it takes in a whole side only if that has
  neither anywhere. A run of equal letters whose encoding shifts as a whole is such a case: all of it has to change.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.rows import id_back, keyed, map_rows

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: Code points of a segment: the unit that tasks encode in parallel. The result doesn't depend on it.
SEGMENT = 1 << 15
#: Bytes of text that are encoded together.
TOGETHER = 2 << 20
#: Tokens on either side of a join in the first window.
FIRST_WINDOW = 16
# White space of the pre-tokenising pattern (Unicode White_Space), and the control characters
# 1C to 1F, which some libraries count as well.
ASCII_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "
OTHER_BLANKS = "\x85\xa0                　"


def byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: a printable byte is itself, the others
    follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file. Ids are arrays of unsigned 32-bit integers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path} isn't a plain byte-level BPE vocabulary")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")) or len(self.added) > 1:
            raise ValueError(f"{path}: only one plain added token is supported")
        to_byte = byte_characters()
        ranks = {bytes(to_byte[c] for c in token): i for token, i in model["vocab"].items() if token not in self.added}
        self.base = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = max([*ranks.values(), *self.added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in ranks.items():
            self.bytes_of[i] = token
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        self.starts_blank = np.array([b[:1] == b" " for b in self.bytes_of])
        self.starts_line = np.array([b[:1] == b"\n" for b in self.bytes_of])
        blanks = f"[{ASCII_BLANKS}{OTHER_BLANKS}]"
        self.odd = "|".join([f"{blanks}[ \n]", "[\\x00\\x01]", *map(re.escape, self.added)])

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encoded(text), np.uint32)

    def encoded(self, text: str) -> bytes:
        for content, i in self.added.items():
            if content in text:
                return np.uint32(i).tobytes().join(self._plain(part) for part in text.split(content))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return array("I", self.base.encode_ordinary(text)).tobytes()

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin and end. Texts are cut into chunks at their strong
        boundaries and each different chunk is encoded once; a text with adjoining blanks goes through whole."""
        n = len(texts)
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        if odd.all():
            ids = [self.encode(t) for t in texts.to_pylist()]
            return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.cumsum([0, *map(len, ids)])
        marked = pc.binary_join_element_wise("\x01", pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \0"), "")
        lists = pc.split_pattern(marked, " ")
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        chunks = lists.flatten().dictionary_encode()
        pool, firsts, sizes = self._chunk_ids(chunks.dictionary)
        which = chunks.indices.to_numpy()
        lengths = sizes[which]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1], dtype=np.int32)
        at += np.repeat((firsts[which] - (ends - lengths)).astype(np.int32), lengths)
        out = pool[at]
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        if not odd.any():
            return out, bounds
        parts, at = [], 0
        for k, text in enumerate(texts.to_pylist()):
            if odd[k]:
                parts.append(self.encode(text))
            else:
                parts.append(out[bounds[at]:bounds[at + 1]])
                at += 1
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])[:n + 1]

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different chunks in a row, and where each chunk's begin and how many they are. Chunk "x" stands for
        " x", NUL and "x" for a line end and "x", 01 and "x" for "x" at the start of a text. Chunks of a kind are
        encoded in one go: each starts with the only token that starts as it does."""
        kinds = pc.if_else(pc.equal(chunks, ""), 3, pc.if_else(pc.equal(chunks, "\0"), 4, pc.if_else(
            pc.starts_with(chunks, "\0"), 1, pc.if_else(pc.starts_with(chunks, "\x01"), 2, 0)))).to_numpy()
        firsts, sizes = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        parts, at = [np.zeros(0, np.uint32)], 0

        def put(where: np.ndarray, ids: np.ndarray, edges: np.ndarray) -> None:
            nonlocal at
            if len(edges) != len(where):
                raise ValueError("a chunk has no boundary of its own")
            firsts[where], sizes[where] = edges + at, np.diff(np.append(edges, len(ids)))
            parts.append(ids)
            at += len(ids)

        def together(where: np.ndarray, lead: str) -> np.ndarray:
            held = chunks.take(pa.array(where))
            held = pc.utf8_slice_codeunits(held, 1) if lead == "\n" else held
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(where)], pa.int32()), held), lead)[0].as_py()
            return np.array(self.base.encode_ordinary(lead + text), np.uint32)

        for kind, starts, lead in ((0, self.starts_blank, " "), (1, self.starts_line, "\n")):
            where = np.flatnonzero(kinds == kind)
            if len(where):
                ids = together(where, lead)
                put(where, ids, np.flatnonzero(starts[ids]))
        for k in np.flatnonzero(kinds >= 2).tolist():
            text = {3: " ", 4: "\n"}.get(kinds[k]) or chunks[k].as_py()[1:]
            put(np.array([k]), self.encode(text), np.zeros(1, np.int64))
        return np.concatenate(parts), firsts, sizes

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    # The tree's join.

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of the text of ``left`` followed by that of ``right``, each the encoding of its own."""
        if not len(left) or not len(right):
            return right if not len(left) else left
        low, window, high = self.window(left, right)
        return np.concatenate([left[:low], window, right[high:]])

    def window(self, left: np.ndarray, right: np.ndarray) -> tuple[int, np.ndarray, int]:
        """The smallest window tried on which both sides agree: its first token in ``left``, its encoding, and where it
        ends in ``right``."""
        width = FIRST_WINDOW
        while True:
            low, low_is_sure = self._edge(left, len(left) - 1, max(0, len(left) - width), -1)
            high, high_is_sure = self._edge(right, 1, min(len(right), width), 1)
            if low is not None and high is not None:
                window = self.encode(self.decode(np.concatenate([left[low:], right[:high]]).tolist()))
                if (low_is_sure or window[0] == left[low]) and (high_is_sure or window[-1] == right[high - 1]):
                    return low, window, high
            width *= 2

    def _edge(self, ids: np.ndarray, near: int, far: int, step: int) -> tuple[int | None, bool]:
        """An edge of the window between the join (``near``) and ``far``, and whether it holds without agreement, as a strong
        boundary and the end of a side do. The nearest strong boundary, else the end of the side if that is reached, else
        the farthest place in the outer half that lies inside a run; None if there is none."""
        for at in range(near, far, step):
            if self._strong(ids, at):
                return at, True
        if far in (0, len(ids)):
            return far, True
        for at in range(far, (near + far) // 2, -step):
            if self._inside_run(ids, at):
                return at, False
        return None, False

    def _strong(self, ids: np.ndarray, at: int) -> bool:
        if self.bytes_of[ids[at]][:1] not in (b" ", b"\n") or ids[at] in self.added.values() or ids[at - 1] in self.added.values():
            return False
        before = self.decode(ids[max(0, at - 4):at].tolist())
        return bool(before) and before[-1] not in ASCII_BLANKS and before[-1] not in OTHER_BLANKS

    def _inside_run(self, ids: np.ndarray, at: int) -> bool:
        """Whether the boundary before token ``at`` lies between two characters of one class, so that the pattern reads what
        follows alike with and without what precedes. Around an apostrophe it could take a contraction for the one and not
        for the other, so two characters before and after are looked at."""
        if ids[at] in self.added.values() or ids[at - 1] in self.added.values():
            return False
        before, after = (self.decode_bytes(x.tolist()) for x in (ids[max(0, at - 8):at], ids[at:at + 8]))
        if after[0] & 0xC0 == 0x80:
            return False
        before, after = before.decode("utf-8", "ignore")[-2:], after.decode("utf-8", "ignore")[:2]
        if len(before) < 2 or len(after) < 2 or "'" in (before[0], after[0]):
            return False
        return character_class(before[1]) == character_class(after[0]) != ""


def character_class(c: str) -> str:
    """What the pattern's runs tell apart: L(etter), N(umber), S(pace) or O(ther); empty where libraries may differ, as they
    know different versions of Unicode."""
    if c in ASCII_BLANKS or c in OTHER_BLANKS:
        return "" if "\x1c" <= c <= "\x1f" else "S"
    now, then = unicodedata.category(c), unicodedata.ucd_3_2_0.category(c)
    if now[0] in "LN":
        return now[0] if then[0] == now[0] else ""
    return "" if now == "Cn" or then[0] in "LN" else "O"


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def safe_cuts(text: str, size: int, added: Iterable[str]) -> list[str]:
    """The text in segments of about ``size`` code points, cut anywhere but inside an added token."""
    cuts, start = [], 0
    while len(text) - start > size:
        end = start + size
        for content in added:
            found = text.find(content, max(start, end - len(content) + 1), end + len(content) - 1)
            if 0 <= found < end < found + len(content):
                end = found + len(content)
        cuts.append(text[start:end])
        start = end
    return [*cuts, text[start:]]


def encoded_rows(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[tuple]:
    """(other columns..., ids) of each row of batches whose last column is a text."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + TOGETHER, side="right")))
            part = batch.slice(start, end - start)
            ids, bounds = codec(path).encode_many(part.column(batch.num_columns - 1))
            others = [c.to_pylist() for c in part.columns[:-1]]
            for *row, low, high in zip(*others, bounds[:-1].tolist(), bounds[1:].tolist()):
                yield *row, ids[low:high]
            start = end


def encode_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None,
                     segment: int = SEGMENT, decode: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) of every row's whole text; with ``decode`` also ``decoded``, the text of the ids, read
    back in the same pass.

    A null text is empty and has no ids; equal rows come out as often as they stand in. A text above ``segment`` code
    points is encoded in segments by different tasks, whose encodings a tree joins two by two; each level halves their
    number, so the number of levels is the logarithm of the longest text.
    """
    path = path or public_tokenizers.path(DEFAULT_VOCABULARY)
    source = keyed(docs, id_column, text_column)
    short, long_texts = source.filter(F.length("_text") <= segment), source.filter(F.length("_text") > segment)
    out = "doc_id long, ids array<int>" + ", decoded string" * decode

    def finished(rows: Iterator[tuple]) -> Iterator[tuple]:
        for i, _, x in rows:
            ids = np.frombuffer(x, np.int32)
            yield (i, ids, codec(path).decode(ids.tolist())) if decode else (i, ids)

    return (map_rows(short, out, finished, lambda batches: encoded_rows(batches, path))
            .unionByName(map_rows(joined_segments(long_texts, path, segment), out, finished))
            .withColumn("doc_id", id_back("doc_id")))


def decode_documents(encoded: DataFrame, path: str | None = None, ids_column: str = "ids") -> DataFrame:
    """(doc_id, ids, decoded) of rows with ids; null ids are none, and bytes that aren't UTF-8 become U+FFFD."""
    path = path or public_tokenizers.path(DEFAULT_VOCABULARY)

    def decode(rows: Iterator[tuple]) -> Iterator[tuple]:
        for i, ids in rows:
            yield i, ids or [], codec(path).decode(ids or [])

    return map_rows(encoded.select("doc_id", ids_column), "doc_id long, ids array<int>, decoded string", decode)


def joined_segments(long_texts: DataFrame, path: str, segment: int) -> DataFrame:
    """(_id, _tie, ids) of the long texts by the tree. A text that stands in several equal rows is encoded once
    and comes out once for each."""
    def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
        for i, t, n, text in rows:
            for k, part in enumerate(safe_cuts(text, segment, codec(path).added)):
                yield i, t, n, k, part

    def encode(rows: Iterator[tuple]) -> Iterator[tuple]:
        for i, t, n, k, part in rows:
            yield i, t, n, k, codec(path).encoded(part)

    def join(rows: Iterator[tuple]) -> Iterator[tuple]:
        for i, t, n, k, first, second in rows:
            sides = [np.frombuffer(x, np.uint32) for x in (first, second) if x is not None]
            yield i, t, n, k, (codec(path).join(*sides) if len(sides) == 2 else sides[0]).tobytes()

    spark = long_texts.sparkSession
    out = "_id long, _tie long, n long, k int, ids binary"
    once = long_texts.withColumn("n", F.lit(1).cast("long")).select("_id", "_tie", "n", "_text")
    pieces = map_rows(once, "_id long, _tie long, n long, k int, part string", cut)
    levels = max(0, (long_texts.agg(F.max(F.length("_text"))).first()[0] or 0) - 1) // segment
    pieces = pieces.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_id", "_tie", "k")
    tree = map_rows(pieces, out, encode)
    for _ in range(int(levels).bit_length()):
        # Equal rows give equal encodings, so the first of either side stands for all; n keeps their number.
        at = lambda odd: F.first(F.when(F.col("k") % 2 == odd, F.col("ids")), ignorenulls=True)
        pairs = (tree.groupBy("_id", "_tie", F.shiftright("k", 1).alias("half"))
                 .agg(F.sum(F.when(F.col("k") % 2 == 0, F.col("n"))).alias("n"), at(0).alias("first"), at(1).alias("second")))
        tree = map_rows(pairs.select("_id", "_tie", "n", F.col("half").cast("int"), "first", "second"), out, join)
    return tree.select("_id", "_tie", "ids", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).drop("copy")
