"""Context-triggered piecewise fingerprints and their likeness (operator 10).

A rolling hash of the last seven bytes decides where a chunk ends: at block size 2^k, where its upper k bits are
zero, so the ends at one size are among those of the size below. A chunk gives one of 64 characters. A fingerprint is
"k:signature at k:signature at k + 1", where k is the largest that gives 32 chunks or more. Signatures are compared at
equal block sizes by the edit distance of insertions and deletions.

Text with a short period ends a chunk at every place of its period or at none. Where a size gives more than ``MOST_CHUNKS``
ends, evenly chosen ones of them count, between 64 and 128, so a signature never has more than 129 characters, chunks still
cover the whole text, and a comparison takes the same time for a text of any length.
"""

from __future__ import annotations

import hashlib
import string
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.rows import id_back, keyed, map_rows, staged

WINDOW, LEAST_CHUNKS, MOST_CHUNKS, COMMON = 7, 32, 128, 7
ALPHABET = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"
_WEIGHTS = np.array([pow(0x01000193, k, 1 << 32) for k in range(WINDOW)], np.uint32)
_MIX = np.uint32(0x9E3779B1)


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the window that ends at each byte; before the first byte stand zeros."""
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32) + np.uint32(1)])
    n = len(data)
    total = np.zeros(n, np.uint32)
    for k in range(WINDOW):
        start = WINDOW - 1 - k
        total += padded[start:start + n] * _WEIGHTS[k]
    total ^= total >> np.uint32(15)
    return total * _MIX


def fingerprint(text: str) -> str:
    """A function of the text alone. The empty text gives "0::"."""
    raw = text.encode()
    if not raw:
        return "0::"
    hashes = rolling(np.frombuffer(raw, np.uint8))
    k = max(0, (len(raw) // LEAST_CHUNKS).bit_length())
    ends = np.flatnonzero(hashes < np.uint32(1 << (32 - k))) if k else np.arange(len(raw))
    while k and len(ends) < LEAST_CHUNKS:
        k -= 1
        ends = np.flatnonzero(hashes < np.uint32(1 << (32 - k))) if k else np.arange(len(raw))
    wider = ends[hashes[ends] < np.uint32(1 << (31 - k))]
    return f"{k}:{signature(raw, ends)}:{signature(raw, wider)}"


def signature(raw: bytes, ends: np.ndarray) -> str:
    """A character for each chunk; what follows the last end is a chunk too."""
    if len(ends) > MOST_CHUNKS:
        step = -(-len(ends) // MOST_CHUNKS)
        ends = ends[step - 1::step]
    start, crc, out = 0, zlib.crc32, []
    for end in (ends + 1).tolist():
        out.append(ALPHABET[(crc(raw[start:end]) * 0x9E3779B1 & 0xFFFFFFFF) >> 26])
        start = end
    if start < len(raw):
        out.append(ALPHABET[(crc(raw[start:]) * 0x9E3779B1 & 0xFFFFFFFF) >> 26])
    return "".join(out)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by a bit for each character of ``a``."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full = state = (1 << len(a)) - 1
    for c in b:
        both = state & at.get(c, 0)
        state = (state + both | state - both) & full
    return len(a) - state.bit_count()


def signature_likeness(a: str, b: str) -> float:
    """0 unless they share seven characters in a row, else one less the edit distance as a share of both lengths: 1 for equal
    ones. Shorter signatures say too little to be alike; texts that are equal have equal fingerprints."""
    short, long = sorted((a, b), key=len)
    if not any(short[k:k + COMMON] in long for k in range(len(short) - COMMON + 1)):
        return 0.0
    return 2 * common_length(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1; fingerprints whose block sizes are more than one step apart have none in common."""
    if a == b:
        return 1.0
    (ka, a0, a1), (kb, b0, b1) = a.split(":"), b.split(":")
    step = int(kb) - int(ka)
    pairs = {0: [(a0, b0), (a1, b1)], 1: [(a1, b0)], -1: [(a0, b1)]}.get(step, [])
    return max((signature_likeness(x, y) for x, y in pairs if x and y), default=0.0)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
EDGE = "part int, first_text string, first_fingerprint string, last_text string, last_fingerprint string"


def compared(i: int, text: str, own: str, after: str, after_fingerprint: str) -> tuple:
    changed = edited(text, after)
    theirs = fingerprint(changed)
    return (i, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, theirs, likeness(own, theirs), likeness(own, after_fingerprint))


def fingerprint_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per document with its fingerprint, that of its edited text, and how like they are to it and to the next
    document's; the next is that of descending id, after the last comes the first.

    A null text is empty, a null id the last; rows that share an id follow by the hash of their text. A lone document
    is its own next one. Texts are sorted by id once; only the last document of each task needs one more text, the
    first of the next task, which is joined to it by the number of the task.
    """
    def compare(rows: Iterator[tuple]) -> Iterator[tuple]:
        part, first, held = TaskContext.get().partitionId(), None, None
        for i, _, text in rows:
            own = fingerprint(text)
            if held:
                yield *compared(*held, text, own), None, None, None, None, None
            held = i, text, own
            first = first or (text, own)
        if held:
            yield held[0], None, None, None, None, None, None, part, *first, *held[1:]

    ordered = keyed(docs, id_column, text_column).repartitionByRange(F.desc("_id"), F.desc("_tie")).sortWithinPartitions(F.desc("_id"), F.desc("_tie"))
    rows = staged(map_rows(ordered, f"{ROW}, {EDGE}", compare))
    edges = rows.filter("part IS NOT NULL").select("doc_id", *(f.rsplit(" ", 1)[0] for f in EDGE.split(", ")))
    order = Window.orderBy("part")
    follow = edges.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())).alias("next_part"))
    heads = edges.select(F.col("part").alias("next_part"), F.col("first_text").alias("after"), F.col("first_fingerprint").alias("after_fingerprint"))
    ends = edges.join(follow, "part").join(heads, "next_part").select("doc_id", "last_text", "last_fingerprint", "after", "after_fingerprint")
    last = map_rows(ends, ROW, lambda rows: (compared(*row) for row in rows))
    return rows.filter("part IS NULL").select(*last.columns).unionByName(last).withColumn("doc_id", id_back("doc_id"))
