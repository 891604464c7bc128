"""Repeated strings against a brute-force search, and what each round does."""

import hashlib
import random

import pytest

from gristmill.llm import queries, suffix_dedup

FOLDER = "/root/testdata/sf0.001"


def brute(rows, length):
    """(id, n_bytes, n_removed, n_spans, kept) with every string of every document in a table; equal rows are one."""
    seen, out = set(), []
    for i, raw in sorted(((-(1 << 63) if i is None else i), (t or "").encode()) for i, t in rows):
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s:s + length]
            if w in seen:
                gone[s:s + length] = b"\1" * length
            seen.add(w)
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(raw)))
        out.append((i, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def found(spark, rows, length):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id BIGINT, text STRING, place INT, half STRING")
    out = suffix_dedup.remove_repeats(docs, threshold=length).collect()
    return sorted((-(1 << 63) if r[0] is None else r[0], *r[1:4], bytes(r.kept)) for r in out)


@pytest.mark.parametrize("seed", range(4))
def test_matches_brute_force(spark, seed):
    r = random.Random(seed)
    alphabet = ["ab", "abcdefgh ", "xyé", "a"][seed]
    text = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    shared = [text(r.randrange(20, 90)) for _ in range(6)]
    rows = [(k, "".join(r.choice([text(r.randrange(12)), r.choice(shared)]) for _ in range(r.randrange(7)))) for k in range(120)]
    rows += [(500, None), (501, ""), (None, shared[0] * 2), (900, shared[1]), (901, shared[1]), (902, shared[1] + "q")]
    assert found(spark, rows, 20) == sorted(brute(rows, 20))


def test_long_and_hot(spark):
    r = random.Random(9)
    passage = "".join(r.choice("abcdefghij ") for _ in range(400))
    rows = [(k, "".join(r.choice("klmnop ") for _ in range(r.randrange(150))) + passage + str(k)) for k in range(300)]
    rows += [(1000, "".join(r.choice("abcdefghijklm") for _ in range(60000)) + passage), (1001, "z" * 5000)]
    assert found(spark, rows, 100) == sorted(brute(rows, 100))


def test_rows_that_share_an_id(spark):
    rows = [(1, "a" * 40 + "bcdefghijklmnopqrstuvwxyz"), (1, "other text, quite long enough"), (2, "bcdefghijklmnopqrstuvwxyz!")]
    out = {(r[0], r[1]): r for r in found(spark, rows + rows[:1], 20)}
    assert out[(1, 29)][2] == 0 and out[(2, 26)][2] == 25 and out[(1, 65)][2] == 39
    assert len(found(spark, rows + rows[:1], 20)) == 4
    assert found(spark, rows[:0], 20) == []


def test_registered_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in brute(rows, 100))
    assert sorted(tuple(r) for r in queries.op9_suffix_dedup(spark, FOLDER).collect()) == want
