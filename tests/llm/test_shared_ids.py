"""Different texts of one id, or of none, whose hashes agree in the lowest 23 bits."""

import random

import xxhash

import corpus_pipeline
from gristmill.llm import bpe, line_dedup, suffix_dedup

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def colliding(make):
    """Two such texts, one of an even number and one of an odd one."""
    seen, k = ({}, {}), 0
    while True:
        text = make(k)
        low = xxhash.xxh64_intdigest(text.encode(), 42) & (1 << 23) - 1
        if low in seen[1 - k % 2]:
            return seen[1 - k % 2][low], text
        seen[k % 2][low] = text
        k += 1


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)


def test_shared_lines(spark):
    line = "a line that three documents share"
    a, b = colliding(lambda k: f"own line {k}\n{line}\nend" if k % 2 else f"{line}\nanother own line {k}\nmiddle\nend")
    docs = table(spark, [(None, a), (None, b), (1, line), (2, line), (3, line)])
    want = sorted(t.replace(line + "\n", "") for t in (a, b))
    assert sorted(r.text for r in line_dedup.without_shared_lines(docs).filter("doc_id IS NULL").collect()) == want
    assert sorted(r.text for r in corpus_pipeline.shared_lines(spark, docs, "").filter("doc_id IS NULL").collect()) == want


def test_long_texts(spark):
    a, b = colliding(lambda k: f"text number {k} " + "some more words " * (20 + k % 7))
    rows = lambda *ids: bpe.encode_documents(table(spark, list(zip(ids, (a, b)))), segment=64, decode=True).collect()
    assert sorted(r.decoded for r in rows(None, None)) == sorted((a, b))
    assert sorted(r.ids for r in rows(5, 5)) == sorted(r.ids for r in rows(1, 2))


def test_repeats(spark):
    r = random.Random(3)
    passage = "".join(r.choice("abcdefghij ") for _ in range(60))
    a, b = colliding(lambda k: f"{k} " + (passage if k % 2 else "0123456789" + passage[::-1]) + f" {k} {k}")
    found = lambda rows: sorted(bytes(x.kept) for x in suffix_dedup.remove_repeats(table(spark, rows), threshold=20).filter("doc_id > 5").collect())
    assert found([(1, passage), (7, a), (7, b)]) == found([(1, passage), (7, a), (8, b)])


def test_documents_stay_in_the_pipeline(spark):
    a, b = colliding(lambda k: " ".join(random.Random(k).choices(["alpha", "beta", "gamma", "delta", "eta", "iota"], k=40)))
    assert sorted(r.text for r in corpus_pipeline.near_duplicates(spark, table(spark, [(None, a), (None, b)]), "").collect()) == sorted((a, b))
