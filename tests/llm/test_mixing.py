"""The mixture: targets against the written rule, the draw's sums and expectations, and plans without Python."""

import re
from collections import defaultdict

import pytest

from gristmill.llm import mixing, queries

FOLDER = "/root/testdata/sf0.001"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Round by round: share by weight, stop at the cap, share the excess among the rest."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    got, left, free = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            got[s] += left * weight[s] / total
        left = sum(max(0.0, got[s] - most * sizes[s]) for s in free)
        for s in list(free):
            if got[s] >= most * sizes[s]:
                got[s] = most * sizes[s]
                free.discard(s)
    return got


def check(rows, out):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size(text)
    want = plain_targets(sizes)
    biggest, taken = defaultdict(int), defaultdict(int)
    names = {i: s for i, _, s in rows}
    for i, n, source_size, target, copies in out:
        s = names[i]
        assert source_size == sizes[s] and target == pytest.approx(want[s], rel=1e-9, abs=1e-6) and 0 <= copies <= 2
        biggest[s], taken[s] = max(biggest[s], n), taken[s] + n * copies
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest[s] + 1e-6


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], "doc_id BIGINT, text STRING, source STRING, n INT, copies STRING")


def test_targets_and_sums(spark):
    rows = [(k, "w " * (k % 23) + ("é\tx\n" if k % 7 == 0 else ""), ["a", "b", "B", "c", None, "é"][k % 17 % 6]) for k in range(700)]
    rows += [(k, "w " * 9, "big") for k in range(1000, 3200)] + [(4000, None, "empty"), (4001, "", "empty")]
    out = [tuple(r) for r in mixing.mix_report(frame(spark, rows)).collect()]
    assert sorted(r[0] for r in out) == sorted(r[0] for r in rows)
    assert {r[0]: r[1] for r in out} == {i: size(t) for i, t, _ in rows}
    check(rows, out)
    assert sorted(out) == sorted(tuple(r) for r in mixing.mix_report(frame(spark, rows).repartition(5)).collect())


def test_odd_tables(spark):
    docs = frame(spark, [(1, "a b", "x")])
    assert mixing.mix_report(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
    rows = [(None, "a b c", None), (None, None, None)] + [(7, "same words here", "s")] * 50 + [(8, "one", "s")]
    out = mixing.mix_report(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    again = [r for r in out if r.doc_id == 7]
    assert abs(sum(r.copies * r["size"] for r in out if r.doc_id in (7, 8)) - again[0].target) <= 3
    kept = mixing.mix(frame(spark, rows)).collect()
    assert len(kept) == sum(r.copies for r in out) and list(kept[0].asDict()) == ["doc_id", "text", "source", "n", "copies"]


def test_expectation_of_a_draw(spark):
    """Over many sources with the same three documents, each document's mean number of copies is the target's share."""
    rows = [(3 * k + j, "w " * (1 + 2 * j) + str(k), f"s{k:04d}") for k in range(600) for j in range(3)]
    out = mixing.mix_report(frame(spark, rows)).collect()
    mean, want = defaultdict(float), defaultdict(float)
    for r in out:
        mean[r.doc_id % 3] += r.copies / 600
        want[r.doc_id % 3] += r.target / r.source_size / 600
    assert all(mean[j] == pytest.approx(want[j], abs=0.08) for j in range(3))


def test_registered_query_is_native(spark):
    df = queries.op1_mixing(spark, FOLDER)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "source").collect()]
    out = df.collect()
    check(docs, [(r.doc_id, r["size"], r.source_size, r.target, r.taken / max(1, r["size"])) for r in out])
    assert all(r.taken <= 2 * r["size"] for r in out)
