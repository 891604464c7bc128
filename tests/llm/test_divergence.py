"""The divergence audit against plain integer arithmetic."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gristmill.llm import divergence as D

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, term INT, n STRING, value INT"


def found(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(rows, least=3, top=200):
    rows = [(t or "", lang or "", s or "") for t, lang, s in rows]
    out = []
    for lang in {x[1] for x in rows}:
        mine = [(Counter(found(t)), s) for t, x, s in rows if x == lang]
        docs = Counter(term for c, _ in mine for term in c)
        kept = {t for t, n in docs.items() if n >= least}
        counts = defaultdict(Counter)
        for c, s in mine:
            counts[s].update({t: n for t, n in c.items() if t in kept})
        whole = sum(counts.values(), Counter())

        def share(c):
            total = sum(c.values()) + len(kept)
            return {t: 1 + 1000000000 * (c[t] + 1) // total for t in kept}

        q, p = share(whole), {s: share(counts[s]) for s in counts}
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s]
            term = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found_here in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found_here)]
    return sorted(out)


def run(spark, rows, **settings):
    df = spark.createDataFrame([(k, *r, 1, "x", 2) for k, r in enumerate(rows)], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in D.audit(df, **settings).collect())


def corpus(seed=1, n=400):
    r = random.Random(seed)
    words = ["a", "The", "THE", "eightlet", "ninelette", "sixteenlettersxx", "seventeenletters_", "seventeenlettersx", "É", "é", "日本語日本語", "x1y", "İ",
             "long" * 9, "long" * 9 + "e", "Z" * 40, "ab", "abc", "q", "ß"]
    rows = []
    for k in range(n):
        text = "".join(r.choice(words) + r.choice([" ", "\n", "-", "7", "\x00", "\x7f"]) for _ in range(r.randrange(30)))
        text += "".join(r.choices("abcdeF", k=r.randrange(1, 6)))
        rows.append((r.choice([text] * 9 + [None, ""]), r.choice(["en"] * 6 + ["de", "", None]), r.choice(["hot"] * 5 + ["b", "B", "é", "", None, f"s{k % 7}"])))
    return rows + rows[:9] + [("only numbers 12", "xx", "s"), (None, "xx", "t"), (None, "yy", None), ("w w w", "zz", "a"), ("w", "zz", "b"), ("w v", "zz", "b")]


def test_all_terms_and_pairs(spark):
    rows = corpus()
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, least_docs=1, top=3) == plain(rows, 1, 3)


def test_small_blocks(spark, monkeypatch):
    rows = corpus(2, 150)
    want = plain(rows)
    for name, value in (("BLOCK_BYTES", 900), ("PIECE_BYTES", 64), ("BLOCK_DOCS", 7), ("CELLS", 5)):
        monkeypatch.setattr(D, name, value)
    batches = list(D._counted(iter([D.pa.record_batch({n: D.pa.array([r[k] or "" for r in rows]) for n, k in (("l", 1), ("s", 2), ("t", 0))})])))
    got, docs = Counter(), Counter()
    for b in batches:
        for lang, s, t, n, d in zip(*(c.to_pylist() for c in b.columns)):
            got[lang, s, t.decode()] += n
            docs[lang, s, t.decode()] += d
    assert got == Counter((lang or "", s or "", t) for x, lang, s in rows for t in found(x))
    assert docs == Counter((lang or "", s or "", t) for x, lang, s in rows for t in set(found(x)))
    assert run(spark, rows) == want


def test_long_texts_and_nothing(spark):
    rows = [("word " * 900_000 + "other", "en", "a"), ("é" * 1_500_000, "en", "b"), ("é" * 1_500_000 + " word", "en", "b"), ("é" * 1_500_000 + " other word", "en", "c")]
    assert run(spark, rows, least_docs=2) == plain(rows, 2)
    assert run(spark, []) == []
    assert run(spark, [(None, None, None)]) == []


def test_shares_are_exact():
    r = random.Random(4)
    for _ in range(2000):
        total = r.randrange(1, 1 << r.randrange(1, 47))
        n = r.randrange(total)
        assert D.shares(np.array([n]), np.array([total])).tolist() == [1 + 1000000000 * (n + 1) // total]


def test_wide_shares_in_spark(spark):
    df = spark.range(1).selectExpr("9000000000000000000L AS n", "9200000000000000000L AS total")
    from pyspark.sql import functions as F
    assert df.select(D.share(F.col("n"), F.col("total"))).first()[0] == 1 + 1000000000 * 9000000000000000001 // 9200000000000000000


@pytest.mark.parametrize("size", [1, 3000])
def test_radix_order(size):
    r = np.random.default_rng(size)
    words = [r.integers(0, 3, size).astype(np.uint64) << np.uint64(48), r.integers(0, 1 << 40, size).astype(np.uint64) % np.uint64(70000)]
    docs = r.integers(0, 500, size)
    assert D.radix_order(words, docs).tolist() == np.lexsort([docs, words[1], words[0]]).tolist()
