"""Lexical search against plain scores of all pairs."""

import math
import random
import re

from gristmill.llm import lexical_search as S

DOCS = "doc_id BIGINT, text STRING, item_id INT, score STRING"
ITEMS = "item_id BIGINT, text STRING, doc_id INT"


def found(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain(docs, items, k):
    listed = [(i, found(t)) for i, t in docs]
    n_docs, n_all = sum(bool(t) for _, t in listed), sum(len(t) for _, t in listed)
    out = []
    for item, text in items:
        scores = []
        for i, terms in listed:
            m = 100 - 50 + (50 * len(terms) * n_docs // n_all if n_all else 0)
            score = 0
            for term in set(found(text)):
                df = sum(term in t for _, t in listed)
                tf = terms.count(term)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1000000000 * tf // (1000 * tf + 20 * m))
            if score > 0:
                scores.append((-score, i is not None, i or 0))
        out += [(item, r + 1, i if named else None, -s) for r, (s, named, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def run(spark, docs, items, k=50, **settings):
    d = spark.createDataFrame([(*x, 1, "s") for x in docs], DOCS).repartition(5)
    i = spark.createDataFrame([(*x, 1) for x in items], ITEMS)
    return sorted((tuple(r) for r in S.rank_documents(d, i, k, **settings).collect()), key=repr)


def corpus(seed=3, n=260):
    r = random.Random(seed)
    words = ["the", "The", "THE", "é", "É", "a1", "x", "xy", "x-y", "日本", "longer", "İ", "b", "the9", "ß", "don't", "_"]
    say = lambda most: r.choice([" ", "\n", ", ", "\x00"]).join(r.choices(words, k=r.randrange(most)))
    docs = [(k, say(40)) for k in range(n)]
    docs += [(None, say(9)), (None, say(9)), (5, docs[5][1]), (5, "x y the"), (900, None), (901, ""), (902, " ,\n")]
    docs += [(1000 + k, "the x é rare") for k in range(120)]
    items = [(k, say(12)) for k in range(12)] + [(3, "the longer"), (None, "x é"), (77, None), (78, "-"), (79, "rare"), (80, "nowhere"), (81, "the the rare THE")]
    return docs, items


def test_all_pairs(spark):
    docs, items = corpus()
    for k in (3, 50):
        assert run(spark, docs, items, k) == plain(docs, items, k)


def test_blocks_of_items_and_cuts_in_a_task(spark, monkeypatch):
    docs, items = corpus(4, 500)
    want = plain(docs, items, 50)
    assert run(spark, docs, items, block_bytes=12) == want and run(spark, docs, items, block_items=1) == want
    best = S._Best(2, 3)
    best.room = 4
    rows = [(k, s, i) for i, (k, s) in enumerate([(0, 5), (0, 5), (1, 1), (0, 9), (0, 5), (0, 7), (1, 0), (0, 5), (0, 8)])]
    import numpy as np
    for item, score, i in reversed(rows):
        one = np.zeros((1, 2), np.int64)
        one[0, item] = score
        best.put(one, [(i, 0)])
    assert best.cut().T.tolist() == [[0, -9, 3, 0], [0, -8, 8, 0], [0, -7, 5, 0], [1, -1, 2, 0]]


def test_long_text_and_nothing(spark):
    docs = [(1, "the x " * 300_000), (2, "y" * 1_000_000), (3, "the"), (4, "y" * 1_000_000 + " " + "y" * 300 + " Y" + "y" * 299), (5, "y" * 256)]
    docs += [(6, "y" * 257 + "\n" + "y" * 256), (7, "y" * 258)]
    items = [(0, "the x"), (1, "y" * 1_000_000), (2, "y" * 257 + " " + "y" * 300), (3, "y" * 256), (4, "y" * 259)]
    assert run(spark, docs, items) == plain(docs, items, 50)
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], items) == []
