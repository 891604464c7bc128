import math
import random
import re
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristmill import fixed_values as fv
from gristmill.operators import keywords as K
from gristmill.operators import recall as R
from gristmill.operators import similarity as S
from gristmill.plans import reports as RP
from gristmill import session


def lists(rows, *texts, top_n=20):
    df = rows("i INT, t STRING", *enumerate(texts))
    return [r.keywords for r in K.keyword_lists(df, "i", "t", top_n).orderBy("i").collect()]


def test_keyword_rules(rows):
    got = lists(rows, "beta alpha beta. Alpha gamma - experience", "CI/CD and Node.js; X/Y Testing", "", None, "the of", "word")
    assert got[0] == ["beta", "alpha", "gamma", "experience", "beta alpha", "alpha beta", "alpha gamma", "gamma -", "- experience"]
    assert got[1] == ["node", "testing", "ci cd", "node js", "js x", "x y", "y testing"]
    assert got[2:] == [[], [], [], ["word"]]


def test_top_n_cuts_words_and_half_the_pairs(rows):
    text = " ".join(f"word{i} word{i}" for i in range(40))
    (kw,) = lists(rows, text)
    assert kw[:20] == [f"word{i}" for i in range(20)]
    assert len(kw) == 30 and all(" " in k for k in kw[20:])
    (few,) = lists(rows, text, top_n=4)
    assert len(few) == 6


def brute_cosines(texts):
    import re

    vectors = [Counter(t for t in re.findall(fv.TOKEN_PATTERN, x.lower()) if t not in fv.TOKEN_STOPWORDS) for x in texts]

    def cosine(a, b):
        dot = sum(a[t] * b[t] for t in a)
        norm = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
        return dot / norm if norm else 0.0

    return [cosine(a, b) for a, b in combinations(vectors, 2)]


def check_similarity(rows, texts, block):
    df = rows("i INT, t STRING", *enumerate(texts))
    sims = brute_cosines(texts)
    n = len(sims)
    mean = sum(sims) / n if n else 0.0
    sd = math.sqrt(sum((s - mean) ** 2 for s in sims) / (n - 1)) if n > 1 else 0.0
    for side in (S.TEXTS, S.TOKENS):
        got = S.pairwise_cosine_stats(df, "t", side, block_texts=block).first()
        assert got.n_pairs == n
        assert [got.cosine_mean, got.cosine_min, got.cosine_max] == pytest.approx([mean, min(sims, default=0.0), max(sims, default=0.0)], abs=1e-9)
        moments = S.cosine_moments(df, "t", side, block).first()
        assert (moments.n_texts, moments.n_pairs) == (len(texts), n)
        # Sums are subtracted, so a deviation of 0 comes out as the root of their rounding.
        assert [moments.cosine_mean, moments.cosine_stdev, got.cosine_stdev] == pytest.approx([mean, sd, sd], abs=1e-6)
    linear = S.mean_pairwise_cosine(df, "i", "t").first()
    assert (linear.n_texts, linear.n_pairs) == (len(texts), n) and linear.cosine_mean == pytest.approx(mean, abs=1e-9)


@pytest.mark.parametrize("texts", [
    ["alpha beta gamma"], ["alpha beta", "alpha beta"], ["alpha beta", "gamma delta"], ["the and", "the"], ["the", "alpha beta", "", "alpha"],
])
def test_similarity_small_cases(rows, texts):
    check_similarity(rows, texts, 1024)


def test_similarity_against_brute_force_with_copies_and_blocks(rows):
    rnd = random.Random(7)
    vocabulary = [f"tok{i}" for i in range(40)] + ["the", "and"]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randint(0, 25))) for _ in range(60)]
    texts += [texts[0]] * 30 + [texts[1].upper()] * 5
    check_similarity(rows, texts, 7)
    check_similarity(rows, texts, 1024)


def test_long_texts_in_pieces_and_batches(rows, spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        check_similarity(rows, [" ".join(f"tok{(i * j) % 11}" for j in range(12)) for i in range(20)] + [" ".join(f"w{k}x tok{k}" for k in range(300))], 5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_extremes_without_copies_or_zeros(rows):
    """No two texts are equal; every two share a token, so no pair of similarity 0 can be proven."""
    rnd = random.Random(11)
    texts = [" ".join(["common"] + rnd.sample([f"tok{k}" for k in range(60)], rnd.randint(1, 12))) + f" own{i}" for i in range(70)]
    df = rows("i INT, t STRING", *enumerate(texts))
    assert not S.zero_pair_proven(df, "t").first().proven
    sims = brute_cosines(texts)
    got = S.pairwise_cosine_stats(df, "t", S.TOKENS, 16).first()
    assert min(sims) > 0 and [got.cosine_min, got.cosine_max] == pytest.approx([min(sims), max(sims)], abs=1e-12)
    bins = S.similarity_histogram(df, "t", block_texts=16).orderBy("bin").collect()
    width = (max(sims) - min(sims)) / 20
    want = Counter(min(19, int((x - min(sims)) / width)) for x in sims)
    assert [b.n for b in bins] == [want[k] for k in range(20)]


@pytest.mark.parametrize("texts, proven", [
    (["alpha beta", "beta gamma", "gamma delta"], True), (["alpha beta", "the", "alpha"], True), (["alpha beta", "alpha", "beta alpha"], False),
    (["alpha"], False), (["the"], False), ([], False), (["alpha", "alpha"], False), (["the", "the"], True),
])
def test_proof_of_a_zero_pair(rows, texts, proven):
    df = rows("i INT, t STRING", *enumerate(texts))
    assert S.zero_pair_proven(df, "t").first().proven == proven
    assert (min(brute_cosines(texts), default=1.0) == 0) == proven


def test_tokens_route_meets_all_texts_only_without_a_proof(spark, rows):
    df = rows("i INT, t STRING", *enumerate(["alpha beta", "beta gamma", "gamma delta"]))
    got = S.pairwise_cosine_stats(df, "t", S.TOKENS)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_histogram_counts_every_pair(rows):
    texts = ["alpha beta", "alpha beta", "alpha gamma", "delta words", "beta delta"]
    df = rows("i INT, t STRING", *enumerate(texts))
    bins = S.similarity_histogram(df, "t").orderBy("bin").collect()
    assert len(bins) == 20 and sum(b.n for b in bins) == 10 and bins[19].n == 1
    flat = S.similarity_histogram(df.filter("i < 2"), "t").collect()
    assert sum(b.n for b in flat) == 1


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab -,", max_size=30), min_size=1, max_size=6))
def test_keywords_against_a_counter(rows, texts):
    import re

    expected = []
    for text in texts:
        words = re.findall("[a-z0-9-]+", text)
        singles = Counter(w for w in words if w not in fv.KEYWORD_STOPWORDS and len(w) > 2)
        pairs = Counter(f"{a} {b}" for a, b in zip(words, words[1:]) if not {a, b} & set(fv.KEYWORD_STOPWORDS))
        expected.append([w for w, _ in singles.most_common(4)] + [p for p, _ in pairs.most_common(2)])
    assert lists(rows, *texts, top_n=4) == expected


def test_recall(spark, rows):
    # Families whose skills have punctuation lose one of five.
    docs = rows("id STRING, role_family STRING, description STRING", *[
        (f, f, f"Stack: {', '.join(skills)}. " * 3) for f, skills in fv.FAMILY_SKILLS.items()])
    got = R.recall_rows(docs, K.keyword_lists(docs, "id", "description"), R.skills_table(spark))
    recall = {r.role_family: r.recall for r in got.collect()}
    low = {"Data Scientist", "Full Stack Engineer", "Platform Engineer"}
    assert recall == {f: 0.8 if f in low else 1.0 for f in fv.FAMILY_SKILLS}
    summary = R.recall_summary(got).first()
    assert summary.perfect_docs == 7 and summary.recall_min == 0.8
    empty = rows("k ARRAY<STRING>, s ARRAY<STRING>", (["x"], []), (["ab cd"], ["B c", "zz"]))
    assert [r.v for r in empty.select(R.skill_recall(F.col("s"), F.col("k")).alias("v")).collect()] == [1.0, 0.5]


def test_recall_summary_golden(rows):
    df = rows("role_family STRING, recall DOUBLE, n_keywords INT, bigram_share DOUBLE",
              *[("a", 1.0, 30, 1 / 3)] * 105, *[("b", 0.8, 30, 1 / 3)] * 45)
    s = R.recall_summary(df).first()
    assert (round(s.recall_mean, 3), s.recall_min, s.recall_max, s.perfect_docs, round(s.bigram_share_mean, 3)) == (0.94, 0.8, 1.0, 105, 0.333)


def test_token_pairs_by_block_are_summed_whole_and_never_shuffled(rows, monkeypatch):
    """Common and rare tokens in many blocks, texts in many chunks, and more pairs of a token than are summed at a time."""
    for name, value in {"COMMON": 5, "BLOCK_TOKENS": 12, "RARE": 90, "STRIPE": 3, "PIECE": 1 / 64}.items():
        monkeypatch.setattr(S, name, value)
    rnd = random.Random(3)
    texts = [" ".join(rnd.choices([f"tok{k}" for k in range(30)], k=rnd.randint(0, 20)) + [f"rare{rnd.randint(0, 60)}" for _ in range(4)]) for _ in range(50)]
    df = rows("i INT, t STRING", *enumerate(texts)).repartition(5)
    kept = S._keep(df, "t")
    sums = S._sums(kept)
    got, sims = sums.first(), brute_cosines(texts)
    assert len(kept.common) > 24 and kept.n_rare > 90
    assert [got.s1, got.s2] == pytest.approx([sum(sims), sum(x * x for x in sims)], rel=1e-12)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Join" not in plan


def test_each_pair_of_blocks_of_tokens_is_a_task(rows, monkeypatch):
    """Not all pairs of blocks in one."""
    for name, value in {"COMMON": 2, "BLOCK_TOKENS": 4, "RARE": 20, "PART": 30}.items():
        monkeypatch.setattr(S, name, value)
    rnd = random.Random(5)
    texts = [" ".join(rnd.choices([f"tok{k}" for k in range(16)], k=12)) + f" own{i}" for i in range(40)]
    kept = S._keep(rows("i INT, t STRING", *enumerate(texts)), "t")
    tiles = S._tiles(kept)
    n_blocks = len(S._dealt(kept.df)[2]) + 2
    assert n_blocks == 6 and tiles.rdd.getNumPartitions() >= n_blocks * (n_blocks + 1) // 2
    q = tiles.agg(F.sum("q")).first()[0]
    assert (q - len(texts)) / 2 == pytest.approx(sum(x * x for x in brute_cosines(texts)), rel=1e-12)


def test_route_of_texts_is_left_to_few_blocks(rows, monkeypatch):
    """More texts than MOST_BLOCKS blocks are not copied once per block."""
    monkeypatch.setattr(S, "MOST_BLOCKS", 2)
    monkeypatch.setattr(S, "_totals", None)
    texts = ["alpha beta", "beta gamma", "gamma delta", "alpha", "alpha beta"]
    df = rows("i INT, t STRING", *enumerate(texts))
    sims = brute_cosines(texts)
    got = S.pairwise_cosine_stats(df, "t", S.TEXTS, block_texts=2).first()
    assert [got.cosine_mean, got.cosine_min, got.cosine_max] == pytest.approx([sum(sims) / 10, 0.0, 1.0], abs=1e-12)
    moments = S.cosine_moments(df, "t", S.TEXTS, 2).first()
    assert moments.n_pairs == 10 and moments.cosine_stdev == pytest.approx(got.cosine_stdev, abs=1e-12)


@pytest.mark.parametrize("made", [
    lambda d: K.top_keywords(d, "i", "t"), lambda d: K.keyword_lists(d, "i", "t"), lambda d: K.term_frequencies(d, "i", "t"),
    lambda d: S.unit_weights(K.term_frequencies(d, "i", "t"), "i"),
    lambda d: RP.recall_report(d.withColumn("role_family", F.lit("f")), d.sparkSession.createDataFrame([("f", ["x"])], "role_family STRING, skills ARRAY<STRING>"), "i", "t"),
])
def test_pieces_grow_in_number_not_in_size(rows, tmp_path, monkeypatch, made):
    """Words are counted in pieces of a bounded size, whose number adaptive coalescing does not lower."""
    rows("i INT, t STRING", *[(i, f"alpha beta gamma{i}") for i in range(2000)]).coalesce(1).write.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(session, "PIECE_BYTES", 500)
    docs = rows("i INT, t STRING").sparkSession.read.parquet(str(tmp_path / "d"))
    n = session.pieces(docs)
    assert 8 < n < 1000
    assert "REPARTITION_BY_NUM" in (plan := made(docs)._jdf.queryExecution().executedPlan().toString())
    assert max(int(x) for x in re.findall(r"hashpartitioning\(i#\d+, (\d+)\), REPARTITION_BY_NUM", plan)) > 8
