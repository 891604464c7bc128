"""Language, quality and licence scans: parts against plain versions, the rest by held-out accuracy."""

import base64
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gristmill.llm import langid, license_scan, quality_rules, queries, rows

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
BLANK = " \t\n\x0b\x0c\r"
PATH = langid.public_tokenizers.path(langid.DEFAULT_VOCABULARY)


def plain_probability(word, chance, known=None):
    known = {"": 1.0} if known is None else known
    if word not in known:
        known[word] = sum(chance(word[:k]) * plain_probability(word[k:], chance, known) for k in range(1, len(word) + 1))
    return known[word]


def test_forward_sums_all_segmentations():
    vocabulary = langid.pieces(PATH)
    table = np.random.default_rng(0).random((vocabulary.count + 2, 2))
    table[-2], table[-1] = 0, 1e-7

    def chance(piece, language):
        at = int(vocabulary.find(langid._hash(langid._codes([piece])))[0])
        return table[at, language] if at < vocabulary.count else 1e-7 * (len(piece) == 1)

    words = [" the", " größe", " xq", " ééé", " a", " segment", " responsibilities", " internationalxx", " verantwortung"]
    got = langid.log_probabilities(words, table, vocabulary)
    for k, w in enumerate(words):
        for language in (0, 1):
            assert got[k, language] == pytest.approx(math.log(plain_probability(w, lambda p: chance(p, language))))
    one = table[:, :1]
    uses = langid.expected_uses([" the"], np.array([3.0]), one, vocabulary)
    eps, at = 1e-6, int(vocabulary.find(langid._hash(langid._codes([" the"])))[0])
    more = one.copy()
    more[at] *= 1 + eps
    slope = (langid.log_probabilities([" the"], more, vocabulary) - langid.log_probabilities([" the"], one, vocabulary))[0, 0] / eps
    assert uses[at] == pytest.approx(3 * slope, rel=1e-3)


def test_no_piece_is_left_out():
    vocabulary = langid.pieces(PATH)
    found = set()
    with open(PATH) as file:
        for line in file:
            try:
                piece = base64.b64decode(line.split()[0]).decode().lower()
            except UnicodeDecodeError:
                continue
            if piece.removeprefix(" ").isalpha():
                found.add(piece)
    assert vocabulary.count == len(found) and vocabulary.longest == max(map(len, found)) > 9
    for piece in sorted(found, key=len)[-200:]:
        assert vocabulary.find(langid._hash(langid._codes([piece])))[0] < vocabulary.count


def test_rows_that_share_an_id_are_not_learned_from(spark):
    rows = [(k, "the and of that with", "en") for k in range(20)] + [(k, "der die das und nicht", "de") for k in range(20, 40)]
    foreign = [(k, "der die das und nicht " * 50, None) for k in range(20)] + [(k, "the and of that with " * 50, None) for k in range(20, 40)]
    schema = "doc_id BIGINT, text STRING, lang STRING"
    learn = F.col("doc_id").isNotNull()
    plain = langid.train(spark.createDataFrame(rows, schema), learn)
    mixed = langid.train(spark.createDataFrame(rows + foreign, schema), learn)
    assert plain.languages == mixed.languages == ["de", "en"] and np.allclose(plain.table, mixed.table)


def test_language_of_odd_rows(spark):
    rows = [(k, text, lang) for k, (text, lang) in enumerate([("the and of that with", "en"), ("der die das und nicht", "de")] * 30)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 !?", "de"), (103, "THE AND OF", None), (104, "und-die_das", None), (None, "the of and", "en"),
             (105, "the" * 30000, "en"), (106, "Ω", None), (107, "der die", "en"), (107, "der die", "en")]
    docs = spark.createDataFrame([(i, t, x, 1) for i, t, x in rows], "doc_id BIGINT, text STRING, lang STRING, score INT")
    out = langid.report(docs).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert [by[k].lang_pred for k in (100, 101, 102, 103, 104, None, 106)] == ["und", "und", "und", "en", "de", "en", "de"]
    assert all(0 <= r.score <= 1 for r in out) and by[102].score == 0
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert langid.report(docs.limit(0)).count() == 0
    unlearned = langid.report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlearned} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    found = queries.op5_language_id(spark, LARGER).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(found) > 250 and np.mean([r.lang == r.lang_pred for r in found]) > 0.98


def plain_counts(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in BLANK:
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    lines = (text or "").split("\n")
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    times = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    duplicates = sum(x in lines[:k] and any(c not in BLANK for c in x) for k, x in enumerate(lines))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), duplicates, len(covered), n < 50 or 100 * len(covered) > 50 * n


ODD = [None, "", "\n\n", "a b c a b c", "é\xa0x # $ <|>", "same line\nsame line\n\n\n \n ", "w " * 60, "a b\x1cc", "x\ty\x0bz " * 30]


def test_base_counts():
    r = random.Random(3)
    texts = ODD + ["".join(r.choice(["a ", "b ", "c\n", "é", " ", "\n", "|"]) for _ in range(r.randrange(120))) for _ in range(300)]
    for t in texts:
        assert (*quality_rules.base_counts(t or ""), quality_rules.base_failed(quality_rules.base_counts(t or "")[0], quality_rules.base_counts(t or "")[4])) == plain_counts(t)


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(5)
    for n in range(1, 8):
        field = quality_rules.Field(r.normal(size=(quality_rules.FEATURES, 2)), r.normal(size=(2, 2)))
        rows = r.normal(size=(n, quality_rules.FEATURES))
        value = lambda marks: sum((rows[k] @ field.weights)[m] for k, m in enumerate(marks)) + sum(field.steps[a, b] for a, b in itertools.pairwise(marks))  # noqa: B023, E731
        assert tuple(field.decode(rows.tolist())) == max(itertools.product((0, 1), repeat=n), key=value)


def test_expected_sums_are_those_of_all_paths():
    r = np.random.default_rng(7)
    lengths = np.array([1, 4, 3])
    x = r.normal(size=(3, 4, quality_rules.FEATURES)) * (np.arange(4) < lengths[:, None])[:, :, None]
    weights, steps = r.normal(size=(quality_rules.FEATURES, 2)), r.normal(size=(2, 2))
    sums, pairs = np.zeros((quality_rules.FEATURES, 2)), np.zeros((2, 2))
    for rows, n in zip(x, lengths):
        paths = list(itertools.product((0, 1), repeat=int(n)))
        chance = np.exp([sum(rows[k] @ weights[:, m] for k, m in enumerate(p)) + sum(steps[a, b] for a, b in itertools.pairwise(p)) for p in paths])
        for p, c in zip(paths, chance / chance.sum()):
            for k, m in enumerate(p):
                sums[:, m] += c * rows[k]
            for a, b in itertools.pairwise(p):
                pairs[a, b] += c
    got = quality_rules._expected(x, lengths, weights, steps)
    assert np.allclose(got[0], sums) and np.allclose(got[1], pairs)


def test_seams_bear_the_marks_of_both_sides():
    good, bad = ([np.full((n, quality_rules.FEATURES), mark) for n in sizes] for mark, sizes in ((1.0, [3, 1, 40]), (0.0, [2, 9])))
    out = quality_rules.seamed(good, bad, 20)
    assert len(out) == 12 and all(0 < len(x) == len(marks) <= 20 and (x[:, 0] == marks).all() for x, marks in out)
    assert repr(out) == repr(quality_rules.seamed(good, bad, 20)) and sum(len(set(m)) == 2 for _, m in out) > 8


def test_mixed_texts_get_mixed_marks(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    field = quality_rules.train(docs, labels.filter("doc_id % 2 = 0"))
    rows = docs.join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("text IS NOT NULL").orderBy("doc_id").select("quality", "text").collect()
    lines = {q: [[x for x in r.text.split("\n") if x.split()] for r in rows if r.quality == q] for q in (0, 1)}
    right = total = mixed = 0
    pairs = list(zip([x[:12] for x in lines[1] if len(x) >= 6], [x[:3] for x in lines[0] if x]))
    for a, b in pairs:
        for parts in ((a, 1, b, 0), (b, 0, a, 1)):
            text, want = parts[0] + parts[2], [parts[1]] * len(parts[0]) + [parts[3]] * len(parts[2])
            marks = field.decode(quality_rules.line_features("\n".join(text))[0])
            right += sum(x == y for x, y in zip(marks, want))
            total += len(want)
            mixed += len(set(marks)) == 2 and 0 < quality_rules.judged("\n".join(text), field)[-1] < 1
    assert len(pairs) > 100 and right > 0.95 * total and mixed > 0.85 * 2 * len(pairs)


def test_odd_rows_are_judged(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "w " * 70), (3, "again " * 80), (3, "again " * 80), (20, "x " * 100000)]
    docs = spark.createDataFrame([(i, t, True, 1) for i, t in rows], "doc_id BIGINT, text STRING, kept BOOLEAN, quality INT")
    labels = spark.createDataFrame([(0, None), (None, 1), (3, 0)], "doc_id BIGINT, quality INT")
    assert quality_rules.train(docs, labels) is None
    out = quality_rules.judge(docs, None).collect()
    assert sorted(map(repr, (tuple(r[:7]) for r in out))) == sorted(repr((i, *plain_counts(t))) for i, t in rows)
    assert all(r.kept == (not r.base_failed) for r in out)
    assert quality_rules.judge(docs.limit(0), None).count() == 0


def test_quality_of_unseen_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    field = quality_rules.train(docs, labels.filter("doc_id % 2 = 0"))
    unseen = docs.join(labels.filter("doc_id % 2 = 1").select("doc_id", "quality"), "doc_id")
    out = quality_rules.judge(unseen, field).filter("NOT base_failed").join(labels, "doc_id").select("quality", "kept").collect()
    good = [r.kept for r in out if r.quality == 1]
    bad = [r.kept for r in out if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_registered_quality_rules(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    field = quality_rules.train(docs, labels)

    def kept(text):
        found, sizes = quality_rules.line_features(text or "")
        marks = max_path(field, found)
        return sum(s for s, m in zip(sizes, marks) if m) >= quality_rules.CONTENT * sum(sizes)

    want = sorted((r.doc_id, *plain_counts(r.text), not plain_counts(r.text)[-1] and kept(r.text)) for r in docs.collect())
    assert sorted(tuple(r[:8]) for r in queries.op6_quality_rules(spark, FOLDER).collect()) == want


def max_path(field, found):
    """Marks of the best path, by best scores of all beginnings."""
    best = {(): 0.0}
    for k, row in enumerate(found):
        longer = {(*p, m): v + np.dot(row, field.weights[:, m]) + (field.steps[p[-1], m] if p else 0) for p, v in best.items() for m in (0, 1)}
        best = {p: longer[p] for m in (0, 1) for p in [max((q for q in longer if q[-1] == m), key=longer.get)]}
    return max(best, key=best.get)


@pytest.mark.parametrize("expression, labels, score", [
    ("mit", {"mit"}, 1.0), ("mit and gpl-2.0-only", {"mit", "gpl"}, 0.3), ("mit or gpl-2.0-only", {"mit", "gpl"}, 1.0),
    ("gpl-3.0+ with classpath-exception-2.0", {"gpl"}, 0.5), ("mit or gpl-2.0 and agpl-3.0", {"mit", "gpl", "agpl"}, 1.0),
    ("(mit or gpl-2.0) and agpl-3.0", {"mit", "gpl", "agpl"}, 0.2), ("strange-1.0", {"strange-1.0"}, 0.0), ("", set(), 0.0),
    (") and (mit or", {"mit"}, 1.0), ("mit gpl-2.0", {"mit", "gpl"}, 0.3), ("((apache-2.0))", {"apache"}, 1.0), ("with mit with", {"mit"}, 1.0),
    ("()", set(), 0.0), ("( or ) mit", {"mit"}, 1.0), ("mit ) )", {"mit"}, 1.0), ("mit and ( )", {"mit"}, 1.0),
])
def test_expressions(expression, labels, score):
    got = license_scan.evaluate(license_scan._TOKEN.findall(expression))
    assert got[0] == labels and got[1] == pytest.approx(score)


@pytest.mark.parametrize("line, labels, score", [
    ("MIT -->", "mit", 1.0), ("MIT. This file is part of the project", "mit", 1.0), ("MIT */", "mit", 1.0), ("(MIT OR Apache-2.0) */", "apache,mit", 1.0),
    ("GPL-2.0-only WITH Classpath-exception-2.0.", "gpl", 0.5), ("BSD-3-Clause AND this file", "bsd", 1.0), ("MIT Apache-2.0", "mit", 1.0), ("NONE", "", 0.0),
    ("NOASSERTION", "", 0.0), ("LicenseRef-Own-1", "licenseref-own-1", 0.0), ("LicenseRef-", "", 0.0), ("Zlib OR MIT", "mit,zlib", 1.0), ("see the file", "", 0.0),
    ("", "", 0.0), ("(MIT AND (GPL-3.0+ OR", "gpl,mit", 0.3), ("MIT)", "mit", 1.0), ("cc-by-sa-4.0, all of it", "cc-by,cc-by-sa", 0.6), ("mit-like", "", 0.0), ("with MIT", "", 0.0),
    ("and", "", 0.0), ("MIT AND AND MIT", "mit", 1.0), ("MIT WITH", "mit", 1.0), ("()", "", 0.0), ("MIT or later", "mit", 1.0), ("Apache-2.0 #", "apache", 1.0),
])
def test_expression_after_a_tag(line, labels, score):
    for text in (f"<!-- SPDX-License-Identifier: {line}", f"// spdx-license-identifier:{line}\nmore text of the file"):
        got = license_scan.scan(text)
        assert got[5] == labels and got[6] == pytest.approx(score)


def test_many_tags_and_long_lines():
    got = license_scan.scan("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: GPL-2.0\nthe apache license")
    assert got[5] == "apache,gpl,mit" and got[6] == pytest.approx(0.3)
    assert license_scan.scan("SPDX-License-Identifier: " + "(" * 50_000 + "MIT")[5] == "mit"
    assert license_scan.scan("SPDX-License-Identifier: " + "MIT OR " * 50_000)[5] == "mit"


def plain_scan(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if ord(c) >= 128 or c.isalnum():
            word += c.lower() if ord(c) < 128 else c
        else:
            words += [word] * bool(word)
            word = ""
    places = [(k, label) for phrase, label in license_scan.BASE.items() for k in range(len(words)) if words[k:k + len(phrase.split())] == phrase.split()]
    return (len(words), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places})))


def test_scan(spark):
    r = random.Random(6)
    parts = ["GNU", "general", "Public", "license", "Apache", "license", "cc", "by", "by-nc", "mit", "é", "MIT-License.", "x_y", "redistribution and use", "\n", "ſ"]
    texts = [None, "", "GNU General\nPublic   License cc by cc by", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0 WITH x"]
    texts += [r.choice([" ", ", "]).join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(400)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "mit license"), (1, ""), (1, ""), (9999, "cc by " * 50000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id BIGINT, text STRING, labels STRING")
    out = license_scan.scan_documents(docs).collect()
    assert sorted(map(repr, (tuple(x[:6]) for x in out))) == sorted(repr((i, *(plain_scan(t) if i != 9999 else (100000, 50000, 0, 99998, "cc-by")))) for i, t in rows)
    for x in out:
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1
        assert x.labels.split(",") == sorted(set(x.labels.split(",")))
    assert next(x for x in out if x.doc_id == 3).labels == "apache,gpl,mit" and next(x for x in out if x.doc_id == 3).score == pytest.approx(0.5)
    assert license_scan.scan_documents(docs.limit(0)).count() == 0


def test_registered_scan(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.op7_license_scan(spark, FOLDER).collect()
    assert sorted(map(repr, (tuple(x[:6]) for x in out))) == sorted(repr((i, *plain_scan(t))) for i, t in rows)
    assert pa.array([x.n_base for x in out]).sum().as_py() > 0


def test_hashed_sample(spark):
    numbers = spark.range(5000).selectExpr("id AS _id", "CASE WHEN id % 10 = 0 THEN 'b' ELSE 'a' END AS g")
    order = [(r.g, r._id) for r in numbers.orderBy(F.xxhash64("_id")).collect()]
    want = [x for x in order if x[0] == "a"][:40] + [x for x in order if x[0] == "b"][:40]
    assert sorted((r.g, r._id) for r in rows.hashed_sample(numbers, "g", 40).collect()) == sorted(want)
