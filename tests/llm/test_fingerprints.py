"""Fingerprints: pairing against a plain version, edit distance against a table, and likeness of near texts."""

import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from gristmill.llm import fingerprints, queries

FOLDER = "/root/testdata/sf0.001"


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[:len(text) - half] + after[:half]
        a, b, c = map(fingerprints.fingerprint, (text, changed, after))
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    return sorted(out, key=repr)


def test_odd_rows(spark):
    r = random.Random(2)
    rows = [(k, "".join(r.choice("abc dé\n") for _ in range(r.choice([0, 1, 2, 9, 700])))) for k in range(90)]
    rows += [(None, "no id"), (300, None), (301, ""), (302, "x" * 30000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id BIGINT, text STRING, part INT, first_text STRING")
    out = fingerprints.fingerprint_documents(docs.repartition(7))
    assert sorted((tuple(x) for x in out.collect()), key=repr) == brute(rows)
    assert out.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert fingerprints.fingerprint_documents(docs.limit(0)).count() == 0
    lone = fingerprints.fingerprint_documents(docs.filter("doc_id = 1"))
    assert [tuple(x) for x in lone.collect()] == brute([rows[1]])
    again = docs.filter("doc_id = 302").unionAll(docs.filter("doc_id = 302"))
    assert fingerprints.fingerprint_documents(again).count() == 2


@given(st.text("abc", max_size=40), st.text("abc", max_size=40))
def test_common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    assert fingerprints.common_length(a, b) == row[-1]


def _next(row, x, b):
    out = [0]
    for k, y in enumerate(b):
        out.append(row[k] + 1 if x == y else max(row[k + 1], out[-1]))
    return out


def test_near_texts_are_like():
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(3000)]
    text = " ".join(words)
    near = " ".join(words[:1500] + ["changed"] + words[1501:])
    other = " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(3000))
    a, b, c = map(fingerprints.fingerprint, (text, near, other))
    assert fingerprints.likeness(a, b) > 0.9 and fingerprints.likeness(a, c) == 0
    assert fingerprints.likeness(a, fingerprints.fingerprint(text)) == 1
    assert fingerprints.likeness(a, fingerprints.fingerprint(" ".join(words[:2200]))) > 0.4


def test_periodic_texts_of_any_length():
    """Ten megabytes of a short period: signatures are bounded, and half of another text makes them half alike."""
    for period in ("a", "ab", "0123456789", "é", "\x00", "abcdefghijklmnopqrstuvwxyz "):
        size = 10_000_000 // len(period.encode())
        text = period * size
        own, changed = fingerprints.fingerprint(text), fingerprints.fingerprint(fingerprints.edited(text, "Q" * size))
        _, first, second = own.split(":")
        assert 32 <= len(first) <= 129 and len(second) <= 129
        assert fingerprints.likeness(own, own) == 1 and fingerprints.likeness(own, changed) < 0.8
        assert all(len(x) <= 129 for x in changed.split(":"))


def test_short_signatures_are_not_alike():
    assert fingerprints.signature_likeness("A", "A") == 0 and fingerprints.signature_likeness("ABCDEF", "ABCDEF") == 0
    assert fingerprints.signature_likeness("ABCDEFG", "ABCDEFG") == 1
    assert fingerprints.likeness(fingerprints.fingerprint("abc"), fingerprints.fingerprint("abc")) == 1
    assert fingerprints.likeness(fingerprints.fingerprint("abc"), fingerprints.fingerprint("abd")) == 0
    assert fingerprints.likeness(fingerprints.fingerprint(""), fingerprints.fingerprint("")) == 1


def test_registered_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op10_fingerprints(spark, FOLDER).collect()), key=repr) == brute(rows)
