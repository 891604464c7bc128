"""SimHash components and line dedup against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import xxhash

from gristmill.llm import components, line_dedup, queries, simhash

FOLDER = "/root/testdata/sf0.001"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\x0c\r"


def low(text):
    return text.translate(str.maketrans(UPPER, LOWER))


def plain_print(text):
    words, word = [], ""
    for c in low(text or "") + " ":
        if c in BLANK:
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=2):
    prints = [plain_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[root(k)].append(i)
    return sorted(((i, f"{prints[k]:016x}", min((x for x in least[root(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)), key=repr)


def found(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id BIGINT, text STRING, fp INT, component INT")
    out = simhash.near_duplicates(docs).selectExpr("IF(_id = -9223372036854775808, NULL, _id)", "lower(lpad(hex(fp), 16, '0'))", "component")
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_components_of_texts(spark):
    r = random.Random(1)
    base = [" ".join(r.choice("abcdefghij") * 2 for _ in range(200)) for _ in range(12)]
    rows = []
    for k in range(260):
        words = r.choice(base).split()
        for _ in range(r.randrange(3)):
            words[r.randrange(len(words))] = r.choice(["ZZ", "é", "new"])
        rows.append((1000 - k, r.choice([" ", "\n", "\t"]).join(words)))
    rows += [(3, None), (4, ""), (5, "\n \t"), (6, "One"), (7, "one two"), (None, "one two"), (None, "no id"), (8, "one two"), (8, "one two"), (9, "w " * 20000)]
    assert found(spark, rows) == plain_components(rows)
    assert found(spark, rows[:0]) == []


def test_links_of_chains_and_tiles(spark):
    """Chains whose ends are far apart, and small tiles, so that cells are split."""
    r = np.random.default_rng(4)
    values = set()
    for _ in range(20):
        x = int(r.integers(0, 2**63))
        for _ in range(60):
            values.add(x)
            x ^= 1 << int(r.integers(0, 64)) | 1 << int(r.integers(0, 64))
    values = sorted(values)
    signed = [v - (v >> 63 << 64) for v in values]
    distinct = spark.createDataFrame([(v,) for v in signed], "fp BIGINT")
    found = {x.node: x.component for x in components.components(simhash.links(distinct, tile=2)).collect()}
    parent = {v: v for v in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in enumerate(values):
        for y in range(a):
            if (x ^ values[y]).bit_count() <= 2:
                parent[root(signed[a])] = root(signed[y])
    least = {}
    for v in signed:
        least[root(v)] = min(v, least.get(root(v), v))
    sizes = Counter(root(v) for v in signed)
    assert found == {v: least[root(v)] for v in signed if sizes[root(v)] > 1}


def test_dense_group_leaves_a_forest():
    dense = np.array([1 << a for a in range(60)], np.uint64)
    assert len(simhash.forest(dense, dense, 2)) == 59


def test_registered_simhash(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op2_simhash(spark, FOLDER).collect()), key=repr) == plain_components(rows)


def plain_lines(rows, length=20, documents=3):
    key = lambda line: low(line.strip(BLANK))
    order = lambda i: -(1 << 63) if i is None else i
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(order(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < length or len(holders[key(x)]) < documents or max(holders[key(x)]) == order(i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_lines(spark, monkeypatch):
    r = random.Random(8)
    lines = ["Twenty code points ok", "twenty CODE points OK", "  twenty code points ok\t", "nineteen is too few", "ééééééééééééééééééééé", "\xa0twenty code points ok",
             "", " ", "x", "this one stands in just two of them", "a line of plain text that many texts share"]
    rows = [(k, "\n".join(r.choice(lines + [f"own line number {k} of this text"]) for _ in range(r.randrange(9)))) for k in range(60)]
    rows += [(70, None), (71, ""), (None, lines[0]), (72, lines[4] + "\n" + lines[4]), (73, lines[4]), (74, lines[4]), (80, "\n".join([lines[-1]] * 30000))]
    rows += [(90, "only ever in documents with one id"), (90, "only ever in documents with one id"), (90, "only ever in documents with one id\n"), (91, rows[0][1]), (91, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id BIGINT, text STRING, key STRING, n INT")
    assert sorted((tuple(x) for x in line_dedup.without_shared_lines(docs).collect()), key=repr) == plain_lines(rows)
    assert line_dedup.without_shared_lines(docs.limit(0)).count() == 0
    monkeypatch.setattr(line_dedup, "MOST_FREQUENT", 2)
    assert sorted((tuple(x) for x in line_dedup.without_shared_lines(docs).collect()), key=repr) == plain_lines(rows)


def test_registered_lines(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, gone in plain_lines(rows))
    assert sorted(tuple(r) for r in queries.op3_line_dedup(spark, FOLDER).collect()) == want
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    assert sorted(db.sql(queries.ORACLES["op3_line_dedup"]).fetchall()) == want
