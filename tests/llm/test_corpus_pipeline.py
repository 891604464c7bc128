"""Stages of the corpus pipeline, and all of them together, against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import tokenizers
import xxhash

import corpus_pipeline
from gristmill.llm import langid, line_dedup, mixing, simhash

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, _row STRING, _id INT, _of_tie STRING, fp INT, copies STRING"
WORDS = {"en": "the and of that with from this have".split(), "de": "der die das und nicht mit sich auf".split()}


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "row", 1, "tie", 2, "c") for i, t, lang, s in rows], SCHEMA)


def all_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def say(r, lang, n):
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "", "", f"{r.randrange(99)}"]) for _ in range(n))


def odd_rows(seed=1, n=160):
    """Copies, shared lines, null and shared ids, null, empty and long texts, repeated rows."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        lang = r.choice(["en", "en", "de"])
        lines = [say(r, lang, r.randrange(1, 30)) for _ in range(r.randrange(1, 6))] + ["A line that Many documents share, word for word"] * (r.random() < 0.3)
        rows.append((k, "\n".join(lines), r.choice([lang, lang, None]), r.choice(["hot"] * 4 + ["a", "b", None])))
    rows += [(300 + k, rows[k % 7][1].upper() if k % 2 else rows[k % 7][1] + " ", "en", "hot") for k in range(30)]
    rows += [(None, rows[3][1], "en", None), (None, say(r, "en", 50), "en", "a"), (None, say(r, "de", 50), "de", "b"), (None, None, None, None)]
    rows += [(7, say(r, "en", 40), "en", "a"), (7, say(r, "en", 41), "en", "hot"), rows[5], rows[5]]
    rows += [(400, None, "en", "a"), (401, "", "en", "a"), (402, " \n\t", "de", "b"), (403, "123 !?", None, "b"), (404, "the " * 50_000, "en", "hot"),
             (405, "the", "en", "a"), (406, "THE", "en", "a")]
    return rows


def rows_of(rows):
    return sorted(((i, t, lang, s, None if t is None else len(t), "row", 1, "tie", 2, "c") for i, t, lang, s in rows), key=repr)


def back(found):
    return [x[:4] for x in found]


def plain_lines(rows):
    key = lambda line: re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))
    order = lambda i: -(1 << 63) if i is None else i
    holders = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(order(i))
    out = []
    for i, text, *rest in rows:
        gone = lambda x: len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != order(i)  # noqa: E731, B023
        lines = (text or "").split("\n")
        out.append((i, "\n".join(x for x in lines if not gone(x)) if any(map(gone, lines)) else text, *rest))
    return out


def fingerprint(text):
    words = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    grams = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_heads(rows):
    """Of each component of all pairs, the rows among which one stays."""
    prints = [fingerprint(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for k, row in enumerate(rows):
        groups[root(k)].append(row)
    least = lambda g: min((i is None, i or 0) for i, *_ in g)
    return [{x for x in g if (x[0] is None, x[0] or 0) == least(g)} for g in groups.values()]


def test_language_id(spark):
    rows = odd_rows()
    docs = table(spark, rows)
    found = Counter()
    for r in langid.identify(docs).collect():
        found[r._id, r._tie] = r.lang_pred != langid.UNKNOWN and r.score >= 0.5
    keys = {(r._id, r._tie, r.text): r for r in docs.select(*["text"], corpus_pipeline.id_key("doc_id").alias("_id"), corpus_pipeline.tie_key("text").alias("_tie")).collect()}
    stays = {(i, t): found[i, tie] for i, tie, t in keys}
    want = rows_of([x for x in rows if stays[-(1 << 63) if x[0] is None else x[0], x[1]]])
    got = all_rows(corpus_pipeline.language_id(spark, docs, ""))
    assert got == want
    texts = {x[1] for x in back(got)}
    assert not texts & {None, "", " \n\t", "123 !?"} and "the" in texts


def test_shared_lines(spark):
    rows = odd_rows(2)
    assert all_rows(corpus_pipeline.shared_lines(spark, table(spark, rows), "")) == rows_of(plain_lines(rows))


def test_near_duplicates(spark):
    rows = odd_rows(3)
    got, want = back(all_rows(corpus_pipeline.near_duplicates(spark, table(spark, rows), ""))), plain_heads(rows)
    assert len(got) == len(want)
    for x in got:
        want.remove(next(g for g in want if x in g))


def test_components_without_or_with_one_id_each_keep_a_document(spark):
    r = random.Random(1)
    a, b, c, d, e = (" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(5))
    rows = [(i, t, "en", "s") for i, t in [(None, a), (None, a.upper()), (None, b), (None, c), (7, d), (7, e), (8, e), (None, d)]]
    got = back(all_rows(corpus_pipeline.near_duplicates(spark, table(spark, rows), "")))
    assert len(got) == 5 and {t.lower() for _, t, *_ in got} == {a, b, c, d, e} and {i for i, t, *_ in got if t in (d, e)} == {7}


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check_mixture(rows, got):
    before, after = Counter(rows), Counter(got)
    assert set(after) <= set(before) and all(n <= 2 * before[x] for x, n in after.items())
    sizes, taken, biggest = defaultdict(int), defaultdict(int), defaultdict(int)
    for x, n in before.items():
        sizes[x[3]] += n * size(x[1])
        biggest[x[3]] = max(biggest[x[3]], size(x[1]))
    for x, n in after.items():
        taken[x[3]] += n * size(x[1])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, full = {}, set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        free = sum(weight[s] for s in sizes if s not in full)
        target = {s: 2 * sizes[s] if s in full else rest * weight[s] / free for s in sizes}
        more = {s for s in sizes if s not in full and target[s] > 2 * sizes[s]}
        if not more:
            break
        full |= more
    for s in sizes:
        assert abs(taken[s] - target[s]) <= biggest[s] + 1e-6


def test_mixture(spark):
    rows = odd_rows(4)
    got = all_rows(corpus_pipeline.mixture(spark, table(spark, rows), ""))
    check_mixture(rows, back(got))
    assert got == all_rows(corpus_pipeline.mixture(spark, table(spark, list(reversed(rows))), ""))


def plain_tokens(rows):
    known = tokenizers.Tokenizer.from_file(corpus_pipeline.bpe.public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for i, text, *_ in rows:
        ids = known.encode(text or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((i, len(ids), digest(",".join(map(str, ids))), digest(known.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=repr)


def test_tokens(spark):
    rows = odd_rows(5)
    assert all_rows(corpus_pipeline.tokens(spark, table(spark, rows), "")) == plain_tokens(rows)


def test_empty_table(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, table(spark, []), "").count() == 0, name


def test_run(spark, tmp_path):
    """All stages in turn, each one's kept rows against the plain version on what the one before kept."""
    rows = odd_rows(6)
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), [rows]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
        seen.append(back(all_rows(docs)))
    first, named, cut, heads, mixed = seen
    assert set(named) < set(first) and rows_of(cut) == rows_of(plain_lines(named))
    want = plain_heads(cut)
    assert len(heads) == len(want) and all(any(x in g for g in want) for x in heads)
    check_mixture(heads, mixed)
    assert all_rows(corpus_pipeline.run(spark, str(tmp_path))) == plain_tokens(mixed)


@pytest.mark.parametrize("module", [langid, line_dedup, simhash, mixing])
def test_stages_call_the_operators(module):
    assert module in vars(corpus_pipeline).values()
