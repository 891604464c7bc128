import json

import pytest
from pyspark.sql import functions as F

from gristmill.operators import dedup as DD
from gristmill.operators import log as L
from gristmill.operators import roles as R
from gristmill.operators import stats as ST
from gristmill.plans import application as A
from gristmill.plans import reports as RP
from gristmill.sources import files as FL

BASE = "title STRING, company STRING, score INT, cover_letter STRING, fit_reason STRING, url STRING, status STRING, ord BIGINT"


def log_row(url, ord, status="pending", title="t", company="c", score=7, letter="l"):
    return (title, company, score, letter, "r", url, status, ord)


def updates(rows, *records):
    return L.parse_updates(rows("body STRING, ord BIGINT", *[(json.dumps(r), 100 + i) for i, r in enumerate(records)]))


def test_upsert(rows):
    base = rows(BASE, log_row("a", 1), log_row("b", 2), log_row("a", 3), log_row(None, 4))
    new = updates(rows, {"url": "a", "status": "applied"}, {"url": "a", "cover_letter": None, "score": 9}, {"url": "n", "title": "new"},
                  {"url": "n", "title": "newer", "status": "pending"}, {"url": None, "score": 1})
    got = L.upsert(base, new)
    by_ord = {r.ord: r for r in got.collect()}
    assert (by_ord[1].status, by_ord[1].score, by_ord[1].cover_letter, by_ord[1].title) == ("applied", 9, None, "t")
    assert by_ord[3].status == "pending" and by_ord[2].score == 7 and by_ord[4].score == 1
    assert (by_ord[102].title, by_ord[102].status, by_ord[102].score) == ("newer", "pending", None)
    assert len(by_ord) == 5
    again = L.upsert(got, new)
    assert sorted(again.collect(), key=lambda r: r.ord) == sorted(got.select(again.columns).collect(), key=lambda r: r.ord)


def test_upsert_with_a_hot_url(rows):
    base = rows(BASE, *[log_row("hot" if i % 3 == 0 else f"u{i}", i) for i in range(300)])
    new = updates(rows, *[{"url": "hot", "score": i} for i in range(90)], *[{"url": f"new{i % 5}", "title": str(i)} for i in range(20)])
    got = L.upsert(base, new)
    assert got.count() == 305
    assert [r.ord for r in got.filter("score = 89").collect()] == [0]
    assert {r.url: r.title for r in got.filter("url LIKE 'new%'").collect()} == {f"new{i}": str(15 + i) for i in range(5)}


def test_upsert_reads_once_and_spreads_keys(spark, tmp_path):
    base = spark.range(4000).selectExpr("IF(id % 3 = 0, 'hot', 'u' || id) AS url", "'t' || id AS title", "id AS ord")
    base.write.parquet(str(tmp_path / "base"))
    spark.range(500).selectExpr("'{\"url\": \"' || IF(id % 2 = 0, 'hot', 'u' || id) || '\", \"title\": \"n' || id || '\"}' AS body", "10000 + id AS ord").write.parquet(str(tmp_path / "new"))
    got = L.upsert(spark.read.parquet(str(tmp_path / "base")), L.parse_updates(spark.read.parquet(str(tmp_path / "new"))))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Exchange hashpartitioning") == 4
    # Rows of one key meet patches and their like in many places, not by the key alone.
    assert "hashpartitioning(_key" in plan and not [x for x in plan.splitlines() if "hashpartitioning(_key" in x and "_slot" not in x]
    by = {r.ord: r.title for r in got.collect()}
    assert len(by) == 4000 + sum(k % 2 == 1 and k % 3 == 0 for k in range(500))
    assert by[0] == "n498" and by[1] == "n1" and by[3] == "t3" and by[10003] == "n3"
    first = L.mark_first(base)
    assert sorted(r.ord for r in first.filter("is_first AND url = 'hot'").collect()) == [0] and first.filter("is_first").count() == base.select("url").distinct().count()


def test_rejected_records(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"url": "a"}\nnot json\n\n[1]\n{"url": "b"}\n{"cut": ')
    got = FL.rejected_records(spark, str(folder)).collect()
    assert sorted(r.value for r in got) == ["[1]", "not json", '{"cut": '] and all(r.file.endswith("a.jsonl") for r in got)
    kept = FL.read_log(spark, str(folder), lines=True)
    assert not {r.ord for r in got if r.value != "[1]"} & {r.ord for r in kept.collect()}
    whole = tmp_path / "whole"
    whole.mkdir()
    (whole / "a.json").write_text('[{"url": "a"}, 3, "x", {"url": "b"}]')
    (whole / "b.json").write_text('[{"url": ')
    assert sorted((r.file[-6:], r.ord, r.value) for r in FL.rejected_records(spark, str(whole), lines=False).collect() if r.ord is not None) == [
        ("a.json", 1, "3"), ("a.json", 2, '"x"')]
    assert [(r.file[-6:], r.value) for r in FL.rejected_records(spark, str(whole), lines=False).filter("ord IS NULL").collect()] == [("b.json", '[{"url": ')]
    assert FL.rejected_records(spark, str(tmp_path / "none")).count() == 0


def test_applied(rows):
    log = rows(BASE, log_row("a", 1, "applied", company="first"), log_row("a", 2, "applied", company="second"), log_row("b", 3),
               log_row(None, 4, "applied"))
    postings = rows("url STRING, title STRING", ("a", "x"), ("b", "y"), (None, "z"), ("", "w"))
    assert sorted(r.title for r in L.without_applied(postings, log).collect()) == ["w", "y"]
    found = {r.title: (r.already_applied, r.applied_company) for r in L.with_applied_company(postings, log).collect()}
    assert found == {"x": (True, "first"), "y": (False, ""), "z": (True, "c"), "w": (False, "")}


def test_anti_join_plan(rows):
    log = rows(BASE, log_row("a", 1, "applied"))
    plan = L.without_applied(rows("url STRING", ("a",)), log)._jdf.queryExecution().toString()
    assert "LeftAnti" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_dedup(rows):
    df = rows("url STRING, source_rank INT, ord BIGINT", ("u", 1, 0), (" u ", 0, 5), ("", 0, 1), ("", 0, 2), (None, 2, 2), ("v", 0, 9), ("v", 0, 3))
    once = DD.dedup_by_url(df)
    assert sorted((r.url or "", r.source_rank, r.ord) for r in once.collect()) == [
        ("", 0, 1), ("", 0, 2), ("", 2, 2), (" u ", 0, 5), ("v", 0, 3)]
    assert DD.dedup_by_url(once).count() == 5 and DD.dedup_by_url(df.repartition(8)).count() == 5
    assert "WindowGroupLimit" in once._jdf.queryExecution().toString()
    posts = rows("title STRING, company STRING, ord BIGINT, no_title BOOLEAN", ("A", "x", 1, False), ("a", "X", 2, False), (None, "x", 3, False),
                 ("None", "x", 4, False), (None, "x", 5, True), ("", "x", 6, False))
    assert sorted(r.ord for r in DD.dedup_by_posting(posts, missing={"title": "no_title"}).collect()) == [1, 3, 5]


def test_fill_from_scraped(rows):
    posts = rows("url STRING, title STRING, company STRING, description STRING, location STRING, source STRING",
                 ("a", "t", "c", "short", "l", "s"), ("b", "t", "c", "x" * 100, "l", "s"))
    scraped = rows("url STRING, title STRING, company STRING, description STRING, location STRING, source STRING",
                   ("a", "Unknown", "", "long", None, "generic"), ("b", "no", "no", "no", "no", "no"))
    got = {r.url: r for r in L.fill_from_scraped(posts, scraped).collect()}
    assert tuple(got["a"]) == ("a", "t", "c", "long", "l", "generic") and got["b"].title == "t"
    twice = scraped.selectExpr("*", "2 AS ord").unionByName(scraped.selectExpr("* EXCEPT (title)", "'first' AS title", "1 AS ord"))
    assert sorted(r.title for r in L.fill_from_scraped(posts, twice).collect()) == ["first", "t"]


SCORES = [6] * 2 + [7] * 11 + [8] * 5 + [9] * 17


def test_score_golden(rows):
    df = rows("score INT", *[(s,) for s in SCORES], (None,))
    s = ST.score_statistics(df, "score").first()
    assert (s.n, round(s["mean"], 2), s["median"], round(s.stdev, 2), s["min"], s["max"], s.p95) == (35, 8.06, 8.0, 1.03, 6, 9, 9)
    assert [(r.bin, r.n) for r in ST.score_histogram(df).orderBy("bin").collect()] == [(6, 2), (7, 11), (8, 5), (9, 17)]


@pytest.mark.parametrize("n, p95, median", [(1, 1, 1.0), (2, 2, 1.5), (20, 20, 10.5), (35, 34, 18.0)])
def test_ranks(rows, n, p95, median):
    s = ST.score_statistics(rows("v INT", *[(i + 1,) for i in range(n)]), "v").first()
    assert (s.p95, s["median"]) == (p95, median) and (s.stdev == 0.0) == (n == 1)


def test_empty_scores(rows):
    s = ST.score_statistics(rows("v INT", (None,)), "v").first()
    assert (s.n, s["mean"], s["median"], s.stdev, s.p95) == (0, 0.0, 0.0, 0.0, 0)


def test_cost(rows):
    c = ST.cost_model(rows("x INT", *[(1,)] * 35)).first()
    assert (c.total_calls, c.total_tokens, c.cost_per_resume_usd, c.total_cost_usd) == (140, 26250, 0.0006, 0.02)


def test_log_files_and_report(spark, rows, tmp_path):
    records = [{"title": "T", "company": "C", "score": s, "cover_letter": f"letter alpha {i}", "fit_reason": "beta gamma", "url": f"u{i}",
                "status": "applied" if i < 19 else "pending"} for i, s in enumerate(SCORES)] + [{"url": "bare", "score": None}]
    path = tmp_path / "log.json"
    path.write_text(json.dumps(records))
    log = FL.read_log(spark, str(path))
    assert log.count() == 36
    bare = log.filter("url = 'bare'").first()
    assert sorted(bare.present) == ["score", "url"] and bare.status is None and bare.ord == 35
    assert FL.read_log(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(FileNotFoundError):
        FL.read_log(spark, str(tmp_path / "none.json"), strict=True)
    (tmp_path / "bad.json").write_text("[{]")
    assert FL.read_log(spark, str(tmp_path / "bad.json")).count() == 0
    with pytest.raises(Exception):
        FL.read_log(spark, str(tmp_path / "bad.json"), strict=True).count()
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, records)) + "\nbroken\n")
    by_line = FL.read_log(spark, str(tmp_path / "log.jsonl"), lines=True)
    assert by_line.orderBy("ord").drop("ord").collect() == log.orderBy("ord").drop("ord").collect()
    out = tmp_path / "report"
    RP.write_json(RP.statistics_report(log), str(out))
    report = json.loads(next(out.glob("*.json")).read_text())
    assert report["scores"]["mean"] == 8.06 and report["dataset"]["n_jobs"] == 36
    assert {s["status"]: s["n"] for s in report["statuses"]} == {"applied": 19, "pending": 16, "unknown": 1}
    assert {g["group"]: g["n"] for g in report["score_vs_status"]} == {"applied": 19, "pending": 16}
    assert report["unique"]["n_unique_postings"] == 2


def test_gates(rows):
    posts = rows("url STRING, title STRING, company STRING, description STRING, location STRING, source STRING, source_rank INT, ord BIGINT", *[
        (u, u, "c", d, "l", "s", 0, i) for i, (u, d) in enumerate([
            ("senior", "5+ years of experience"), ("junior", "1-2 years"), ("asked", "none"), ("yes", "none"), ("empty", ""), ("low", "1-2 years"),
            ("done", "1-2 years"), ("broken", "1-2 years")])])
    log = rows(BASE, log_row("done", 1, "applied"))
    verdicts = A.seniority_verdicts(rows("url STRING, text STRING", ("yes", " YES\n"), ("asked", "no"), ("junior", "yes")))
    scores = rows("url STRING, text STRING", *[(u, '{"score": 8}') for u in ("senior", "junior", "asked", "yes", "empty", "done", "broken")], ("low", "5"))
    accepted = A.candidates_to_apply(posts, log, posts.limit(0), verdicts, scores)
    assert sorted(r.url for r in accepted.collect()) == ["asked", "broken", "empty", "junior"]
    results = rows("url STRING, text STRING", *[(u, '{"cover_letter": "L", "fit_reason": "F"}') for u in ("asked", "empty", "junior")], ("broken", "oops"))
    assert [r.url for r in A.log_updates(accepted, results, cap=2).orderBy("ord").collect()] == ["junior", "asked"]
    assert L.upsert(log, A.log_updates(accepted, results)).count() == 4


def test_roles(spark, rows):
    assert R.terms_of(spark, " AI Engineer ")[0] == "ai engineer" and R.terms_of(spark, "Data/Engineer") == ["data engineer", "data scientist", "data analyst"]
    assert R.terms_of(spark, "Chef ") == ["chef "] and R.terms_of(spark, "") == [] and R.terms_of(spark, None) == []
    df = rows("role STRING", ("Data Engineer",), ("Chef ",), ("",), (None,))
    got = {r.role: r.terms for r in R.expand_roles(df, "role", R.synonyms_table(spark)).collect()}
    assert got == {"Data Engineer": ["data engineer", "data scientist", "data analyst"], "Chef ": ["chef "], "": [], None: []}
    roster = {r.name: r.slug for r in R.roster_table(spark).collect()}
    assert roster["hume"] == "humeai" and roster["gitlab"] == "gitlab" and R.roster_table(spark, True).count() == 40
    probes = rows("slug STRING, ats STRING, probe_rank INT, ok BOOLEAN", ("a", "ashby", 4, True), ("a", "lever", 3, True), ("a", "greenhouse", 0, False), ("b", "lever", 3, False))
    assert [tuple(r) for r in R.detect_ats(probes).collect()] == [("a", "lever")]


def test_synonym_file(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"x": ["Y", "z"]}')
    assert R.terms_of(spark, "X", FL.read_synonyms(spark, str(path))) == ["y", "z"]
    assert FL.read_synonyms(spark, str(tmp_path / "none.json")) == {}


def test_labelled_corpus(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps([{"id": str(i), "synthetic": i % 2 == 0} for i in range(6)]))
    assert [r.id for r in FL.read_labelled_corpus(spark, str(path), 2).orderBy("ord").collect()] == ["0", "2"]
    (tmp_path / "c.jsonl").write_text('{"id": "x", "synthetic": true}\n{"id": "y"}\n')
    assert [r.id for r in FL.read_labelled_corpus(spark, str(tmp_path / "c.jsonl"), lines=True).collect()] == ["x"]
    path.write_text("[]")
    with pytest.raises(ValueError):
        FL.read_labelled_corpus(spark, str(path))


def test_box_plot_outliers(rows):
    df = rows("g STRING, score INT", *[("a", v) for v in (1, 2, 3, 4, 100)])
    b = ST.box_plot(df, "g").first()
    assert (b.q1, b["median"], b.q3, b.low_whisker, b.high_whisker, b.n_outliers) == (2.0, 3.0, 4.0, 1, 4, 1)
    assert ST.top_companies(df.select(F.col("g").alias("company"), F.col("score").alias("ord"))).first().n == 5
