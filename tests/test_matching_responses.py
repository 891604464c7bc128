import json

from pyspark.sql import functions as F

from gristmill import schemas
from gristmill.functions import responses as RS
from gristmill.operators import matching as M
from gristmill.operators import requests as RQ
from gristmill.plans import reports as RP
from gristmill.plans import tailoring as TL
from gristmill.operators import recall as R
from gristmill.sources import files as FL


def experience(name, tags=(), priority="medium", bullets=4):
    return {"company": name, "role": "r", "period": "p", "tags": list(tags), "priority": priority,
            "bullets": [{"text": f"{name}{i}", "tags": list(tags)[:1]} for i in range(bullets)]}


def project(name, tags=(), priority="medium"):
    return {"name": name, "tags": list(tags), "priority": priority, "bullets": [{"text": name, "tags": []}], "link": ""}


def candidate(ident, experiences=(), projects=(), skills=()):
    return {"candidate_id": ident, "personal": {"name": "N", "email": "e", "phone": "1", "location": "l"}, "summary": "s",
            "work_experience": list(experiences), "projects": list(projects), "education": [], "skills": list(skills)}


def load(spark, tmp_path, *records):
    path = tmp_path / "candidates.json"
    path.write_text("\n".join(map(json.dumps, records)))
    return FL.read_candidates(spark, str(path))


def work(spark, rows, tmp_path, keywords, *records):
    good, _ = load(spark, tmp_path, *records)
    pairs = rows("candidate_id STRING, posting_id BIGINT", *[(r["candidate_id"], 1) for r in records])
    return M.work_rows(pairs, good, rows("posting_id BIGINT, keywords ARRAY<STRING>", (1, keywords)))


def test_candidate_schema(spark, tmp_path):
    bare = candidate("ok", [{"company": "c", "role": "r", "period": "p", "bullets": [{"text": "b"}]}])
    good, bad = load(spark, tmp_path, bare, {**candidate("no summary"), "summary": None},
                     candidate("no text", [{"company": "c", "role": "r", "period": "p", "bullets": [{"tags": []}]}]))
    row = good.first()
    assert row.work_experience[0].priority == "medium" and row.work_experience[0].tags == [] and row.personal.github == ""
    assert sorted(r.candidate_id for r in bad.collect()) == ["no summary", "no text"]
    assert good.count() == 1


def test_tag_scores(spark, rows, tmp_path):
    df = work(spark, rows, tmp_path, ["python", "data science"], candidate(
        "a", [experience("x", ["Go"]), experience("y", ["Python", "python", "Data Science"])], [project("p"), project("q", ["PYTHON"])]))
    r = M.tag_scores(df).first()
    assert [(e.title, e.score, e.bullet_scores, e.total_bullets) for e in r.experiences] == [("r @ y", 3, [1] * 4, 4), ("r @ x", 0, [0] * 4, 4)]
    assert [(p.title, p.score) for p in r.projects] == [("q", 1), ("p", 0)]


def selected(spark, rows, tmp_path, keywords, *records):
    df = work(spark, rows, tmp_path, keywords, *records)
    out = df.select("candidate_id", M.cut_bullets(M.select_experiences(F.col("work_experience"), F.col("keywords"))).alias("e"),
                    M.select_projects(F.col("projects"), F.col("keywords")).alias("p"))
    return {r.candidate_id: ([(e.company, len(e.bullets)) for e in r.e], [p.name for p in r.p]) for r in out.collect()}


def test_selection(spark, rows, tmp_path):
    low = [experience("a"), experience("b", ["k1"]), experience("c", ["k1", "k1"], "low"), experience("d")]
    high = [experience(f"h{i}", priority="high") for i in range(4)]
    keywords = [f"k{i}" for i in range(1, 12)]
    got = selected(
        spark, rows, tmp_path, keywords,
        candidate("none", low, [project("p1")]), candidate("two", high[:2] + low, [project("p1"), project("p2")]),
        candidate("four", high + low, []),
        candidate("late", [experience("z", ["k11"])], [project("l", ["k1", "k2"], "low"), project("h", [], "high"), project("m"), project("t", ["k3"], "low"), project("u", [], "odd")]),
        candidate("names", [], [project("same", ["k1"]), project("x", ["k1"]), project("same"), project("y", [], "low")]))
    assert got == {
        "none": ([("c", 3), ("b", 3), ("a", 2)], ["p1"]), "two": ([("h0", 4), ("h1", 4), ("c", 3)], ["p1", "p2"]),
        "four": ([(f"h{i}", 4) for i in range(4)], []), "late": ([("z", 2)], ["h", "l", "t"]), "names": ([], ["same", "x", "y"])}


def test_skills_and_text(spark, rows, tmp_path):
    full = candidate("a", [experience("Co", bullets=1)], [{**project("P"), "link": "http://l"}], [
        {"category": "Backend", "skills": ["old"]}, {"category": "Frontend", "skills": ["f"]}, {"category": "Backend", "skills": ["b"]}, {"category": "Zoo", "skills": ["z"]}])
    full["education"] = [{"degree": "D", "school": "S", "gpa": "4", "coursework": ["x", "y"]}]
    good, _ = load(spark, tmp_path, full)
    groups = good.select(M.regroup_skills(F.col("skills")).alias("g")).first().g
    assert [(g.category, g.skills) for g in groups] == [("Languages", []), ("Frameworks & Libraries", ["b", "f"]), ("Tools & Platforms", []), ("Concepts", [])]
    text = M.candidate_text(good).first().text
    assert text.startswith("N\nl\nEmail: [e] | Phone: [1] | GitHub: [] | LinkedIn: []\n\n---\n\n### SUMMARY\n\ns\n\n---\n\n### SKILLS\n\n**Backend:** old\n")
    assert "**r — Co**\np\n\n* Co0\n\n---\n\n### PROJECTS\n\n**P**\nLink: http://l\n\n* P\n\n---\n\n### EDUCATION\n\n**D — S**\nGPA: 4\n\n### COURSEWORK\n\nx, y" in text


def test_tailored_with_reordering(spark, rows, tmp_path):
    good, _ = load(spark, tmp_path, candidate("a", [experience("x", ["spark"]), experience("h", priority="high", bullets=2)], [project("p")]))
    postings = rows("id BIGINT, description STRING", (1, "spark spark jobs"), (2, "not in the work list"))
    pairs = rows("candidate_id STRING, posting_id BIGINT", ("a", 1))
    answers = rows("candidate_id STRING, posting_id BIGINT, section STRING, item INT, text STRING",
                   ("a", 1, "experiences", 1, "1. x3\n2. x0\n3. x1\n4. x2"), ("a", 1, "experiences", 0, "no list"))
    (r,) = TL.tailored(pairs, good, postings, "id", "description", answers).collect()
    assert [(e.company, e.bullets) for e in r.experiences] == [("h", ["h0", "h1"]), ("x", ["x3", "x0", "x1"])]
    assert [p.name for p in r.projects] == ["p"]


def test_scores(column):
    cases = {'{"score": 8}': 8, '{"score": "8"}': 8, '{"score": 8.7}': 8, '{"score": "8/10"}': 8, "8": 8, "```json\n{\"score\": 7}\n```": 7,
             "no digits": 0, None: 0, '{"score": null, "x": 5}': 5, '{"score": -3}': -3, "I give 9 of 10": 9, "": 0, '{"score": true}': 1}
    assert column(RS.score_from_response, *cases) == list(cases.values())


def test_lists(rows):
    df = rows("t STRING", ("2. b\n1. a\nnote\n10. c\n1000. no",), ("none",), (None,))
    assert [r.v for r in df.select(RS.reordered_list(F.col("t"), F.array(F.lit("o"))).alias("v")).collect()] == [["b", "a", "c"], ["o"], ["o"]]
    picks = rows("t STRING", ("3,1,9,x",), ("1,1,2,3",), ("0,-1, ",), ("99999999999999,2",), (None,))
    items = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    assert [r.v for r in picks.select(RS.picked_items(F.col("t"), items).alias("v")).collect()] == [["c", "a"], ["a", "a", "b"], [], ["b"], []]
    assert [r.v for r in rows("t STRING", ("a, ,b",), ("1,2,3,4,5,6,7,8,9",)).select(RS.comma_list(F.col("t")).alias("v")).collect()] == [
        ["a", "b"], list("12345678")]


def test_salvage_and_results(rows):
    df = rows("t STRING", ('{"cover_letter": "c", "fit_reason": "f"}',), ('x {"cover_letter": "c"} y',), ("{}",), ("null",), ("[]",), ('""',), ("0",), ("oops",), ('{"error": "e"}',))
    got = [r.r for r in df.select(RS.application_result(F.col("t")).alias("r")).collect()]
    assert [g.error for g in got] == [None, None, "{}", "null", "[]", '""', "0", "oops", "e"] and got[0].fit_reason == "f" and got[1].cover_letter == "c"
    found = df.select(RS.salvage_json(F.col("t")).isNotNull().alias("v")).collect()
    assert [r.v for r in found] == [True] * 7 + [False, True]
    made = rows("t STRING", ('{"description": " a  b ", "title": ""}',), ('{"title": "x"}',), (None,)).select(RS.extracted_posting(F.col("t"), F.lit("u")).alias("p")).collect()
    assert (made[0].p.title, made[0].p.description, made[0].p.source) == ("Unknown", "a b", "llm") and made[1].p is None and made[2].p is None


def test_requests(rows):
    long = "d" * 7000
    df = rows("id INT, d STRING, b ARRAY<STRING>, s ARRAY<STRUCT<category: STRING, skills: ARRAY<STRING>>>, p ARRAY<STRUCT<name: STRING, bullets: ARRAY<STRING>>>",
              (1, long, ["x", "y"], [("c", ["s1", "s2"])], [("n", ["1", "2", "3"])]))
    i, d = F.col("id"), F.col("d")
    made = RQ.request_rows(
        df, RQ.score_request(i, F.lit("R"), F.lit(None), F.lit("C"), d), RQ.application_request(i, F.lit("R"), F.lit("T"), F.lit("C"), d),
        RQ.advice_request(i, F.lit("R"), F.lit("T"), F.lit("C"), d), RQ.summary_request(i, F.lit("S"), d), RQ.seniority_request(i, d),
        RQ.reorder_request(i, F.col("b"), d), RQ.projects_request(i, F.col("p"), d), RQ.competencies_request(i, F.col("s"), d), RQ.extraction_request(i, d))
    texts = {r.kind: r.text for r in made.collect()}
    cuts = {k: t.count("d" * 10) * 10 for k, t in texts.items()}
    assert cuts == {"score": 800, "application": 800, "advice": 800, "summary": 800, "seniority": 1500, "reorder": 600, "projects": 800, "competencies": 800, "extraction": 6000}
    assert "1. x\n2. y" in texts["reorder"] and "s1, s2" in texts["competencies"] and "n: 1 2\n" in texts["projects"] and "unknown" in texts["score"]


def test_recall_report(spark, rows, tmp_path):
    docs = rows("id STRING, role_family STRING, description STRING", ("1", "Data Engineer", "Python Spark Airflow Snowflake ETL"), ("2", "Data Engineer", "nothing here"))
    RP.write_json(RP.recall_report(docs, R.skills_table(spark)), str(tmp_path / "r"))
    report = json.loads(next((tmp_path / "r").glob("*.json")).read_text())
    assert report["summary"]["n_docs"] == 2 and report["by_family"] == [{"role_family": "Data Engineer", "n": 2, "recall_mean": 0.5}]


def test_schemas_name_their_fields():
    assert schemas.POSTING.fieldNames() == ["title", "company", "url", "description", "location", "source"]
