import json

from pyspark.sql import functions as F

from gristmill.plans import fetch as FT
from gristmill.operators import roles as R
from gristmill.sources import boards as B
from gristmill.sources import details as D
from gristmill.sources import files as FL

PAYLOAD = "source STRING, slug STRING, branch STRING, page_no INT, body STRING, ord BIGINT"
DETAIL = "board STRING, slug STRING, job_id STRING, body STRING"


def payloads(rows, source, *bodies, branch="search"):
    return rows(PAYLOAD, *[(source, "acme", branch, i + 1, b if isinstance(b, str) else json.dumps(b), i) for i, b in enumerate(bodies)])


def got(df, *fields):
    return [tuple(r[f] for f in fields) if len(fields) > 1 else r[fields[0]] for r in df.orderBy("ord").collect()]


def test_company_boards(rows):
    jobs = [{"id": 1, "title": "Data Engineer", "location": {"name": "Berlin"}}, {"id": 2, "title": "Leading X"}, {"id": 3, "title": "Principal Y"},
            {"id": 4, "title": None, "location": "x", "jobUrl": "http://u"}, 7]
    details = rows(DETAIL, ("greenhouse", "acme", "1", '{"content": "&lt;p&gt;raw"}'))
    gh = B.greenhouse(payloads(rows, "greenhouse", {"jobs": jobs}, "not json"), details)
    assert got(gh, "title", "url", "description", "location") == [
        ("data engineer", "https://boards.greenhouse.io/acme/jobs/1", "&lt;p&gt;raw", "Berlin"),
        ("principal y", "https://boards.greenhouse.io/acme/jobs/3", "", "Unknown"), ("", "http://u", "", "Unknown")]
    lever = B.lever(payloads(rows, "lever", [{"title": "A", "id": "x", "categories": {"location": "L"}}], {"jobs": [{"title": "B", "hostedUrl": "h"}]}))
    assert got(lever, "url", "location") == [("https://jobs.lever.co/acme/x", "L"), ("h", "Unknown")]
    ashby = B.ashby(payloads(rows, "ashby", [{"title": "A", "location": {"a": 1}, "descriptionPlain": "", "description": "d"}, {"title": "B", "location": "L"}]), ["a"])
    assert got(ashby, "title", "location", "description") == [("a", "Unknown", "d")]


def test_himalayas_branches(rows):
    hit, senior = {"title": "Dev", "companySlug": "s", "guid": "g", "locationRestrictions": ["US", "CA"]}, {"title": "Head of Dev"}
    browse = payloads(rows, "himalayas", {"jobs": [dict(hit, title="Browse", locationRestrictions=[])], "nextCursor": "c"},
                      {"jobs": [dict(hit, title="US only")]}, {"jobs": [dict(hit, title="late", locationRestrictions=None)]}, branch="browse")
    pages = payloads(rows, "himalayas", {"jobs": [hit, senior], "totalCount": 40}, {"jobs": [hit], "totalCount": 40}, {"jobs": [hit], "totalCount": 40})
    found = B.himalayas(pages.unionByName(browse))
    assert got(found, "title", "company", "url", "location") == [("dev", "s", "g", "US, CA")] * 2
    none = payloads(rows, "himalayas", {"jobs": [senior]}, {"jobs": []}, {"jobs": [hit]})
    fallback = B.himalayas(none.unionByName(browse), worldwide_only=True)
    assert got(fallback, "title", "location") == [("browse", "Remote")]
    assert B.himalayas(pages, max_pages=1).count() == 1


def test_rss(spark, rows, tmp_path):
    (tmp_path / "feed.xml").write_text(
        "<rss><channel><item><title>Acme: Data Engineer</title><link>http://l</link><description>&lt;b&gt;x&lt;/b&gt;</description><region>EU</region></item>"
        "<item><title>Plain</title><guid>g</guid></item><item><title>Acme: Senior Dev</title></item></channel></rss>")
    found = B.weworkremotely(B.read_rss(spark, str(tmp_path / "feed.xml")))
    assert got(found, "title", "company", "url", "description", "location") == [
        ("Data Engineer", "Acme", "http://l", "x", "EU"), ("Plain", "Unknown", "g", "", "Remote")]


def test_remotive_terms(rows):
    data = payloads(rows, "remotive", {"jobs": [{"title": " Cook ", "candidate_required_location": "Berlin"}, {"title": "Dev"}]}, [{"title": "list"}])
    assert got(B.remotive(data, ["dev"]), "title") == ["Cook", "Dev"]
    assert got(B.remotive(data, ["dev", "x"]), "title") == ["Dev"]
    assert got(B.remotive(data, ["dev"], worldwide_only=True), "location") == ["Remote"]


def test_remoteok_and_jobicy(rows):
    ok = B.remoteok(payloads(rows, "remoteok", [{"legal": 1}, {"position": "A", "url": "/x"}, {"position": "B", "slug": "s"}], {"jobs": [{"position": "no"}]}))
    assert got(ok, "title", "url") == [("A", "https://remoteok.com/x"), ("B", "https://remoteok.com/remote-jobs/s")]
    job = {"title": "T", "jobGeo": [], "location": ["a", "b"], "link": "l"}
    ji = B.jobicy(payloads(rows, "jobicy", {"jobs": [], "data": [job, "x"]}, [dict(job, jobTitle="J", jobGeo="Anywhere")]))
    assert got(ji, "title", "location", "url") == [("T", "a, b", "l"), ("J", "Anywhere", "l")]


def test_remote_run(rows):
    data = payloads(rows, "remotive", {"jobs": [{"title": "Data Engineer", "url": "u1"}, {"title": "Data Analyst", "url": ""}, {"title": "Cook", "url": "u3"}]}) \
        .unionByName(payloads(rows, "jobicy", [{"title": "Data Scientist", "url": " u1 "}, {"title": "Data Analyst", "url": ""}]))
    rss = rows("title STRING, link STRING, guid STRING, description STRING, region STRING, ord BIGINT", ("Co: Data Engineer", "u9", None, None, None, 0))
    found = FT.fetch_remote(data, rss, "data engineer")
    assert [(r.source, r.title) for r in found.orderBy("source_rank", "ord").collect()] == [
        ("weworkremotely", "Data Engineer"), ("remotive", "Data Engineer"), ("remotive", "Data Analyst"), ("jobicy", "Data Analyst")]
    assert {r.source: r.n for r in FT.fetch_report(found).collect()} == {"weworkremotely": 1, "remotive": 2, "jobicy": 1}
    assert FT.fetch_remote(data.repartition(8), rss, "data engineer", max_jobs=2).count() == 2


def test_board_run(spark, rows):
    data = rows(PAYLOAD, ("lever", "a", None, 1, '[{"title": "x"}]', 0), ("ashby", "a", None, 1, '[{"title": "not detected"}]', 0),
                ("ashby", "b", None, 1, '[{"title": "y"}]', 0), ("lever", "zzz", None, 1, '[{"title": "not in roster"}]', 0))
    roster = R.roster_table(spark, roster=["a", ("Bee", "b")])
    detected = rows("slug STRING, ats STRING", ("a", "lever"), ("b", "ashby"))
    found = FT.fetch_boards(data, rows(DETAIL, ("x", "x", "x", "{}")), roster, detected)
    assert sorted((r.company, r.title) for r in found.collect()) == [("a", "x"), ("b", "y")]


def lookup(df):
    return {r.url: r.posting for r in df.collect()}


def test_details(rows):
    urls = D.requested(rows("url STRING", *[(u,) for u in (
        "https://boards.greenhouse.io/acme/jobs/1", "https://boards.greenhouse.io/acme/jobs/x", "https://jobs.lever.co/acme/l1",
        "https://jobs.lever.co/acme/l2", "https://jobs.smartrecruiters.com/acme/12-title", "https://jobs.smartrecruiters.com/acme/13",
        "https://careers.celonis.com/job-detail?jobId=9")]))
    details = rows(
        DETAIL, ("greenhouse", "acme", "1", '{"title": "", "content": "&lt;p&gt;a&lt;/p&gt;b", "location": "Bonn"}'),
        ("lever", "acme", "l1", '{"descriptionBodyPlain": "", "descriptionPlain": " x  y ", "hostedUrl": "http://page"}'),
        ("lever", "acme", "l2", '{"text": ""}'),
        ("smartrecruiters", "acme", "12", '{"name": "N", "jobAd": {"sections": {"a": {"text": "<b>1</b>"}, "b": {}, "c": {"text": "2"}}}, "location": {"country": "de"}}'),
        ("smartrecruiters", "acme", "13", '{"name": "M", "jobAd": {"sections": [{"text": "s"}, 4]}}'),
        ("careers", "Celonis", "9", '{"title": "T", "description": "<i>d</i>", "groupedLocation": "G", "location": "L"}'))
    pages = rows("url STRING, html STRING", ("http://page", "<title>From page</title>"))
    gh, lever, sr, careers = D.greenhouse(urls, details), D.lever(urls, details, pages), D.smartrecruiters(urls, details), D.careers(urls, details)
    (one,) = lookup(gh).values()
    assert (one.title, one.company, one.description, one.location) == ("Unknown", "acme", "a b", "Bonn")
    (two,) = lookup(lever).values()
    assert (two.title, two.description) == ("From page", "x y")
    found = {p.title: p for p in lookup(sr).values()}
    assert (found["N"].description, found["N"].location, found["M"].description, found["M"].location) == ("1 2", "de", "s", "Unknown")
    (three,) = lookup(careers).values()
    assert (three.company, three.source, three.location, three.description) == ("Celonis", "careers-api", "G", "d")


def test_ashby_containment(rows):
    urls = D.requested(rows("url STRING", ("https://jobs.ashbyhq.com/co/id1",), ("https://jobs.ashbyhq.com/co/id12",), ("https://jobs.ashbyhq.com/other/id1",)))
    boards = rows("slug STRING, body STRING, ord BIGINT", ("co", json.dumps({"jobs": [
        {"title": "no", "jobUrl": None}, {"title": "twelve", "jobUrl": "http://x/co/id12?a"}, {"title": "one", "jobUrl": "http://x/co/id1"}]}), 0))
    found = D.ashby(urls, boards)
    assert {u[-4:]: p.title for u, p in lookup(found).items()} == {"/id1": "twelve", "id12": "twelve"}
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_manual(rows):
    entries = rows("input STRING, title STRING, company STRING, description STRING, url STRING, ord BIGINT",
                   (" http://a ", " t ", "c", "d", "u", 0), ("http://short", "t", "c", " d ", "u", 1), ("", "x", "c", "d", "", 2))
    scraped = rows("title STRING, company STRING, url STRING, description STRING, location STRING, source STRING",
                   ("S", "C", "http://a", "x" * 101, "L", "generic"), ("S", "C", "http://short", "x" * 100, "L", "generic"))
    found = FL.manual_postings(entries, scraped).orderBy("ord").collect()
    assert found == FL.manual_postings(entries, scraped.unionAll(scraped)).orderBy("ord").collect()
    assert [(r.title, r.source, r.description[:2]) for r in found] == [("S", "generic", "xx"), ("t", "manual", "d"), ("x", "manual", "d")]
    bulk = FL.bulk_manual_postings(entries.withColumn("description", F.lit("y" * 2000)))
    assert {len(r.description) for r in bulk.collect()} == {1500} and "source" not in bulk.columns


def test_himalayas_fetches_are_apart(rows):
    """Each slug is a fetch: a short search, a broken page and a hit of one change nothing for another."""
    def job(n):
        return json.dumps({"jobs": [{"title": f"dev {n}", "guid": f"g{n}"}], "totalCount": 200})

    data = rows(PAYLOAD, *[("himalayas", slug, branch, page, body, page) for slug, branch, page, body in [
        ("q1", "search", 1, job(1)), ("q1", "search", 2, "broken"), ("q1", "search", 3, job(3)),
        ("q2", "search", 1, job(11)), ("q2", "search", 2, job(12)), ("q2", "search", 3, '{"jobs": []}'), ("q2", "search", 4, job(14)),
        ("q3", "search", 1, '{"jobs": []}'), ("q3", "browse", 1, job(21)), ("q1", "browse", 1, job(22)),
        (None, "search", 1, job(31)), *[("q4", "search", p, job(40 + p)) for p in range(1, 8)]]])
    found = sorted(int(r.url[1:]) for r in B.himalayas(data).collect())
    assert found == [1, 3, 11, 12, 21, 31, *range(41, 48)]
    assert sorted(int(r.url[1:]) for r in B.himalayas(data, max_pages=5).collect()) == [1, 3, 11, 12, 21, 31, *range(41, 46)]


def test_large_payload_numbers_keep_rows(rows):
    data = rows(PAYLOAD, *[("jobicy", "s", None, 1, '[{"title": "a"}, {"title": "b"}]', n) for n in (0, 2**31, 2**33, 2**62)])
    found = B.jobicy(data)
    assert found.select("ord").distinct().count() == 8 and FT.dedup_by_url(found).count() == 8
    assert [r.title for r in found.orderBy("ord").collect()] == ["a", "b"] * 4


def test_board_order(rows):
    data = rows(PAYLOAD, ("lever", "a", None, 1, '[{"title": "a2"}]', 9), ("lever", "a", None, 1, '[{"title": "a0"}, {"title": "a1"}]', 3),
                ("ashby", "b", None, 1, '[{"title": "b0"}]', 1))
    roster = rows("slug STRING, ord INT", ("b", 5), ("a", 2))
    detected = rows("slug STRING, ats STRING", ("a", "lever"), ("b", "ashby"))
    nothing = rows(DETAIL, ("x", "x", "x", "{}"))
    found = FT.fetch_boards(data, nothing, roster, detected).orderBy("source_rank", "ord")
    assert [(r.source_rank, r.title) for r in found.collect()] == [(2, "a0"), (2, "a1"), (2, "a2"), (5, "b0")]
    assert [r.title for r in FT.fetch_boards(data, nothing, roster, detected, max_jobs=2).collect()] == ["a0", "a1"]


def test_sections_keep_their_order(rows):
    urls = D.requested(rows("url STRING", ("https://jobs.smartrecruiters.com/acme/12",)))
    details = rows(DETAIL, ("smartrecruiters", "acme", "12", json.dumps(
        {"name": "N", "jobAd": {"sections": {"jobDescription": {"text": "first"}, "companyDescription": {"text": "second"}}}})))
    assert D.smartrecruiters(urls, details).first().posting.description == "first second"
