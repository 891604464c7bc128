from pyspark.sql import functions as F

from gristmill.functions import predicates as P
from gristmill.functions import text as X
from gristmill.functions import urls as U


def test_clean_and_strip(column):
    assert column(X.clean_text, " a \n b\t", None, "", "a b") == ["a b", "", "", "a b"]
    assert column(X.strip_blank, "  x \n", "\x1fy　") == ["x", "y"]


def test_first_truthy_skips_null_and_empty_but_not_blank(rows):
    df = rows("a STRING, b STRING", (None, "x"), ("", "y"), (" ", "z"), (None, ""))
    assert [r.v for r in df.select(X.first_truthy(F.col("a"), F.col("b"), default="d").alias("v")).collect()] == ["x", "y", " ", "d"]


def test_min_years(column):
    cases = {
        "3-5 years": 3, "3 to 5 yrs": 3, "10–15 years": 10, "3+ years of experience": 3, "minimum 4 years experience": 4,
        "at least 5 yrs of work experience": 5, "6 years": 0, "2.5+ years experience": 5, "0-2 years": 0,
        "99999999999-5 years": None, "3 - 5 years": 3, "": 0,
    }
    assert column(X.min_years, *cases) == list(cases.values())
    assert column(lambda t: X.seniority(X.min_years(t)), "3+ years experience", "1-2 years", "none") == [True, False, None]


def test_tokens_and_words(column):
    assert column(X.similarity_tokens, "Ab--c ee 12-3 The the-x", None) == [["ab--c", "12-3", "the-x"], []]
    assert column(X.keyword_words, "- CI/CD, Node.js A/B", "") == [["-", "ci", "cd", "node", "js", "a", "b"], []]
    assert column(X.slugify, "Acme & Co.") == ["acme---co-"]


def test_title_filters(column):
    titles = ("Senior X", "Leading Y", "Principal Z", "Head of Q", "Engineer", None)
    assert column(P.senior_board_title, *titles) == [True, True, False, False, False, False]
    assert column(P.senior_remote_title, *titles) == [True, True, True, True, False, False]
    assert column(lambda t: P.matches_role(t, ["x", "gine"]), "Engineer", "Other", None) == [True, False, False]
    assert column(lambda t: P.matches_role(t, []), "a", None) == [True, True]


def test_worldwide(column):
    assert column(P.worldwide, None, "", "Worldwide", "Remote (US)", "Berlin") == [True, True, True, True, False]


def test_feed_title(column):
    split = column(X.split_feed_title, "Acme: Data Engineer", "Acme: Data: Eng", "Plain", "Acme: ", ": x")
    assert [(s.company, s.title) for s in split] == [
        ("Acme", "Data Engineer"), ("Acme", "Data: Eng"), ("Unknown", "Plain"), ("Unknown", "Acme: "), ("Unknown", "x")]


def test_url_parts(column):
    assert column(U.host, "https://A.b:80/x?y", "/rel", "http://bad host|/p", None) == ["a.b:80", "", "bad host|", ""]
    assert column(U.path_parts, "http://h//a/b;p=1?q#f", "http://h") == [["a", "b"], []]
    assert column(U.job_id, "http://h/job/12", "http://h/x?jobId=&jobId=a%20b", "http://h/job-7/x", "http://h/jobs/7") == ["12", "a b", "7", None]
    assert column(U.detect_board, "https://boards.greenhouse.io/x", "https://x.jobvite.com", "http://e.org", "http://e.org/lever.co") == [
        "greenhouse", "jobvite", None, None]


def test_remoteok_url(rows):
    df = rows("u STRING, s STRING", ("/x", "s"), ("", "s"), ("http://u", "s"), (None, None))
    assert [r.v for r in df.select(U.remoteok_url(F.col("u"), F.col("s")).alias("v")).collect()] == [
        "https://remoteok.com/x", "https://remoteok.com/remote-jobs/s", "http://u", ""]


def test_embedded_board_pattern_order(column):
    page = "jobs.lever.co/a/01234567-89ab-cdef-0123-456789abcdef boards.GREENHOUSE.io/b/jobs/5"
    assert column(U.embedded_board_url, page, "none", None) == ["https://boards.greenhouse.io/b/jobs/5", None, None]
