from pyspark.sql import functions as F

from gristmill.functions import html as H
from gristmill.operators import best_description as BD


def texts(rows, *values):
    df = rows("i INT, t STRING", *enumerate(values))
    return [r.v for r in H.with_text(df, "v", F.col("t")).orderBy("i").collect()]


def test_text_of_markup(rows):
    cases = {
        "&lt;p&gt;a&lt;/p&gt;b": "a b", "a < b": "a < b", "x&nbsp;y": "x y", "<p>one</p><!-- no --><p>two</p>": "one two",
        '<script>var t="</p>";</script><b>x</b>': "x", "<p title='a>b'>q</p>": "q", "R&D": "R&D", "<p>&amp;amp;</p>": "&",
        "&#233;&euro;<br>z": "é€ z", "<p>1 &lt 2</p>": "1 < 2", "": "", "a&amp;lt;p&amp;gt;": "a&lt;p&gt;",
        "<style>p{}</style>t<template>u</template>": "t", "<p>a<5 b</p>": "a<5 b",
    }
    assert texts(rows, *cases, None) == [*cases.values(), ""]


def test_native_and_parser_agree(rows):
    pages = ["<div>a <b>b</b><br/>c</div>", "<ul><li>1<li>2</ul>", "plain  text", "<p>x</p>\n<p>y</p>"]
    parsed = [H._text_by_parser.func(__import__("pandas").Series([p]))[0] for p in pages]
    assert texts(rows, *pages) == parsed


def test_references_without_a_semicolon_can_stay(rows):
    cases = {"<p>a&amp</p>": "a&amp", "a&amp": "a&amp", "<p>&copying &notit; &#65 &#x42;&#67;</p>": "&copying &notit; &#65 BC", "<p>&amp;amp; &eacute;&zeta;</p>": "& éζ",
             "&lt;b&gt;x & y&lt;/b&gt;&lt": "x & y &lt", "<p>R&D</p>": "R&D"}
    df = rows("i INT, t STRING", *enumerate(cases))
    assert [r.v for r in H.with_text(df, "v", F.col("t"), ended_only=True).orderBy("i").collect()] == list(cases.values())


def test_generic_text_keeps_references_without_a_semicolon(rows):
    long = "word " * 30
    page = f"<body><p>{long}a&amp</p>&zeta;</body>"
    df = rows("i INT, url STRING, html STRING", (0, "u", page))
    read = lambda ended: BD.with_generic_posting(df, "html", "p", ended).first().p.description
    assert (read(True), read(False)) == (long + "a&amp ζ", long + "a& ζ")
    pages = rows(PAGE, ("u", page, None, None, None, None))
    empty = rows("board STRING, slug STRING, job_id STRING, body STRING"), rows("slug STRING, body STRING, ord BIGINT")
    assert BD.best_descriptions(pages, *empty, ended_only=True).first().description == long + "a&amp ζ"


def generic(rows, *pages):
    df = rows("i INT, url STRING, html STRING", *[(i, "u", p) for i, p in enumerate(pages)])
    return [r.p for r in BD.with_generic_posting(df, "html", "p").orderBy("i").collect()]


def test_generic_posting(rows):
    long = "word " * 30
    body, nobody, nested, short, odd = generic(
        rows,
        f"<title>T</title><body><header><h1>H</h1></header><nav>n</nav><article>{long}</article><footer>f</footer></body>",
        f"<div class='job-Description'>{long}<div>more</div></div><main>x</main>",
        f"<body><nav><nav>in</nav>out</nav><p>{long}</p></body>",
        "<body>too short</body>",
        f"<body><h1>A&amp;B</h1>{long}&eacute;&zeta;")
    assert (body.title, body.description) == ("T", long.strip())
    assert nobody.description == long.strip() + " more" and nobody.title == "Unknown"
    assert nested.description == long.strip()
    assert short is None
    assert odd.title == "A&B" and odd.description.endswith("éζ")


def test_titles_and_frames(column):
    assert column(H.page_title, "<meta content='x &amp; y' property='og:title'><title>t</title>", "<title> a\nb </title>",
                  '<meta name="twitter:title" content="tw"/>', "") == ["x & y", "a b", "tw", ""]
    assert column(H.iframe_source, "<iframe src='/a'></iframe><iframe src=http://b></iframe>", "<p>") == ["http://b", None]


def test_json_ld(rows):
    text = "d" * 120

    def page(body):
        return f'<script type="application/ld+json">{body}</script>'

    df = rows(
        "url STRING, html STRING",
        ("object", page(f'{{"@type":"JobPosting","title":"a","description":"{text}","hiringOrganization":{{"name":"o"}},'
                        '"jobLocation":{"address":{"addressLocality":"x","addressRegion":"y"}}}')),
        ("array", page(f'[{{"@type":"JobPosting","title":"s","description":"x"}},{{"@type":"JobPosting","name":"b",'
                       f'"jobDescription":"{text}","hiringOrganization":"org","jobLocation":{{"address":"addr"}}}}]')),
        ("salvage", page(f'x = {{"@type":"JobPosting","title":"c","description":"{text}","jobLocation":[{{}}]}};')),
        ("graph", page(f'{{"@graph":[{{"@type":"JobPosting","description":"{text}"}}]}}')),
        ("types", page(f'{{"@type":["JobPosting"],"description":"{text}"}}')))
    found = {r.url: r.posting for r in BD.json_ld_postings(df).collect()}
    assert sorted(found) == ["array", "object", "salvage"]
    assert (found["object"].title, found["object"].company, found["object"].location) == ("a", "o", "x y")
    assert (found["array"].title, found["array"].company, found["array"].location) == ("b", "org", "addr")
    assert (found["salvage"].company, found["salvage"].location) == ("Unknown", "Unknown")


PAGE = "url STRING, html STRING, iframe_html STRING, rendered_html STRING, rendered_iframe_html STRING, rendered_text STRING"


def body(n, letter="w"):
    return f"<body>{letter * n}</body>"


def test_ladder(rows):
    details = rows("board STRING, slug STRING, job_id STRING, body STRING",
                   ("greenhouse", "a", "1", '{"title":"api","content":"board"}'), ("careers", "Celonis", "9", '{"title":"car","description":"careers"}'),
                   ("greenhouse", "a", "2", '{"title":"emb","content":"embedded"}'))
    boards = rows("slug STRING, body STRING, ord BIGINT", ("co", '{"jobs":[{"title":"ash","jobUrl":"http://x/co/abc1","descriptionPlain":"ashby"}]}', 0))
    pages = rows(
        PAGE,
        ("https://boards.greenhouse.io/a/jobs/1", body(900), None, None, None, None),
        ("https://careers.celonis.com/job-detail?jobId=9", None, None, None, None, None),
        ("https://jobs.ashbyhq.com/co/abc", None, None, None, None, None),
        ("http://embedded", body(900) + "//boards.greenhouse.io/a/jobs/2", None, None, None, None),
        ("http://full", body(800), None, body(900, "r"), None, "t" * 1000),
        ("http://short", body(799), None, body(900, "r"), None, "t" * 850),
        ("http://tie", body(300), None, body(300, "r"), None, "t" * 300),
        ("http://over", None, None, body(6000, "r"), None, "t" * 7000),
        ("http://text", body(99), None, body(50, "r"), None, "\n First \n" + "t" * 100),
        ("http://frame", body(300), body(120, "f"), None, None, None),
        ("http://rendered-board", body(300), None, body(400) + "//boards.greenhouse.io/a/jobs/2", None, ""),
        ("http://asked", None, None, "<body></body>", None, "tiny"),
        ("http://nothing", body(99), None, None, None, None))
    responses = rows("url STRING, text STRING", ("http://asked", 'x {"title":"l","description":"from response"} y'),
                     ("http://full", '{"title":"l","description":"unused"}'))
    best = {r.url: r for r in BD.best_descriptions(pages, details, boards, responses).collect()}
    got = {u: (r.source, r.description[:1], len(r.description)) for u, r in best.items()}
    assert got == {
        "https://boards.greenhouse.io/a/jobs/1": ("greenhouse", "b", 5), "https://careers.celonis.com/job-detail?jobId=9": ("careers-api", "c", 7),
        "https://jobs.ashbyhq.com/co/abc": ("ashby", "a", 5), "http://embedded": ("greenhouse", "e", 8), "http://full": ("generic", "w", 800),
        "http://short": ("generic", "r", 900), "http://tie": ("generic", "w", 300), "http://over": ("generic", "r", 5000),
        "http://text": ("generic", "F", 106), "http://frame": ("generic", "f", 120), "http://rendered-board": ("generic", "w", 300),
        "http://asked": ("llm", "f", 13)}
    assert best["http://text"].title == "First"


def test_ladder_reads_only_what_is_open(spark, rows, monkeypatch):
    """Rows that enter the parser, page and rendered page apart."""
    entered = []
    inner = BD.page_postings

    def counted(documents):
        entered.append(sorted((r.url, r.slot) for r in documents.collect()))
        return inner(documents)

    monkeypatch.setattr(BD, "page_postings", counted)
    details = rows("board STRING, slug STRING, job_id STRING, body STRING", ("greenhouse", "a", "1", '{"title":"api","content":"board"}'),
                   ("greenhouse", "a", "2", '{"title":"emb","content":"embedded"}'), ("careers", "Celonis", "9", '{"title":"car","description":"careers"}'))
    pages = rows(PAGE, ("https://boards.greenhouse.io/a/jobs/1", body(900), body(900), body(900), None, "x"),
                 ("https://careers.celonis.com/job-detail?jobId=9", body(900), None, body(900), None, "x"),
                 ("http://embedded", body(900) + "//boards.greenhouse.io/a/jobs/2", None, body(900), None, "x"),
                 ("http://full", body(800), None, body(900), body(900), "x"), ("http://open", body(799), body(10), body(900), body(20), "x"))
    best = BD.best_descriptions(pages, details, rows("slug STRING, body STRING, ord BIGINT"))
    assert entered == [[("http://full", 0), ("http://open", 0), ("http://open", 1)], [("http://open", 0), ("http://open", 1)]]
    assert {r.url: len(r.description) for r in best.collect()} == {
        "https://boards.greenhouse.io/a/jobs/1": 5, "https://careers.celonis.com/job-detail?jobId=9": 7, "http://embedded": 8, "http://full": 800, "http://open": 900}
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "NestedLoop" not in plan


def test_comments_and_script_strings_are_not_markup(column):
    assert column(H.iframe_source, '<!-- <iframe src="http://old"> --><script>x = "<iframe src=\'http://js\'>"</script><iframe src="http://new">') == ["http://new"]
    assert column(H.page_title, "<!-- <title>Old</title> --><script>'<title>js</title>'</script><title>New</title>") == ["New"]
    assert column(H.page_title, '<!-- <meta property="og:title" content="Old"> --><title>New</title>') == ["New"]
    block = '<script type="application/ld+json">{"a": "%s"}</script>'
    assert column(H.json_ld_blocks, "<!-- " + block % "old" + " -->" + block % "new") == [['{"a": "new"}']]
