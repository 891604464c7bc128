"""Candidates against postings.

A candidate is a conversation turn: each odd sentence line is an experience, each even one a project.
The work list pairs each candidate with the document that has the number of its conversation.
"""

from pyspark.sql import functions as F

from gristmill.operators import matching as M
from gristmill.operators.keywords import keyword_lists
from gristmill.plans import tailoring as TL
from gristmill.queries import query, table
from gristmill.queries.text import keyword_lists_sql

PRIORITY = "CASE (length(line) + i) % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END"


def _candidates(spark, folder):
    rows = table(spark, folder, "conversations").withColumn("candidate_id", F.expr("conv_id || '-' || turn"))
    lines = F.filter(F.split("text", r"[.\n]+\s*"), lambda l: F.length(l) > 0)

    def words(line):
        return F.filter(F.split(line, " "), lambda w: w != "")

    def priority(line, i):
        rest = (F.length(line) + i) % 4
        return F.when(rest == 0, "high").when(rest == 1, "low").otherwise("medium")

    def bullets(line):
        return F.transform(words(line), lambda w: F.struct(F.concat(F.lit("did "), w).alias("text"), F.array(w).alias("tags")))

    items = F.transform(lines, lambda line, i: F.struct(line.alias("line"), i.alias("i")))
    experience = F.transform(F.filter(items, lambda x: x["i"] % 2 == 0), lambda x: F.struct(
        F.concat(F.lit("c"), x["i"].cast("string")).alias("company"), F.concat(F.lit("r"), x["i"].cast("string")).alias("role"),
        F.lit("now").alias("period"), bullets(x["line"]).alias("bullets"), words(x["line"]).alias("tags"),
        priority(x["line"], x["i"]).alias("priority")))
    projects = F.transform(F.filter(items, lambda x: x["i"] % 2 == 1), lambda x: F.struct(
        F.concat(F.lit("p"), (x["i"] % 8).cast("string")).alias("name"), bullets(x["line"]).alias("bullets"),
        words(x["line"]).alias("tags"), F.lit("").alias("link"), priority(x["line"], x["i"]).alias("priority")))
    return rows.select(
        "candidate_id", F.lit(None).cast("string").alias("personal"), F.lit("s").alias("summary"),
        experience.alias("work_experience"), projects.alias("projects"), F.col("conv_id").alias("posting_id"))


def _work(spark, folder):
    candidates = _candidates(spark, folder)
    pairs = candidates.select("candidate_id", "posting_id")
    return M.work_rows(pairs, candidates.drop("posting_id"), TL.posting_keywords(pairs, table(spark, folder, "documents"), "doc_id", "text"))


# Items of the candidates in long form, with tag counts against all keywords (s30) and the first ten (s10).
ITEMS_SQL = f"""WITH {keyword_lists_sql()},
turns AS (SELECT conv_id || '-' || turn AS cid, conv_id AS pid, list_filter(regexp_split_to_array(text, '[.\\n]+\\s*'), lambda l: length(l) > 0) AS ls FROM conversations),
item_lines AS (SELECT cid, pid, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM turns),
scored AS (SELECT cid, pid, i, line, list_filter(string_split(line, ' '), lambda w: w <> '') AS ws, {PRIORITY} AS priority,
  kws[1:10] AS k10, kws FROM item_lines JOIN lists ON doc_id = pid),
items AS (SELECT cid, pid, i, ws, priority, len(list_filter(ws, lambda w: list_contains(kws, lower(w)))) AS s30,
  len(list_filter(ws, lambda w: list_contains(k10, lower(w)))) AS s10, kws FROM scored)"""
# Experiences in their order, and the chosen projects with their place.
EXPERIENCES_SQL = """e AS (SELECT *, count_if(priority = 'high') OVER (PARTITION BY cid) AS n_high,
  row_number() OVER (PARTITION BY cid, priority = 'high' ORDER BY CASE WHEN priority = 'high' THEN 0 ELSE -s10 END, i) AS rn FROM items WHERE i % 2 = 0)"""
PROJECTS_SQL = """p AS (SELECT *, 'p' || (i % 8) AS name, count(*) OVER (PARTITION BY cid) AS n_all,
  row_number() OVER (PARTITION BY cid ORDER BY s10 + CASE priority WHEN 'high' THEN 5 WHEN 'medium' THEN 2 ELSE 0 END DESC, i) AS rn FROM items WHERE i % 2 = 1),
top AS (SELECT * FROM p WHERE rn <= 2),
rest AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY s10 DESC, i) AS rr FROM p
  WHERE NOT EXISTS (SELECT 1 FROM top t WHERE t.cid = p.cid AND t.name = p.name)),
chosen AS (SELECT cid, pid, rn AS place, name, ws FROM top UNION ALL SELECT cid, pid, 2 + rr, name, ws FROM rest WHERE rr <= least(3, n_all) - 2)"""


@query(ITEMS_SQL + """ SELECT cid AS candidate_id, pid AS posting_id, CASE WHEN i % 2 = 0 THEN 'experience' ELSE 'project' END AS kind,
  CAST(row_number() OVER (PARTITION BY cid, i % 2 ORDER BY s30 DESC, i) AS INTEGER) AS place,
  CASE WHEN i % 2 = 0 THEN 'r' || i || ' @ c' || i ELSE 'p' || (i % 8) END AS title, CAST(s30 AS INTEGER) AS score,
  CASE WHEN i % 2 = 0 THEN array_to_string(list_transform(ws, lambda w: CASE WHEN list_contains(kws, lower(w)) THEN 1 ELSE 0 END), ',') END AS bullet_scores
  FROM items""")
def tag_scores(spark, folder):
    """Scored items per pair, best first."""
    rows = M.tag_scores(_work(spark, folder))
    experiences = rows.select("candidate_id", "posting_id", F.lit("experience").alias("kind"), F.posexplode("experiences").alias("pos", "x")).select(
        "candidate_id", "posting_id", "kind", (F.col("pos") + 1).alias("place"), "x.title", "x.score",
        F.array_join(F.transform("x.bullet_scores", lambda s: s.cast("string")), ",").alias("bullet_scores"))
    projects = rows.select("candidate_id", "posting_id", F.lit("project").alias("kind"), F.posexplode("projects").alias("pos", "x")).select(
        "candidate_id", "posting_id", "kind", (F.col("pos") + 1).alias("place"), "x.title", "x.score", F.lit(None).cast("string").alias("bullet_scores"))
    return experiences.unionByName(projects)


@query(f"{ITEMS_SQL}, {EXPERIENCES_SQL}" + """
SELECT cid AS candidate_id, pid AS posting_id, CAST(CASE WHEN priority = 'high' THEN rn ELSE n_high + rn END AS INTEGER) AS place, 'c' || i AS company,
  array_to_string(list_transform(CASE WHEN priority = 'high' THEN ws WHEN s10 > 0 THEN ws[1:3] ELSE ws[1:2] END, lambda w: 'did ' || w), '|') AS bullets
FROM e WHERE priority = 'high' OR rn <= 3 - n_high""")
def select_experiences(spark, folder):
    """W4, W7."""
    rows = _work(spark, folder).select("candidate_id", "posting_id", F.posexplode(M.cut_bullets(
        M.select_experiences(F.col("work_experience"), F.col("keywords")))).alias("pos", "x"))
    return rows.select("candidate_id", "posting_id", (F.col("pos") + 1).alias("place"), "x.company", F.array_join("x.bullets", "|").alias("bullets"))


@query(f"{ITEMS_SQL}, {PROJECTS_SQL}" + """
SELECT cid AS candidate_id, pid AS posting_id, CAST(place AS INTEGER) AS place, name, array_to_string(list_transform(ws, lambda w: 'did ' || w), '|') AS bullets FROM chosen""")
def select_projects(spark, folder):
    """W5, W7, U5."""
    rows = _work(spark, folder).select("candidate_id", "posting_id", F.posexplode(
        M.select_projects(F.col("projects"), F.col("keywords"))).alias("pos", "x"))
    return rows.select("candidate_id", "posting_id", (F.col("pos") + 1).alias("place"), "x.name", F.array_join("x.bullets", "|").alias("bullets"))


SKILLS = """transform(array('Backend', 'Databases', 'AI/ML', 'Other', 'Backend'), (c, i) -> struct(c AS category,
  array(p_type || i, p_name) AS skills))"""


@query("""SELECT p_partkey, 'Languages:;Frameworks & Libraries:' || p_type || '2,' || p_name || ',' || p_type || '4,' || p_name ||
  ';Tools & Platforms:' || p_type || '1,' || p_name || ';Concepts:' AS groups FROM part""")
def skill_groups(spark, folder):
    """The last of equal categories counts, unmapped ones are dropped."""
    groups = M.regroup_skills(F.expr(SKILLS))
    return table(spark, folder, "part").select("p_partkey", F.array_join(F.transform(
        groups, lambda g: F.concat(g["category"], F.lit(":"), F.array_join(g["skills"], ","))), ";").alias("groups"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS candidate_id, s_name || chr(10) || n_name || chr(10) || 'Email: [e@x] | Phone: [1] | GitHub: [] | LinkedIn: [in]' ||
  chr(10) || chr(10) || '---' || chr(10) || chr(10) || '### SUMMARY' || chr(10) || chr(10) || 'Sum' || chr(10) || chr(10) || '---' || chr(10) || chr(10) ||
  '### SKILLS' || chr(10) || chr(10) || '**Cat:** a, b' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '### WORK EXPERIENCE' || chr(10) || chr(10) ||
  '**Eng — ' || s_name || '**' || chr(10) || 'now' || chr(10) || chr(10) || '* did ' || n_name || chr(10) || chr(10) || '---' || chr(10) || chr(10) ||
  '### PROJECTS' || chr(10) || chr(10) || '**P**' || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE chr(10) || 'Link: http://l' END || chr(10) || chr(10) || '* b' ||
  chr(10) || chr(10) || '---' || chr(10) || chr(10) || '### EDUCATION' || chr(10) || chr(10) || '**BSc — ' || n_name || '**' ||
  CASE WHEN s_suppkey % 3 = 0 THEN chr(10) || 'GPA: 3.9' ELSE '' END ||
  CASE WHEN s_suppkey % 5 = 0 THEN chr(10) || chr(10) || '### COURSEWORK' || chr(10) || chr(10) || 'x, y' ELSE '' END AS text
  FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def candidate_text(spark, folder):
    """résumé text with optional link, GPA and coursework lines."""
    rows = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    nested = rows.select(
        F.col("s_suppkey").cast("string").alias("candidate_id"),
        F.expr("named_struct('name', s_name, 'email', 'e@x', 'phone', '1', 'location', n_name, 'github', '', 'linkedin', 'in', 'website', '')").alias("personal"),
        F.lit("Sum").alias("summary"),
        F.expr("""array(named_struct('company', s_name, 'role', 'Eng', 'period', 'now', 'bullets',
          array(named_struct('text', 'did ' || n_name, 'tags', array('t'))), 'tags', array('t'), 'priority', 'high'))""").alias("work_experience"),
        F.expr("""array(named_struct('name', 'P', 'bullets', array(named_struct('text', 'b', 'tags', array('t'))), 'tags', array('t'),
          'link', CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'http://l' END, 'priority', 'low'))""").alias("projects"),
        F.expr("""array(named_struct('degree', 'BSc', 'school', n_name, 'gpa', CASE WHEN s_suppkey % 3 = 0 THEN '3.9' END, 'period', CAST(NULL AS STRING),
          'coursework', CASE WHEN s_suppkey % 5 = 0 THEN array('x', 'y') ELSE CAST(array() AS ARRAY<STRING>) END))""").alias("education"),
        F.expr("array(named_struct('category', 'Cat', 'skills', array('a', 'b')))").alias("skills"))
    return M.candidate_text(nested)


@query(f"""{ITEMS_SQL}, {EXPERIENCES_SQL}, {PROJECTS_SQL},
chosen_experiences AS (SELECT cid, string_agg('c' || i || '=' || array_to_string(list_transform(CASE WHEN priority = 'high' THEN ws
  WHEN s10 > 0 THEN ws[1:3] ELSE ws[1:2] END, lambda w: 'did ' || w), '|'), ';' ORDER BY CASE WHEN priority = 'high' THEN rn ELSE n_high + rn END) AS experiences
  FROM e WHERE priority = 'high' OR rn <= 3 - n_high GROUP BY 1),
chosen_projects AS (SELECT cid, string_agg(name || '=' || array_to_string(list_transform(ws, lambda w: 'did ' || w), '|'), ';' ORDER BY place) AS projects
  FROM chosen GROUP BY 1)
SELECT cid AS candidate_id, pid AS posting_id, coalesce(experiences, '') AS experiences, coalesce(projects, '') AS projects,
  'Languages=;Frameworks & Libraries=a;Tools & Platforms=;Concepts=' AS skills
FROM turns LEFT JOIN chosen_experiences USING (cid) LEFT JOIN chosen_projects USING (cid)""")
def tailored_context(spark, folder):
    """W4, W5, W7, P32 as one context per pair, its sections as text."""
    candidates = _candidates(spark, folder)
    pairs = candidates.select("candidate_id", "posting_id")
    full = candidates.drop("posting_id").withColumns({
        "skills": F.expr("array(named_struct('category', 'Backend', 'skills', array('a')))"),
        "education": F.expr("CAST(array() AS ARRAY<STRUCT<degree: STRING, school: STRING>>)")})
    contexts = TL.tailored(pairs, full, table(spark, folder, "documents"), "doc_id", "text")

    def text(section, name, values):
        return F.array_join(F.transform(section, lambda x: F.concat(x[name], F.lit("="), F.array_join(x[values], "|"))), ";").alias(section)

    return contexts.select("candidate_id", "posting_id", text("experiences", "company", "bullets"),
                           text("projects", "name", "bullets"), text("skills", "category", "skills"))
