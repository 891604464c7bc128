"""Matching tagged résumé items against the keywords of a posting.

A work list names the (candidate, posting) pairs to evaluate. Each pair meets its candidate once and
its posting's keyword array (at most 30 entries) once; everything after is local to the row. Nothing
is exploded by tag, so a tag or keyword that occurs everywhere causes no skew.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill import fixed_values as fv
from gristmill.functions.text import strip_blank


def match_count(tags: Column, keywords: Column) -> Column:
    """Tags that equal a keyword, ignoring case; a repeated tag counts each time."""
    return F.size(F.filter(F.coalesce(tags, F.array().cast("array<string>")),
                           lambda t: F.array_contains(keywords, F.lower(t))))


def selection_keywords(keywords: Column, limit: int = fv.SELECTION_KEYWORDS) -> Column:
    """Selection looks at the first ten keywords only."""
    return F.slice(keywords, 1, limit)


def work_rows(pairs: DataFrame, candidates: DataFrame, keyword_lists: DataFrame) -> DataFrame:
    """Pairs (candidate_id, posting_id) with the candidate's items and the posting's keywords. A
    posting without keywords has an empty list."""
    lists = keyword_lists.select("posting_id", F.transform("keywords", F.lower).alias("keywords"))
    return pairs.join(lists, "posting_id", "left").join(candidates, "candidate_id").withColumn(
        "keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def _by_score(items: Column, score, *more) -> Column:
    """Items as structs (order, ..., item) sorted by descending score, ties in input order."""
    return F.array_sort(F.transform(items, lambda item, i: F.struct(
        (-score(item)).alias("order"), i.alias("at"), item.alias("item"))))


def tag_scores(rows: DataFrame) -> DataFrame:
    """Per pair the scored experiences and projects, best first. All keywords count."""
    kw = F.col("keywords")
    experiences = _by_score(F.col("work_experience"), lambda e: match_count(e["tags"], kw))
    projects = _by_score(F.col("projects"), lambda p: match_count(p["tags"], kw))
    return rows.select(
        "candidate_id", "posting_id",
        F.transform(experiences, lambda s: F.struct(
            F.concat(s["item"]["role"], F.lit(" @ "), s["item"]["company"]).alias("title"),
            (-s["order"]).alias("score"),
            F.transform(s["item"]["bullets"], lambda b: match_count(b["tags"], kw)).alias("bullet_scores"),
            F.size(s["item"]["bullets"]).alias("total_bullets"))).alias("experiences"),
        F.transform(projects, lambda s: F.struct(
            s["item"]["name"].alias("title"), (-s["order"]).alias("score"))).alias("projects"))


def select_experiences(items: Column, keywords: Column, minimum: int = fv.MIN_EXPERIENCES) -> Column:
    """Every high-priority item with all bullets; then the others, best tag match first, until
    there are three, with three bullets if any tag matched and two if none did. The cut is given as
    `max_bullets` (NULL: all) and made by cut_bullets, after a possible reordering."""
    kw = selection_keywords(keywords)
    high = F.filter(items, lambda e: F.coalesce(e["priority"] == "high", F.lit(False)))
    rest = _by_score(F.filter(items, lambda e: F.coalesce(e["priority"] != "high", F.lit(True))),
                     lambda e: match_count(e["tags"], kw))

    def shown(e: Column, max_bullets: Column) -> Column:
        return F.struct(e["company"].alias("company"), e["role"].alias("role"), e["period"].alias("period"),
                        F.transform(e["bullets"], lambda b: b["text"]).alias("bullets"),
                        max_bullets.cast("int").alias("max_bullets"))

    chosen = F.slice(rest, F.lit(1), F.greatest(F.lit(minimum) - F.size(high), F.lit(0)))
    return F.concat(
        F.transform(high, lambda e: shown(e, F.lit(None))),
        F.transform(chosen, lambda s: shown(s["item"], F.when(s["order"] < 0, 3).otherwise(2))))


def cut_bullets(experiences: Column) -> Column:
    """The selected experiences with their bullets cut to max_bullets."""
    return F.transform(experiences, lambda e: F.struct(
        e["company"].alias("company"), e["role"].alias("role"), e["period"].alias("period"),
        F.slice(e["bullets"], F.lit(1), F.coalesce(e["max_bullets"], F.size(e["bullets"]))).alias("bullets")))


def select_projects(items: Column, keywords: Column, top: int = fv.TOP_PROJECTS,
                    minimum: int = fv.MIN_PROJECTS) -> Column:
    """The two best by tag match plus priority bonus; then those whose name is not taken yet,
    by tag match alone, until there are three (or all)."""
    kw = selection_keywords(keywords)

    def bonus(p: Column) -> Column:
        value = F.lit(0)
        for name, points in fv.PRIORITY_BONUS.items():
            value = F.when(F.coalesce(p["priority"] == name, F.lit(False)), points).otherwise(value)
        return value

    first = F.transform(F.slice(_by_score(items, lambda p: match_count(p["tags"], kw) + bonus(p)), 1, top),
                        lambda s: s["item"])
    taken = F.transform(first, lambda p: p["name"])
    others = F.transform(_by_score(F.filter(items, lambda p: ~F.array_contains(taken, p["name"])),
                                   lambda p: match_count(p["tags"], kw)), lambda s: s["item"])
    missing = F.greatest(F.least(F.lit(minimum), F.size(items)) - F.size(first), F.lit(0))
    return F.transform(F.concat(first, F.slice(others, F.lit(1), missing)), lambda p: F.struct(
        p["name"].alias("name"), F.transform(p["bullets"], lambda b: b["text"]).alias("bullets"), p["link"].alias("link")))


def regroup_skills(skills: Column) -> Column:
    """Four fixed groups filled from their categories in order. The last of equal categories
    counts, a missing one adds nothing, and unmapped categories are dropped."""
    def of_category(name: str) -> Column:
        same = F.filter(skills, lambda c: F.coalesce(c["category"] == name, F.lit(False)))
        return F.coalesce(F.try_element_at(same, F.lit(-1))["skills"], F.array().cast("array<string>"))

    return F.array(*[F.struct(F.lit(group).alias("category"),
                              F.concat(*[of_category(c) for c in categories]).alias("skills"))
                     for group, categories in fv.SKILL_GROUPS])


def candidate_text(rows: DataFrame) -> DataFrame:
    """K4: one text per candidate in a fixed section order. Link, GPA and coursework lines appear only
    when they have a value."""
    nothing = F.array().cast("array<string>")
    blank, rule = F.lit(""), F.lit("---")

    def optional(value: Column, line: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.array(line)).otherwise(nothing)

    def bullets(item: Column) -> Column:
        return F.transform(item["bullets"], lambda b: F.concat(F.lit("* "), b["text"]))

    def text_of(value: Column) -> Column:
        return F.coalesce(value, F.lit(""))

    p = F.col("personal")
    contact = F.concat(F.lit("Email: ["), p["email"], F.lit("] | Phone: ["), p["phone"], F.lit("] | GitHub: ["),
                       text_of(p["github"]), F.lit("] | LinkedIn: ["), text_of(p["linkedin"]), F.lit("]"))

    def heading(name: str) -> list[Column]:
        return [blank, rule, blank, F.lit(f"### {name}"), blank]

    jobs = F.flatten(F.transform("work_experience", lambda e: F.concat(
        F.array(F.concat(F.lit("**"), e["role"], F.lit(" — "), e["company"], F.lit("**")), e["period"], blank),
        bullets(e), F.array(blank, rule, blank))))
    projects = F.flatten(F.transform("projects", lambda x: F.concat(
        F.array(F.concat(F.lit("**"), x["name"], F.lit("**"))),
        optional(x["link"], F.concat(F.lit("Link: "), x["link"])), F.array(blank),
        bullets(x), F.array(blank, rule, blank))))
    education = F.flatten(F.transform("education", lambda d: F.concat(
        F.array(F.concat(F.lit("**"), d["degree"], F.lit(" — "), d["school"], F.lit("**"))),
        optional(d["gpa"], F.concat(F.lit("GPA: "), d["gpa"])), F.array(blank),
        F.when(F.size(F.coalesce(d["coursework"], nothing)) > 0, F.array(
            F.lit("### COURSEWORK"), blank, F.array_join(d["coursework"], ", "))).otherwise(nothing))))
    skills = F.transform("skills", lambda c: F.concat(F.lit("**"), c["category"], F.lit(":** "), F.array_join(c["skills"], ", ")))
    lines = F.concat(
        F.array(p["name"], p["location"], contact, *heading("SUMMARY"), F.col("summary"), *heading("SKILLS")), skills,
        F.array(*heading("WORK EXPERIENCE")), jobs, F.array(F.lit("### PROJECTS"), blank), projects,
        F.array(F.lit("### EDUCATION"), blank), education)
    return rows.select("candidate_id", strip_blank(F.array_join(lines, "\n")).alias("text"))


def tailored_context(rows: DataFrame) -> DataFrame:
    """The nested context of a tailored résumé per pair, bullets not cut yet: everything a template
    needs but the rewritten summary, which arrives as a response row."""
    kw = F.col("keywords")
    return rows.select(
        "candidate_id", "posting_id", "personal", "summary",
        select_experiences(F.col("work_experience"), kw).alias("experiences"),
        select_projects(F.col("projects"), kw).alias("projects"),
        regroup_skills(F.col("skills")).alias("skills"), "education")
