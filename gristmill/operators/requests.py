"""Request rows for a model batch. Sending them is outside the library; answers come back as a
response table keyed by request_id. The wording is ours, the cuts and contents are fixed."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORE_CUT, REORDER_CUT, SENIORITY_CUT, EXTRACT_CUT = 800, 600, 1500, 6000


def cut(text: Column, n: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, n)


def numbered(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def _request(kind: str, ident: Column, body: Column) -> Column:
    return F.struct(F.concat(F.lit(kind + ":"), ident.cast("string")).alias("request_id"), F.lit(kind).alias("kind"), body.alias("text"))


def posting_block(title: Column, company: Column, description: Column, n: int = SCORE_CUT) -> Column:
    return F.concat(F.lit("Title: "), F.coalesce(title, F.lit("unknown")), F.lit("\nCompany: "),
                    F.coalesce(company, F.lit("unknown")), F.lit("\nDescription: "), cut(description, n))


def score_request(ident: Column, resume: Column, title: Column, company: Column, description: Column) -> Column:
    return _request("score", ident, F.concat(
        F.lit("Rate from 1 to 10 how well the resume fits the posting. Answer as {\"score\": n}.\n"),
        resume, F.lit("\n"), posting_block(title, company, description)))


def application_request(ident: Column, resume: Column, title: Column, company: Column, description: Column) -> Column:
    return _request("application", ident, F.concat(
        F.lit("Write a short letter and reason. Answer as {\"cover_letter\": ..., \"fit_reason\": ...}.\n"),
        resume, F.lit("\n"), posting_block(title, company, description)))


def advice_request(ident: Column, resume: Column, title: Column, company: Column, description: Column) -> Column:
    return _request("advice", ident, F.concat(
        F.lit("Say what to highlight, add, remove and rewrite, as JSON with those four lists.\n"),
        resume, F.lit("\n"), posting_block(title, company, description)))


def summary_request(ident: Column, summary: Column, description: Column) -> Column:
    return _request("summary", ident, F.concat(
        F.lit("Rewrite the summary for this posting.\n"), summary, F.lit("\n"), cut(description, SCORE_CUT)))


def seniority_request(ident: Column, description: Column) -> Column:
    return _request("seniority", ident, F.concat(
        F.lit("Does this ask for 2.5 or more years? Answer yes or no.\n"), cut(description, SENIORITY_CUT)))


def reorder_request(ident: Column, bullets: Column, description: Column) -> Column:
    return _request("reorder", ident, F.concat(
        F.lit("Order these lines by relevance, as a numbered list.\n"), numbered(bullets), F.lit("\n"),
        cut(description, REORDER_CUT)))


def projects_request(ident: Column, projects: Column, description: Column, limit: int = 3) -> Column:
    shown = F.transform(projects, lambda p: F.concat(p["name"], F.lit(": "), F.array_join(F.slice(p["bullets"], 1, 2), " ")))
    return _request("projects", ident, F.concat(
        F.lit(f"Pick the best {limit}; answer with their numbers, comma separated.\n"), numbered(shown), F.lit("\n"),
        cut(description, SCORE_CUT)))


def competencies_request(ident: Column, skills: Column, description: Column) -> Column:
    flat = F.flatten(F.transform(skills, lambda c: c["skills"]))
    return _request("competencies", ident, F.concat(
        F.lit("Name 6 to 8 matching skills, comma separated.\n"), F.array_join(flat, ", "), F.lit("\n"),
        cut(description, SCORE_CUT)))


def extraction_request(ident: Column, page_text: Column) -> Column:
    return _request("extraction", ident, F.concat(
        F.lit("Extract title, company, location and description as JSON.\n"), cut(page_text, EXTRACT_CUT)))


def request_rows(rows: DataFrame, *requests: Column) -> DataFrame:
    """One row per request: request_id, kind, text."""
    return rows.select(F.explode(F.array(*requests)).alias("r")).select("r.*")
