"""Tailoring plan: work list, candidates and postings to résumé contexts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.responses import reordered_list
from gristmill.operators import matching as M
from gristmill.operators.keywords import keyword_lists


def posting_keywords(pairs: DataFrame, postings: DataFrame, posting_id: str, text: str) -> DataFrame:
    """(posting_id, keywords) of the postings in the work list; other texts are not read for words."""
    wanted = postings.join(pairs.select(F.col("posting_id").alias(posting_id)).distinct(), posting_id, "left_semi")
    return keyword_lists(wanted, posting_id, text).select(F.col(posting_id).alias("posting_id"), "keywords")


def tailored(pairs: DataFrame, candidates: DataFrame, postings: DataFrame, posting_id: str, text: str,
             reorder_responses: DataFrame | None = None) -> DataFrame:
    """One nested context per (candidate_id, posting_id) of the work list. Only
    postings in the work list get keywords. Bullets are cut last, after reordering."""
    contexts = M.tailored_context(M.work_rows(pairs, candidates, posting_keywords(pairs, postings, posting_id, text)))
    if reorder_responses is not None:
        for section in ("experiences", "projects"):
            contexts = reordered(contexts, section, reorder_responses)
    return contexts.withColumn("experiences", M.cut_bullets(F.col("experiences")))


def reordered(contexts: DataFrame, section: str, responses: DataFrame) -> DataFrame:
    """P26 on contexts: bullets of each item in a section in the order of its response row, where there
    is one. `responses` has candidate_id, posting_id, section, item (position from 0), text."""
    answers = responses.filter(F.col("section") == section).groupBy("candidate_id", "posting_id").agg(
        # One context's items: a handful of answers.
        F.map_from_entries(F.collect_list(F.struct("item", "text"))).alias("answers"))
    joined = contexts.join(answers, ["candidate_id", "posting_id"], "left")
    return joined.withColumn(section, F.transform(section, lambda e, i: e.withField("bullets", reordered_list(
        F.try_element_at(F.col("answers"), i), e["bullets"])))).drop("answers")
