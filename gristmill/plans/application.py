"""The application run: from fetched postings to log updates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill import fixed_values as fv
from gristmill.functions.predicates import passes_score
from gristmill.functions.responses import application_result, score_from_response, verdict_from_response
from gristmill.functions.text import min_years, seniority, truthy
from gristmill.operators.limits import first_rows
from gristmill.operators.log import fill_from_scraped, without_applied


def drop_senior(postings: DataFrame, verdicts: DataFrame, description: str = "description", key: str = "url") -> DataFrame:
    """F8, P19. Text decides most rows; a verdict (key, verdict BOOLEAN, one row per key) counts only for
    undecided ones. A missing verdict does not drop a row."""
    text = F.col(description)
    judged = postings.withColumn("_senior", F.when(truthy(text), seniority(min_years(text))).otherwise(F.lit(False)))
    yes = verdicts.filter("verdict").select(F.col(key).alias("_v_key"))
    open_ = judged.filter(F.coalesce(~F.col("_senior"), F.lit(True)))
    return open_.join(yes, F.col("_senior").isNull() & F.col(key).eqNullSafe(F.col("_v_key")), "left_anti").drop("_senior")


def seniority_verdicts(responses: DataFrame, key: str = "url") -> DataFrame:
    """Verdict rows from a response batch (key, text)."""
    return responses.select(key, verdict_from_response(F.col("text")).alias("verdict"))


def scored(postings: DataFrame, responses: DataFrame, key: str = "url") -> DataFrame:
    """Adds the score of the response row with the same key and keeps the good ones."""
    scores = responses.select(F.col(key).alias("_s_key"), score_from_response(F.col("text")).alias("score"))
    return postings.join(scores, F.col(key) == F.col("_s_key")).drop("_s_key").filter(passes_score(F.col("score")))


def candidates_to_apply(postings: DataFrame, log: DataFrame, scraped: DataFrame, verdicts: DataFrame,
                        score_responses: DataFrame) -> DataFrame:
    """Postings not applied for, with descriptions filled in, neither senior nor
    scored low."""
    fresh = fill_from_scraped(without_applied(postings, log), scraped)
    return scored(drop_senior(fresh, verdicts), score_responses)


def log_updates(accepted: DataFrame, application_responses: DataFrame, cap: int | None = None, key: str = "url") -> DataFrame:
    """Pending log records of the postings with a usable response, with `cap` of the first of them, with `present`
    naming all their fields. The result is the input of the log upsert."""
    answers = application_responses.select(F.col(key).alias("_a_key"), application_result(F.col("text")).alias("result"))
    usable = accepted.join(answers, F.col(key) == F.col("_a_key")).filter(F.col("result.error").isNull())
    done = usable if cap is None else first_rows(usable, cap, "source_rank", "ord")
    names = ["title", "company", "score", "cover_letter", "fit_reason", "url", "status"]
    return done.select("title", "company", "score", "result.cover_letter", "result.fit_reason", "url",
                       F.lit("pending").alias("status"), F.array(*[F.lit(n) for n in names]).alias("present"),
                       "source_rank", "ord")
