"""Statistics of the application log."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill import fixed_values as fv
from gristmill.operators.limits import one_row


def status_counts(log: DataFrame) -> DataFrame:
    """E1."""
    return log.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def top_companies(log: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent companies, ties by first appearance."""
    counted = log.groupBy(F.coalesce("company", F.lit("")).alias("company")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
    return counted.orderBy(F.desc("n"), "first_ord").limit(k)


def dataset_summary(log: DataFrame) -> DataFrame:
    """E3, E4. Distinct counts are exact; titles and companies are counted in their own aggregates so
    that no row is expanded for them."""
    totals = log.agg(
        F.count(F.lit(1)).alias("n_jobs"),
        F.count_if(F.coalesce(F.col("cover_letter") != "", F.lit(False))).alias("n_with_cover_letter"),
        F.count_if(F.coalesce(F.col("fit_reason") != "", F.lit(False))).alias("n_with_fit_reason"))
    titles = log.select(F.coalesce("title", F.lit("")).alias("x")).distinct().agg(F.count("x").alias("n_distinct_titles"))
    companies = log.select(F.coalesce("company", F.lit("")).alias("x")).distinct().agg(F.count("x").alias("n_companies"))
    return one_row(totals, titles, companies)


def distribution(rows: DataFrame, value: str, *groups: str) -> DataFrame:
    """Rows per value, NULL values ignored. Counting combines before the shuffle, so this is the
    small table all order statistics below are read from."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("value")).agg(
        F.count(F.lit(1)).alias("n"))


def score_statistics(rows: DataFrame, value: str, *groups: str) -> DataFrame:
    """E5 to E9 per group: n, mean, median, stdev, min, max, p95, all exact.

    Scores are integers, so the distribution per group is small however many rows there are;
    cumulative counts over it give the ranks. p95 is the value at 0-based rank
    min(n - 1, int(0.95 n)), which no built-in percentile returns.
    """
    dist = distribution(rows, value, *groups)
    over = Window.partitionBy(*(groups or [F.lit(1)]))
    upto = over.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = dist.select(*groups, "value", "n", F.sum("n").over(upto).alias("upto"), F.sum("n").over(over).alias("total"))

    def at_rank(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col("value")))

    total = F.col("total")
    x, w = F.col("value").cast("double"), F.col("n")
    spread = (F.sum(x * x * w) - F.sum(x * w) * F.sum(x * w) / F.sum(w)) / F.nullif(F.sum(w) - 1, F.lit(0))
    return ranked.groupBy(*groups).agg(
        F.coalesce(F.sum(w), F.lit(0)).alias("n"),
        F.coalesce(F.sum(x * w) / F.sum(w), F.lit(0.0)).alias("mean"),
        F.coalesce((at_rank(F.floor((total - 1) / 2)) + at_rank(F.floor(total / 2))) / 2, F.lit(0.0)).alias("median"),
        F.coalesce(F.sqrt(F.greatest(spread, F.lit(0.0))), F.lit(0.0)).alias("stdev"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.coalesce(at_rank(F.least(total - 1, F.floor(F.lit(0.95) * total))), F.lit(0)).alias("p95"))


def score_by_status(log: DataFrame, status: str = "status", score: str = "score") -> DataFrame:
    """Applied against everything else, a missing status included."""
    grouped = log.select(
        F.when(F.coalesce(F.col(status) == "applied", F.lit(False)), "applied").otherwise("pending").alias("group"),
        F.col(score).alias("score"))
    return score_statistics(grouped, "score", "group")


def score_histogram(rows: DataFrame, score: str = "score") -> DataFrame:
    """Unit-width bins centred on the integers."""
    return rows.filter(F.col(score).isNotNull()).groupBy(F.floor(F.col(score) + 0.5).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def box_plot(rows: DataFrame, group: str, score: str = "score") -> DataFrame:
    """Quartiles (linear interpolation), whiskers within 1.5 interquartile ranges, outliers."""
    dist = distribution(rows, score, group)
    quartiles = dist.groupBy(group).agg(F.expr("percentile(value, array(0.25D, 0.5D, 0.75D), n)").alias("q"))
    reach = (F.col("q")[2] - F.col("q")[0]) * 1.5
    low, high = F.col("q")[0] - reach, F.col("q")[2] + reach
    inside = F.col("value").between(low, high)
    joined = dist.join(quartiles, group)
    return joined.groupBy(group).agg(
        F.sum("n").alias("n"), F.first(F.col("q")[0]).alias("q1"), F.first(F.col("q")[1]).alias("median"),
        F.first(F.col("q")[2]).alias("q3"),
        F.min(F.when(inside, F.col("value"))).alias("low_whisker"),
        F.max(F.when(inside, F.col("value"))).alias("high_whisker"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("n_outliers"))


def mean_length(rows: DataFrame, text: str) -> DataFrame:
    """Characters per non-empty text."""
    return rows.filter(F.coalesce(F.col(text) != "", F.lit(False))).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.length(text)), F.lit(0.0)).alias("mean_len_chars"))


def cost_model(rows: DataFrame, calls: int = fv.CALLS_PER_RESUME, tokens: int = fv.TOKENS_PER_RESUME,
               usd_in: float = fv.USD_PER_MILLION_IN, usd_out: float = fv.USD_PER_MILLION_OUT,
               input_share: float = fv.INPUT_SHARE, output_share: float = fv.OUTPUT_SHARE) -> DataFrame:
    """Totals for one application per row. The total uses the unrounded unit cost."""
    unit = (tokens * input_share * usd_in + tokens * output_share * usd_out) / 1_000_000
    n = F.col("n")
    return rows.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(calls).alias("calls_per_resume"), F.lit(tokens).alias("tokens_per_resume"),
        F.round(F.lit(unit), 4).alias("cost_per_resume_usd"),
        (n * calls).alias("total_calls"), (n * tokens).alias("total_tokens"),
        F.round(n * F.lit(unit), 2).alias("total_cost_usd"))
