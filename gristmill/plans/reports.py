"""Report plans: nested one-row results and their JSON files."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill import fixed_values as fv
from gristmill.functions.text import truthy
from gristmill.operators import recall as R
from gristmill.operators import similarity as S
from gristmill.operators import stats as ST
from gristmill.operators.dedup import dedup_by_posting
from gristmill.operators.keywords import by_document, keyword_lists
from gristmill.operators.limits import one_row


def _one(df: DataFrame, name: str) -> DataFrame:
    """A one-row table as one struct."""
    return df.select(F.struct("*").alias(name))


def _gathered(df: DataFrame, name: str) -> DataFrame:
    """A small table as one array of structs, sorted by its columns; those named with `_` are left out."""
    shown = [c for c in df.columns if not c.startswith("_")]
    rows = F.array_sort(F.collect_list(F.struct(*df.columns)))
    return df.agg(F.transform(rows, lambda x: F.struct(*[x[c].alias(c) for c in shown])).alias(name))


def _unique_postings(log: DataFrame) -> DataFrame:
    """W2. A log read from a file knows which keys its records have."""
    if "present" not in log.columns:
        return dedup_by_posting(log)
    flagged = log.withColumns({f"_no_{c}": ~F.array_contains("present", c) for c in ("title", "company")})
    return dedup_by_posting(flagged, missing={"title": "_no_title", "company": "_no_company"})


def statistics_report(log: DataFrame) -> DataFrame:
    """K2: one row with the sections dataset, scores, score_vs_status, personalization, cost_model. The
    gathered tables have one row per status, score or top company."""
    rounded = ST.score_statistics(log, "score").select(
        "n", F.round("mean", 2).alias("mean"), "median", F.round("stdev", 2).alias("stdev"), "min", "max", "p95")
    unique = _unique_postings(log)
    sections = [
        _one(ST.dataset_summary(log), "dataset"),
        _gathered(ST.status_counts(log), "statuses"),
        _gathered(ST.top_companies(log).select((-F.col("n")).alias("_order"), F.col("first_ord").alias("_ord"), "company", "n"), "top_companies"),
        _one(rounded, "scores"),
        _gathered(ST.distribution(log, "score"), "distribution"),
        _gathered(ST.score_by_status(log).select("group", "n", F.round("mean", 2).alias("mean"), "median"), "score_vs_status"),
        _one(unique.agg(F.count(F.lit(1)).alias("n_unique_postings")), "unique"),
        _one(ST.cost_model(log), "cost_model"),
    ]
    for name in ("cover_letter", "fit_reason"):
        texts = unique.filter(truthy(F.col(name)))
        sections.append(_one(ST.mean_length(texts, name), f"{name}_length"))
        sections.append(_one(S.pairwise_cosine_stats(texts, name).select(
            *[F.round(c, 3).alias(c) for c in ("cosine_mean", "cosine_stdev", "cosine_min", "cosine_max")]), f"{name}_similarity"))
    return one_row(*sections)


def recall_report(docs: DataFrame, skills: DataFrame, doc_id: str = "id", text: str = "description",
                  top_n: int = fv.KEYWORDS_PER_TEXT) -> DataFrame:
    """K3: one row with corpus size, family counts, keyword statistics and recall, overall and by family, rounded as the report shows them."""
    placed = by_document(docs, doc_id, "role_family", text)
    rows = R.recall_rows(placed, keyword_lists(placed, doc_id, text, top_n, placed=True), skills, doc_id)
    places = {"keywords_mean": 2, "bigram_share_mean": 3, "recall_mean": 3, "recall_min": 3, "recall_max": 3}

    def rounded(df: DataFrame) -> DataFrame:
        return df.select(*[F.round(c, places[c]).alias(c) if c in places else c for c in df.columns])

    return one_row(_one(rounded(R.recall_summary(rows)), "summary"), _gathered(rounded(R.recall_by_family(rows)), "by_family"))


def write_json(report: DataFrame, path: str) -> None:
    """K2, K3 sink: the one report row as JSON in a new folder."""
    report.coalesce(1).write.mode("error").json(path)
