"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and twice timed; the shorter time counts. Results go to the noop sink,
so every row and column is computed and nothing is collected. Throughput for the published figures is
given as texts and characters per second.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gristmill import queries as registry  # noqa: E402
from gristmill.session import build_session  # noqa: E402

HEADLINE = [
    "top_keywords", "tokenize_counts", "top_terms_by_source", "skill_recall", "pairwise_cosine_mean_linear",
    "pairwise_cosine_stats", "html_to_text", "generic_extract", "dedup_by_url", "dedup_by_text", "dedup_by_posting",
    "anti_join_applied", "upsert_log", "quantity_stats", "score_stats", "min_years", "remote_union", "select_experiences",
]
#: Dear plans, timed once after a warm-up and kept out of the total, so that it compares with earlier rounds.
ALSO = ["cosine_moments_by_texts", "similarity_histogram", "statistics_report", "best_description", "ashby_by_containment", "detail_lookup"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = build_session(f"local[{cpus}]", app="bench", shuffle_partitions=cpus * 2, spark__driver__memory="12g",
                          spark__driver__extraJavaOptions="-XX:+UseParallelGC", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs[1:]), 3)
    also = {}
    for name in ALSO:
        for _ in range(2):
            start = time.perf_counter()
            registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            also[name] = round(time.perf_counter() - start, 3)
    docs = registry.table(spark, folder, "documents")
    n_docs, n_chars = docs.selectExpr("count(*)", "sum(length(text))").first()
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "also": also,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus,
        "keyword_texts_per_sec": round(n_docs / seconds["top_keywords"], 1),
        "keyword_chars_per_sec": round(n_chars / seconds["top_keywords"]),
        "similarity_pairs_per_sec": round(n_docs * (n_docs - 1) / 2 / seconds["pairwise_cosine_stats"]),
    }))


if __name__ == "__main__":
    main()
