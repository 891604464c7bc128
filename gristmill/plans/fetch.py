"""Fetch plans: landed payloads of all boards to one capped posting table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.dedup import dedup_by_url
from gristmill.operators.limits import counts_per_source, first_rows, union_sources
from gristmill.operators.roles import terms_of
from gristmill.sources import boards as B


def _first(postings: DataFrame, cap: int | None) -> DataFrame:
    return postings if cap is None else first_rows(postings, cap, "source_rank", "ord")


def remote_postings(payloads: DataFrame, rss_items: DataFrame, role: str | None = None, worldwide_only: bool = True,
                    max_pages: int | None = None) -> DataFrame:
    """The five remote boards in their fixed order, first row per url. `payloads` holds all
    JSON boards, told apart by `source`."""
    terms = terms_of(payloads.sparkSession, role)
    query = bool(role and role.strip())

    ranks = {"himalayas": 0, "remotive": 2, "remoteok": 3, "jobicy": 4}
    listed = B.remote(payloads, ranks, terms, worldwide_only, bool(query or worldwide_only or terms), max_pages)
    return dedup_by_url(union_sources(listed, B.weworkremotely(rss_items, terms, source_rank=1)))


def fetch_remote(payloads: DataFrame, rss_items: DataFrame, role: str | None = None, worldwide_only: bool = True,
                 max_pages: int | None = None, max_jobs: int | None = None) -> DataFrame:
    """The remote postings, with `max_jobs` the first of them."""
    return _first(remote_postings(payloads, rss_items, role, worldwide_only, max_pages), max_jobs)


def board_postings(payloads: DataFrame, details: DataFrame, roster: DataFrame, detected: DataFrame,
                   role: str | None = None) -> DataFrame:
    """The boards of the roster companies, each read from the board detected for it, in roster order (`source_rank`),
    then payload order, and without deduplication. `roster` has slug, ord; `detected` has slug, ats."""
    terms = terms_of(payloads.sparkSession, role)
    listed = roster.join(detected, "slug").select("slug", "ats", F.col("ord").alias("roster_ord"))
    # Detail and payload rows of other boards than the detected one do not count.
    used = payloads.join(listed, (payloads["slug"] == listed["slug"]) & (payloads["source"] == listed["ats"])).select(
        payloads["*"], "roster_ord")
    rank = F.col("roster_ord")

    def of(source: str) -> DataFrame:
        return used.filter(F.col("source") == source)

    return union_sources(B.greenhouse(of("greenhouse"), details, terms, rank), B.lever(of("lever"), terms, rank),
                         B.ashby(of("ashby"), terms, rank))


def fetch_boards(payloads: DataFrame, details: DataFrame, roster: DataFrame, detected: DataFrame,
                 role: str | None = None, max_jobs: int | None = None) -> DataFrame:
    """The board postings, with `max_jobs` the first of them."""
    return _first(board_postings(payloads, details, roster, detected, role), max_jobs)


def fetch(payloads: DataFrame, rss_items: DataFrame, details: DataFrame, roster: DataFrame, detected: DataFrame,
          role: str | None = None, remote_only: bool = False, max_jobs: int | None = None) -> DataFrame:
    """Company boards, or with `remote_only` the remote boards without the worldwide restriction."""
    if remote_only:
        return fetch_remote(payloads, rss_items, role, worldwide_only=False, max_jobs=max_jobs)
    return fetch_boards(payloads, details, roster, detected, role, max_jobs)


def fetch_report(postings: DataFrame) -> DataFrame:
    """E27."""
    return counts_per_source(postings)
