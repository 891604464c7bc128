"""Row filters as boolean columns. They are never NULL."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill import fixed_values as fv
from gristmill.functions.text import contains_any


def senior_board_title(title: Column) -> Column:
    """substring test, so 'leading' counts as 'lead'."""
    return contains_any(F.lower(F.coalesce(title, F.lit(""))), fv.BOARD_SENIOR_WORDS)


def senior_remote_title(title: Column) -> Column:
    """as F1 with two more phrases, for remote boards."""
    return contains_any(F.lower(F.coalesce(title, F.lit(""))), fv.REMOTE_SENIOR_WORDS)


def matches_role(title: Column, terms: Sequence[str]) -> Column:
    """no terms match everything; else any term is a substring of the lower-case title."""
    if not terms:
        return F.lit(True)
    return contains_any(F.lower(F.coalesce(title, F.lit(""))), terms)


def matches_role_terms(title: Column, terms: Column) -> Column:
    """F3 when the terms are an array column that differs by row."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return (F.coalesce(F.size(terms), F.lit(0)) <= 0) | F.coalesce(
        F.exists(terms, lambda t: F.contains(low, t)), F.lit(False))


def worldwide(location: Column) -> Column:
    """an empty location is open to the whole world."""
    low = F.lower(F.coalesce(location, F.lit("")))
    return (low == "") | contains_any(low, fv.WORLDWIDE_WORDS)


def needs_description(description: Column) -> Column:
    """missing or shorter than the minimum."""
    return F.length(F.coalesce(description, F.lit(""))) < fv.MIN_DESCRIPTION


def passes_score(score: Column, minimum: int = fv.MIN_SCORE) -> Column:
    """F9."""
    return F.coalesce(score >= minimum, F.lit(False))
