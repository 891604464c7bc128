"""URL columns. Parts are cut by pattern, so a malformed url gives parts instead of NULL."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill import fixed_values as fv
from gristmill.functions.text import first_truthy, strip_blank

_URL = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def host(url: Column) -> Column:
    """Lower-case network location."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def path(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)
    return F.regexp_replace(raw, ";[^/]*$", "")


def path_parts(url: Column) -> Column:
    """Non-empty path parts."""
    return F.filter(F.split(path(url), "/"), lambda p: p != "")


def part(url: Column, index: int) -> Column:
    """The index-th path part from 1, NULL when there are fewer."""
    return F.try_element_at(path_parts(url), F.lit(index))


def detect_board(url: Column) -> Column:
    """P5: board by host, first match in the fixed order, else NULL."""
    where = host(url)
    board = F.when(F.lit(False), F.lit(None).cast("string"))
    for fragment, name in fv.BOARD_HOSTS:
        board = board.when(F.contains(where, F.lit(fragment)), F.lit(name))
    return board


def job_id(url: Column) -> Column:
    """Query parameter jobId, else the digits after /job/ or /job- in the path, else NULL."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 3)
    by_query = F.try_url_decode(F.regexp_extract(query, "(?:^|&)jobId=([^&]+)", 1))
    by_path = F.regexp_extract(path(url), r"/job[/-](\d+)", 1)
    return first_truthy(by_query, by_path)


def board_key(url: Column) -> Column:
    """Lookup key (board, slug, job_id) of a posting url, NULL fields where the url has none."""
    board = detect_board(url)
    first, second, third = part(url, 1), part(url, 2), part(url, 3)
    number = F.regexp_extract(second, r"\d+", 0)
    key = (
        F.when((board == "greenhouse") & third.rlike(r"^\d+$"), third)
        .when(board.isin("lever", "ashby"), second)
        .when(board == "smartrecruiters", F.nullif(number, F.lit("")))
    )
    return F.struct(board.alias("board"), first.alias("slug"), key.alias("job_id"))


def listing_url(link: Column, prefix: str, slug: Column, middle: str, ident: Column) -> Column:
    """P10: the given link, else a url built from slug and id."""
    built = F.concat(F.lit(prefix), slug, F.lit(middle), F.coalesce(ident, F.lit("None")))
    return first_truthy(link, built)


def remoteok_url(link: Column, slug: Column) -> Column:
    """Rooted links get the site prefix; no link falls back to the slug."""
    return (
        F.when(F.startswith(link, F.lit("/")), F.concat(F.lit("https://remoteok.com"), link))
        .when((F.coalesce(link, F.lit("")) == "") & (F.coalesce(slug, F.lit("")) != ""),
              F.concat(F.lit("https://remoteok.com/remote-jobs/"), slug))
        .otherwise(F.coalesce(link, F.lit("")))
    )


def embedded_board_url(html: Column) -> Column:
    """Canonical url of a board link inside a page; pattern order decides, not position. Each pattern
    scans the page once; its groups are then read from the short match."""
    def canonical(pattern: str, template: str):
        return lambda m: F.when(m != "", F.format_string(
            template, F.regexp_extract(m, pattern, 1), F.regexp_extract(m, pattern, 2)))

    found = []
    for fixed, template in fv.EMBEDDED_BOARD_PATTERNS:
        pattern = "(?i)" + fixed
        match = F.regexp_extract(html, pattern, 0)
        found.append(F.transform(F.array(match), canonical(pattern, template))[0])
    return F.coalesce(*found)


def url_key(url: Column) -> Column:
    """What equal urls have in common: the url without blanks around it; '' for none."""
    return strip_blank(F.coalesce(url, F.lit("")))


def two_part_order(ord: Column, pos: Column) -> Column:
    """Order of a payload, then of an entry in it, as one decimal number that no payload number overflows."""
    return ord.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + pos.cast("decimal(10,0)")
