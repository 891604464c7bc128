"""Building the normalised posting struct."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill import fixed_values as fv
from gristmill.functions import html as H
from gristmill.functions import variants as V
from gristmill.functions.text import clean_text, first_truthy, strip_blank


def posting(title: Column, company: Column, url: Column, description: Column, source: str, location: Column) -> Column:
    """Blanks become Unknown; the cleaned description keeps its first 5000 characters."""
    return F.struct(
        first_truthy(title, default="Unknown").alias("title"),
        first_truthy(company, default="Unknown").alias("company"),
        url.alias("url"),
        F.substring(clean_text(description), 1, fv.MAX_DESCRIPTION).alias("description"),
        first_truthy(location, default="Unknown").alias("location"),
        F.lit(source).alias("source"),
    )


def json_ld_items(html: Column) -> Column:
    """The JobPosting objects of a page, in document order, as an array of variants."""
    blocks = F.transform(H.json_ld_blocks(html), lambda raw: F.coalesce(
        F.try_parse_json(raw), F.try_parse_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0))))
    items = F.flatten(F.transform(
        F.filter(blocks, lambda b: b.isNotNull()),
        lambda b: F.when(V.is_array(b, "$"), V.get(b, "$", "array<variant>")).otherwise(F.array(b))))
    return F.filter(items, lambda v: V.is_object(v, "$") & F.coalesce(
        V.text_if_string(v, "$['@type']") == "JobPosting", F.lit(False)))


def json_ld_company(item: Column) -> Column:
    """Name of the organisation object, or the organisation itself when it is a string."""
    return F.when(V.is_object(item, "$.hiringOrganization"), V.get(item, "$.hiringOrganization.name")) \
        .otherwise(V.text_if_string(item, "$.hiringOrganization"))


def json_ld_location(item: Column) -> Column:
    """'locality region' of an address object, or the address string; '' for lists."""
    address = "$.jobLocation.address"
    joined = strip_blank(F.concat(
        F.coalesce(V.get(item, address + ".addressLocality"), F.lit("")), F.lit(" "),
        F.coalesce(V.get(item, address + ".addressRegion"), F.lit(""))))
    return F.when(~V.is_object(item, "$.jobLocation"), F.lit("")) \
        .when(V.is_object(item, address), joined).otherwise(V.text_if_string(item, address))
