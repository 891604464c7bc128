"""File readers with explicit schemas."""

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill import fixed_values as fv
from gristmill import schemas


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _records(spark: SparkSession, path: str, lines: bool, strict: bool = False) -> DataFrame:
    """Records (ord, record VARIANT) in file order. A JSON array cannot be split, so one task reads it;
    large files should have one record per line, which any number of tasks can read."""
    if lines:
        parse = F.parse_json if strict else F.try_parse_json
        text = spark.read.text(path)
        return text.select(F.monotonically_increasing_id().alias("ord"), parse("value").alias("record")).filter("record IS NOT NULL")
    whole = F.from_json("value", "array<variant>", {"mode": "FAILFAST"} if strict else {})
    return spark.read.text(path, wholetext=True).select(F.posexplode(whole).alias("ord", "record")).filter("record IS NOT NULL")


def read_log(spark: SparkSession, path: str, strict: bool = False, lines: bool = False) -> DataFrame:
    """An application log, a JSON array of records or, with `lines`, one record per line. A
    missing or unreadable file is an empty log, or an error when strict. Columns: the log fields,
    `present` (keys the record has) and `ord`."""
    fields = schemas.APP_LOG.fields
    columns = T.StructType([*fields, T.StructField("present", T.ArrayType(T.StringType())), T.StructField("ord", T.LongType())])
    if not path_exists(spark, path):
        if strict:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], columns)
    record = F.col("record")
    return _records(spark, path, lines, strict).select(
        *[F.try_variant_get(record, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in fields],
        F.json_object_keys(F.to_json(record)).alias("present"), F.col("ord").cast("long"))


def rejected_records(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """S1, quarantine: what `read_log` leaves out, with its file and place (`ord`, as the log's rows have it): lines that are no JSON
    object, or with `lines` off whole files that are no JSON array and entries of arrays that are no object. Blank lines are
    no records. A missing path has none."""
    schema = "file STRING, ord BIGINT, value STRING"
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    text = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"), "value")
    is_object = F.json_object_keys("value").isNotNull()
    if lines:
        return text.filter((F.trim(F.regexp_replace("value", r"\s+", " ")) != "") & ~is_object)
    entries = text.withColumn("entries", F.from_json("value", "array<variant>"))
    broken = text.join(entries.filter("entries IS NOT NULL").select("file"), "file", "left_anti").withColumn("ord", F.lit(None).cast("long"))
    inner = entries.select("file", F.posexplode("entries").alias("ord", "record")).select("file", F.col("ord").cast("long"), F.to_json("record").alias("value"))
    return broken.unionByName(inner.filter(F.json_object_keys("value").isNull()))


def read_candidates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid candidates with defaults filled in, rejected rows). One JSON object per line."""
    raw = spark.read.schema(schemas.CANDIDATE).json(path)
    return checked_candidates(raw)


def checked_candidates(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Defaults for optional fields; rows that lack a required one are returned apart."""
    p = F.col("personal")
    missing = (
        p.isNull() | p["name"].isNull() | p["email"].isNull() | p["phone"].isNull() | p["location"].isNull()
        | F.col("summary").isNull()
    )
    no_text = F.lit(False)

    def bad_bullets(item):
        return item["bullets"].isNull() | F.exists(item["bullets"], lambda b: b["text"].isNull())

    for name, required in (
        ("work_experience", lambda e: e["company"].isNull() | e["role"].isNull() | e["period"].isNull() | bad_bullets(e)),
        ("projects", lambda x: x["name"].isNull() | bad_bullets(x)),
        ("education", lambda d: d["degree"].isNull() | d["school"].isNull()),
        ("skills", lambda c: c["category"].isNull() | c["skills"].isNull()),
    ):
        no_text = no_text | F.col(name).isNull() | F.coalesce(F.exists(name, required), F.lit(False))
    flagged = raw.withColumn("_bad", missing | no_text)
    empty = F.array().cast("array<string>")

    def text(value):
        return F.coalesce(value, F.lit(""))

    def tags(value):
        return F.coalesce(value, empty)

    def bullets(item):
        return F.transform(item["bullets"], lambda b: F.struct(b["text"].alias("text"), tags(b["tags"]).alias("tags")))

    def priority(item):
        return F.coalesce(item["priority"], F.lit("medium"))

    filled = flagged.filter(~F.col("_bad")).select(
        "candidate_id",
        F.struct(p["name"].alias("name"), p["email"].alias("email"), p["phone"].alias("phone"),
                 p["location"].alias("location"), text(p["github"]).alias("github"),
                 text(p["linkedin"]).alias("linkedin"), text(p["website"]).alias("website")).alias("personal"),
        "summary",
        F.transform("work_experience", lambda e: F.struct(
            e["company"].alias("company"), e["role"].alias("role"), e["period"].alias("period"),
            bullets(e).alias("bullets"), tags(e["tags"]).alias("tags"), priority(e).alias("priority"))).alias("work_experience"),
        F.transform("projects", lambda x: F.struct(
            x["name"].alias("name"), bullets(x).alias("bullets"), tags(x["tags"]).alias("tags"),
            text(x["link"]).alias("link"), priority(x).alias("priority"))).alias("projects"),
        F.transform("education", lambda d: F.struct(
            d["degree"].alias("degree"), d["school"].alias("school"), d["gpa"].alias("gpa"),
            d["period"].alias("period"), tags(d["coursework"]).alias("coursework"))).alias("education"),
        "skills")
    return filled, flagged.filter("_bad").drop("_bad")


def read_labelled_corpus(spark: SparkSession, path: str, n_max: int | None = None, lines: bool = False) -> DataFrame:
    """Labelled texts in file order, the first n_max; an error when there are none."""
    record = F.col("record")
    rows = _records(spark, path, lines).select(
        *[F.try_variant_get(record, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in schemas.LABELLED_TEXT.fields],
        F.col("ord").cast("long")).filter("synthetic")
    if n_max is not None:
        rows = rows.orderBy("ord").limit(n_max)
    if rows.isEmpty():
        raise ValueError(f"no labelled rows in {path}")
    return rows


def read_synonyms(spark: SparkSession, path: str) -> Mapping[str, Sequence[str]]:
    """A small synonym file (JSON, or YAML where its reader is installed); missing means none."""
    if not path_exists(spark, path):
        return {}
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).limit(1).collect())
    if path.endswith((".yml", ".yaml")):
        try:
            import yaml
        except ImportError as error:
            raise ImportError("YAML needs its reader; store the synonyms as JSON") from error
        return yaml.safe_load(text) or {}
    return json.loads(text) if text.strip() else {}


def bulk_manual_postings(entries: DataFrame) -> DataFrame:
    """S20, bulk form: no source, trimmed description cut to 1500 characters."""
    from gristmill.functions.text import strip_blank
    return entries.select(
        "title", "company", F.substring(strip_blank(F.coalesce("description", F.lit(""))), 1, fv.MANUAL_DESCRIPTION)
        .alias("description"), "url")


def manual_postings(entries: DataFrame, scraped: DataFrame) -> DataFrame:
    """S20, single form. An entry whose input is a link takes the scraped posting when its description
    has more than 100 characters; any other entry is the typed row with source 'manual'. Input:
    input, title, company, description, url, ord; of several scraped rows of a url the longest description counts."""
    from gristmill.functions.text import strip_blank

    posting = F.struct("title", "company", "url", "description", "location", "source")
    found = scraped.filter(F.length("description") > fv.MIN_DESCRIPTION).groupBy(F.col("url").alias("found_url")).agg(
        F.max_by(posting, F.struct(F.length("description"), posting)).alias("found"))
    link = strip_blank(F.coalesce("input", F.lit("")))
    typed = F.struct(
        *[strip_blank(F.coalesce(c, F.lit(""))).alias(c) for c in ("title", "company", "url", "description")],
        F.lit(None).cast("string").alias("location"), F.lit("manual").alias("source"))
    joined = entries.join(found, F.startswith(link, F.lit("http")) & (link == F.col("found_url")), "left")
    return joined.select(F.when(F.col("found").isNotNull(), F.col("found")).otherwise(F.struct(
        typed["title"].alias("title"), typed["company"].alias("company"), typed["url"].alias("url"),
        typed["description"].alias("description"), typed["location"].alias("location"), typed["source"].alias("source")))
        .alias("p"), "ord").select("p.*", "ord")
