"""Mixing sources to target weights (operator 1), by Pivotal dependent rounding with DataFrame functions only.

Each source has a target; a document's copies are the target's share of its source, a fraction that must become a
whole number. Two documents pair their fractions: a random transfer of words makes one of them whole and leaves the
sum and each one's expectation as they were. Buckets of about ``FAN`` documents do that side by side and leave one
fraction each; those are the documents of the next level, down to one per source. A source's words therefore miss
their target by less than one document. Levels are the logarithm of the largest source, and each shuffles a
``FAN``-th of what the one before did.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.rows import id_back, id_key, staged, tie_key

FAN = 32
# Words, weights by rank, share of all words, and the most copies.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
_UNIT = ["_id", "_tie", "_source", "_size"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def sized(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    return docs.select(id_key(id_column).alias("_id"), tie_key(text_column).alias("_tie"), F.col(source_column).cast("string").alias("_source"),
                       F.coalesce(F.regexp_count(text_column, F.lit(WORD)), F.lit(0)).cast("long").alias("_size"))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds ``rank``, from 0 on, in the given order. Ranks are counted inside ranges of the order; only the ranges'
    sizes meet in one task."""
    dealt = staged(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.join(starts, "_range").withColumn("rank", F.col("_start") + inside).drop("_range", "_start")


def targets(units: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(_source, source_size, target) of each source. Sources by code point, null last, have the weights in turn; words
    above ``most`` times a source's go to the others by weight until none is above. The driver holds three sums per
    round and no source."""
    sources = units.groupBy("_source").agg(F.sum(F.col("_size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    ranked = numbered(sources, F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    ranked = staged(ranked.select("_source", "source_size", "n", weight.alias("weight"), cap.alias("cap")))
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:
        above = F.col("cap") <= F.lit(level) * F.col("weight")
        n, taken, rest = ranked.agg(F.count(F.when(above, 1)), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        if n == full or not rest:
            break
        level, full = max(level, (total - (taken or 0.0)) / rest), n
    target = F.least("cap", F.lit(level) * F.col("weight")) if rest else F.col("cap")
    return ranked.select("_source", "source_size", "n", target.alias("target"))


def _uniform(*columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) * F.lit(2.0 ** -53)


_ITEM = "struct<draw:bigint,id:bigint,tie:bigint,size:bigint,part:double>"


def _part(item: Column, part: Column) -> Column:
    return F.struct(item["draw"].alias("draw"), item["id"].alias("id"), item["tie"].alias("tie"), item["size"].alias("size"), part.alias("part"))


def _pair(state: Column, x: Column) -> Column:
    """One transfer between the open document and the next. ``part`` 0 or 1 is whole."""
    c, done = state["open"], state["done"]
    whole = lambda item: (item["part"] == 0.0) | (item["part"] == 1.0)

    def step(amounts: Column) -> Column:
        rise, fall = amounts["rise"], amounts["fall"]
        up = _uniform(c["draw"], x["draw"], c["id"], x["id"]) * (rise + fall) < fall
        mine = F.when(up, F.when(rise == (1 - c["part"]) * c["size"], 1.0).otherwise(c["part"] + rise / c["size"])).otherwise(
            F.when(fall == c["part"] * c["size"], 0.0).otherwise(c["part"] - fall / c["size"]))
        other = F.when(up, F.when(rise == x["part"] * x["size"], 0.0).otherwise(x["part"] - rise / x["size"])).otherwise(
            F.when(fall == (1 - x["part"]) * x["size"], 1.0).otherwise(x["part"] + fall / x["size"]))
        return let(F.struct(_part(c, mine).alias("a"), _part(x, other).alias("b")), lambda p: F.when(
            whole(p["a"]), F.struct(p["b"].alias("open"), F.concat(done, F.array(p["a"])).alias("done"))
        ).otherwise(F.struct(p["a"].alias("open"), F.concat(done, F.array(p["b"])).alias("done"))))

    amounts = F.struct(F.least((1 - c["part"]) * c["size"], x["part"] * x["size"]).alias("rise"),
                       F.least(c["part"] * c["size"], (1 - x["part"]) * x["size"]).alias("fall"))
    return F.when(whole(c), F.struct(x.alias("open"), F.concat(done, F.array(c)).alias("done"))).otherwise(let(amounts, step))


def _fold(items: Column) -> Column:
    """Transfers from the first to the last of a bucket: struct(open, done)."""
    start = F.struct(items[0].alias("open"), F.expr(f"CAST(array() AS array<{_ITEM}>)").alias("done"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, _pair)


def rounded(units: DataFrame, fan: int = FAN) -> DataFrame:
    """(_id, _tie, _source, _size, up) for units with a fraction ``part`` between 0 and 1, sizes above 0 and ``n``, the
    number of the source's documents."""
    most = units.agg(F.max("n_source")).first()[0] or 0
    draw = F.xxhash64("_id", "_tie", "_size", "_source")
    left = units.select("_source", "n_source", F.struct(draw.alias("draw"), F.col("_id").alias("id"), F.col("_tie").alias("tie"),
                                                        F.col("_size").alias("size"), F.col("part")).alias("item"))
    settled, width, level = [], fan, 0
    while True:
        buckets = F.ceil(F.col("n_source") / F.lit(width))
        dealt = left.withColumn("bucket", F.pmod(F.xxhash64(F.col("item.draw"), F.lit(level)), buckets))
        folded = staged(dealt.groupBy("_source", "n_source", "bucket").agg(F.sort_array(F.collect_list("item")).alias("items"))
                        .select("_source", "n_source", _fold(F.col("items")).alias("state")))
        settled.append(folded.select("_source", F.explode("state.done").alias("item")))
        left = folded.select("_source", "n_source", F.col("state.open").alias("item"))
        if width >= most:
            break
        width, level = width * fan, level + 1
    # One open document per source: it is drawn alone.
    last = left.select("_source", F.col("item").withField("part", (_uniform(F.col("item.draw"), F.lit("last")) < F.col("item.part")).cast("double")).alias("item"))
    every = last
    for rows in settled:
        every = every.unionByName(rows)
    return every.select(F.col("item.id").alias("_id"), F.col("item.tie").alias("_tie"), "_source", F.col("item.size").alias("_size"),
                        (F.col("item.part") == 1.0).alias("up"))


def mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
          weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(_id, _tie, _source, _size, n, source_size, target, copies, n_more) of each different document: of its ``n`` equal
    rows, ``n_more`` come ``copies`` + 1 times and the others ``copies`` times.

    A null text has no words, and an empty document is drawn alone, as it moves no words. Null sources are one source,
    the last. A null id is an id like any other. The draw is a function of ids, texts and sources, so reruns agree.
    """
    units = staged(sized(docs, id_column, text_column, source_column).groupBy(*_UNIT).agg(F.count("*").alias("n")))
    by_source = targets(units, weights, share, most).select(F.col("_source").alias("_of"), "source_size", "target", F.col("n").alias("n_source"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shares = units.join(by_source, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of").withColumn("copies", F.floor(rate))
    total = F.col("n") * (rate - F.col("copies"))
    shares = staged(shares.withColumn("n_more", F.floor(total)).withColumn("part", total - F.floor(total)))
    ups = rounded(shares.filter("part > 0 AND _size > 0")).select(*(F.col(c).alias(f"_of{c}") for c in _UNIT), "up")
    same = [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in _UNIT]
    alone = _uniform(F.xxhash64("_id", "_tie", "_source"), F.lit("empty")) < F.col("part")
    return (shares.join(ups, same, "left")
            .withColumn("n_more", F.col("n_more") + F.coalesce("up", (F.col("part") > 0) & alone).cast("long"))
            .select(*_UNIT, "n", "source_size", "target", F.col("copies").cast("long").alias("copies"), "n_more"))


def mix_report(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, size, source_size, target, copies) of every row of the documents."""
    row = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("row")
    return mixed(docs, **settings).select("*", row).select(
        id_back().alias("doc_id"), F.col("_size").alias("size"), "source_size", "target",
        (F.col("copies") + (F.col("row") <= F.col("n_more")).cast("long")).alias("copies"))


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **settings) -> DataFrame:
    """The documents, with all their columns, as often as the mix takes them."""
    drawn = mixed(docs, id_column, text_column, source_column, **settings).select(*(F.col(c).alias(f"_of{c}") for c in _UNIT), "copies", "n_more")
    row = F.struct(*docs.columns).alias("_row") if docs.columns else F.lit(None).alias("_row")
    keyed = docs.select(row, id_key(id_column).alias("_id"), tie_key(text_column).alias("_tie"), F.col(source_column).cast("string").alias("_source"))
    # Equal rows are told apart by number; the key is a document's, so no window is larger than its copies.
    number = F.row_number().over(Window.partitionBy("_id", "_tie", "_source").orderBy("_id"))
    joined = keyed.withColumn("_number", number).join(
        drawn, [F.col("_id") == F.col("_of_id"), F.col("_tie") == F.col("_of_tie"), F.col("_source").eqNullSafe(F.col("_of_source"))])
    times = F.col("copies") + (F.col("_number") <= F.col("n_more")).cast("long")
    return (joined.withColumn("_times", times).filter("_times > 0")
            .select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))).alias("_time")).select("_row.*"))
