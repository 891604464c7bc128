"""Lines that many documents share (operator 3).

Each document's normalised lines are exploded as 128-bit hashes, once per document with the line's positions; the
documents of a hash are counted with partial sums before the shuffle; hashes over the threshold are joined back to
the rows that hold them, and each document is put together again from the positions that stay. Texts move once, to
meet their positions.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.rows import id_back, keyed, map_rows

#: A key has at least so many code points, and stands in at least so many documents.
LEAST_LENGTH, LEAST_DOCUMENTS = 20, 3
#: So many of the most frequent shared keys are spread over so many tasks where they meet their rows. A key beyond them
#: has less than one part in MOST_FREQUENT of all rows.
MOST_FREQUENT, PARTS = 1000, 256
BLANKS = b" \t\n\x0b\x0c\r"


def line_keys(text: str, least: int) -> dict[bytes, list[int]]:
    """Positions of each key of ``least`` code points or more, by the key's hash. A key is the line without ASCII
    blanks at both ends, in lower case as to A-Z."""
    found: dict[bytes, list[int]] = defaultdict(list)
    digest = xxhash.xxh3_128_digest
    for position, line in enumerate(text.encode().split(b"\n")):
        key = line.strip(BLANKS)
        if len(key) >= least and (key.isascii() or len(key.decode()) >= least):
            found[digest(key.lower())].append(position)
    return found


def drop_shared_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_length: int = LEAST_LENGTH,
                      least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(_id, _tie, text, n_lines, n_dropped) of every row: lines whose key stands in ``least_documents`` documents or
    more are gone, except from the document with the largest id that holds it.

    A null text is an empty one: one empty line. A null id is smaller than any other. Rows that share an id are one
    document to the count and to the exception, and each keeps its own lines; equal rows have equal results.
    """
    source = keyed(docs, id_column, text_column)

    def keys(rows: Iterator[tuple]) -> Iterator[tuple]:
        for i, t, text in rows:
            for key, positions in line_keys(text, least_length).items():
                yield key, i, t, positions

    held = map_rows(source, "key binary, _id long, _tie long, positions array<int>", keys)
    # Documents of a key, without gathering them: equal rows of one document are rare, so rows are counted first, and
    # only where ids repeat are they told apart.
    shared = (held.groupBy("key").agg(F.count("*").alias("n"), F.min("_id").alias("smallest"), F.max("_id").alias("largest"))
              .filter((F.col("n") >= least_documents) & ((F.col("smallest") != F.col("largest")) | F.lit(least_documents <= 1))))
    repeated = source.groupBy("_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("_id")
    # A row beyond the first of its id takes one off the count of each of its keys.
    extra = (held.join(repeated, "_id", "left_semi").groupBy("key", "_id").agg((F.count("*") - 1).alias("more"))
             .groupBy("key").agg(F.sum("more").alias("more")))
    shared = (shared.join(extra, "key", "left").filter(F.col("n") - F.coalesce("more", F.lit(0)) >= least_documents)
              .select("key", "largest", "n"))
    # The table of frequent keys has at most MOST_FREQUENT rows, so it may be broadcast at any size of the input.
    frequent = F.broadcast(shared.orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).select("key", F.lit(True).alias("often")))
    spread = (held.join(frequent, "key", "left")
              .withColumn("part", F.when(F.col("often"), F.pmod(F.xxhash64("_id"), F.lit(PARTS))).otherwise(F.lit(0).cast("long"))))
    copies = F.when(F.col("often"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0))).cast("array<bigint>")
    met = shared.join(frequent, "key", "left").select("key", "largest", F.explode(copies).alias("part"))
    gone = (spread.join(met, ["key", "part"]).filter(F.col("_id") != F.col("largest"))
            .groupBy("_id", "_tie").agg(F.flatten(F.collect_list("positions")).alias("gone")))

    def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
        for i, t, text, gone in rows:
            lines = text.split("\n")
            out = set(gone or ())
            yield i, t, "\n".join([x for k, x in enumerate(lines) if k not in out]) if out else text, len(lines), len(out)

    return map_rows(source.join(gone, ["_id", "_tie"], "left").select("_id", "_tie", "_text", "gone"),
                    "_id long, _tie long, text string, n_lines long, n_dropped long", cut)


def without_shared_lines(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of every row."""
    return drop_shared_lines(docs, **settings).select(id_back().alias("doc_id"), "text", "n_lines", "n_dropped")
