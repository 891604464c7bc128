"""Keywords and term frequencies.

All keyword work is keyed by document. Whole texts are shuffled once by document id; the exploded
words, which are several times larger, are then counted, ranked and gathered in place, because the
grouping keys all start with the id that already partitions the data.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill import fixed_values as fv
from gristmill.functions.text import keyword_words, token_rows
from gristmill.session import pieces


def by_document(docs: DataFrame, doc_id: str, *columns: str, placed: bool = False) -> DataFrame:
    """The columns needed, hash-placed by document id in pieces small enough to be worked on in memory. `placed` says the
    input is placed already."""
    slim = docs.select(doc_id, *columns)
    return slim if placed else slim.repartition(pieces(docs), doc_id)


def gram_counts(docs: DataFrame, doc_id: str, text: str, stopwords: Sequence[str] = fv.KEYWORD_STOPWORDS,
                placed: bool = False) -> DataFrame:
    """Count and first position of each word that is no stop word and longer than two
    characters, and of each adjacent pair without stop words.

    Only the first position of a text may keep a NULL gram, which keeps a document without any keyword
    in the table. A pair holds a space and a word none, so the gram alone tells them apart.
    """
    words = by_document(docs, doc_id, text, placed=placed).select(doc_id, keyword_words(F.col(text)).alias("words"))
    pairs = F.arrays_zip(F.col("words").alias("word"),
                         F.slice("words", F.lit(2), F.size("words")).alias("next"))
    placed_words = words.select(doc_id, F.posexplode_outer(pairs).alias("pos", "pair")).select(
        doc_id, "pos", F.col("pair.word").alias("word"), F.col("pair.next").alias("next")).withColumn(
        "plain", ~F.col("word").isin(*stopwords))
    word, following = F.col("word"), F.col("next")
    grams = placed_words.select(doc_id, "pos", F.explode(F.array(
        F.when(F.col("plain") & (F.length(word) > 2), word),
        F.when(F.col("plain") & ~following.isin(*stopwords), F.concat(word, F.lit(" "), following)),
    )).alias("gram")).filter(F.col("gram").isNotNull() | (F.coalesce("pos", F.lit(0)) == 0))
    return grams.groupBy(doc_id, "gram").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def ranked_grams(counts: DataFrame, doc_id: str, top_n: int = fv.KEYWORDS_PER_TEXT) -> DataFrame:
    """The top_n words (kind 0) and top_n // 2 pairs (kind 1) per document; ties go to the first
    occurrence. A NULL gram sorts last among the words."""
    kind = F.coalesce(F.contains("gram", F.lit(" ")), F.lit(False)).cast("int")
    order = Window.partitionBy(doc_id, "kind").orderBy(F.col("gram").isNull(), F.desc("n"), "first_pos")
    ranked = counts.withColumn("kind", kind).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top_n)
    return ranked.filter((F.col("kind") == 0) | (F.col("place") <= top_n // 2))


def keyword_lists(docs: DataFrame, doc_id: str, text: str, top_n: int = fv.KEYWORDS_PER_TEXT,
                  stopwords: Sequence[str] = fv.KEYWORD_STOPWORDS, placed: bool = False) -> DataFrame:
    """One ordered keyword array per document (at most 1.5 * top_n entries), words then pairs.
    Columns: doc_id, entries (keyword, n), keywords."""
    ranked = ranked_grams(gram_counts(docs, doc_id, text, stopwords, placed), doc_id, top_n)
    entry = F.when(F.col("gram").isNotNull(), F.struct("kind", "place", F.col("gram").alias("keyword"), "n"))
    return ranked.groupBy(doc_id).agg(F.array_sort(F.collect_list(entry)).alias("entries")).select(
        doc_id, F.transform("entries", lambda e: F.struct(e["keyword"].alias("keyword"), e["n"].alias("n")))
        .alias("entries"), F.col("entries.keyword").alias("keywords"))


def top_keywords(docs: DataFrame, doc_id: str, text: str, top_n: int = fv.KEYWORDS_PER_TEXT,
                 placed: bool = False) -> DataFrame:
    """W3, U6 in long form: doc_id, rank from 1, keyword, n."""
    kept = ranked_grams(gram_counts(docs, doc_id, text, placed=placed), doc_id, top_n).filter(F.col("gram").isNotNull())
    order = Window.partitionBy(doc_id).orderBy("kind", "place")
    return kept.select(doc_id, F.row_number().over(order).alias("rank"), F.col("gram").alias("keyword"), "n")


def term_frequencies(docs: DataFrame, doc_id: str, text: str, placed: bool = False) -> DataFrame:
    """Raw counts (doc_id, token, tf). Documents without tokens have no rows."""
    placed_docs = by_document(docs, doc_id, text, placed=placed)
    return token_rows(placed_docs, text, doc_id).groupBy(doc_id, "token").agg(F.count(F.lit(1)).alias("tf"))


def top_terms(docs: DataFrame, group: str, text: str, k: int) -> DataFrame:
    """E13, L4 per group: the k most frequent tokens, ties by token. Counting combines before the
    shuffle on (group, token), and each task keeps only its best k before groups are gathered."""
    counts = token_rows(docs, text, group).groupBy(group, "token").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(group).orderBy(F.desc("n"), "token")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
