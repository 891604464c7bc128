"""Language identification by segmentation-marginalised unigrams (operator 5).

The pieces are those of a fixed public vocabulary that consist of letters, with or without the blank that starts a
word. Each language has a probability for each piece. The probability of a word is the sum over all its segmentations
into pieces, by a forward algorithm; a text's is the product over its words. Piece probabilities are learned by
expectation maximisation: forward and backward sums give the expected uses of each piece.

A worker scores each different word of a batch of texts once, all words of one length side by side.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.rows import hashed_sample, id_back, id_key, keyed, map_rows, staged

DEFAULT_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Longer runs of letters are scored in parts of that length.
LONGEST = 48
#: Documents to learn from, for each language, and rounds of expectation maximisation.
SAMPLE, ROUNDS = 400, 3
#: Probability of a letter that is no piece, the count added to each piece, and a factor per letter against underflow.
UNSEEN, ADDED, SCALE = 1e-7, 0.05, 32.0
UNKNOWN = "und"
TOGETHER = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Pieces:
    hashes: np.ndarray  # ascending
    count: int
    longest: int        # characters of the longest piece, its blank included

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each piece; ``count`` if it is none."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == self.count] = 0
        return np.where(self.hashes[at] == hashes, at, self.count)


def _longer(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of strings that are one code point longer."""
    out = (hashes + codes + np.uint64(1)) * _BASE
    return out ^ (out >> np.uint64(29))


def _hash(codes: np.ndarray) -> np.ndarray:
    """Hash of each row of code points."""
    out = np.zeros(codes.shape[0], np.uint64)
    for k in range(codes.shape[1]):
        out = _longer(out, codes[:, k])
    return out


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row for each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    found = set()
    with open(path, "rb") as file:
        for line in file:
            try:
                piece = base64.b64decode(line.split()[0]).decode().lower()
            except UnicodeDecodeError:
                continue
            letters = piece[1:] if piece[:1] == " " else piece
            if letters.isalpha():
                found.add(piece)
    by_length: dict[int, list[str]] = {}
    for piece in sorted(found):
        by_length.setdefault(len(piece), []).append(piece)
    hashes = np.unique(np.concatenate([_hash(_codes(p)) for p in by_length.values()]))
    return Pieces(hashes, len(hashes), max(by_length))


def _parts(words: list[str], vocabulary: Pieces) -> dict[tuple[int, int], np.ndarray]:
    """Piece numbers of the substrings [j - k, j) of equally long words, as long as the longest piece at most. A single
    letter that is no piece has the number ``count + 1``; longer substrings that are a piece in no word are left out."""
    codes = _codes(words)
    n = codes.shape[1]
    out = {}
    for start in range(n):
        hashes = np.zeros(len(words), np.uint64)
        for j in range(start + 1, min(n, start + vocabulary.longest) + 1):
            hashes = _longer(hashes, codes[:, j - 1])
            ids = vocabulary.find(hashes)
            if j == start + 1:
                out[j, 1] = np.where(ids == vocabulary.count, vocabulary.count + 1, ids)
            elif (ids != vocabulary.count).any():
                out[j, j - start] = ids
    return out


def _forward(parts: dict, n: int, size: int, table: np.ndarray) -> np.ndarray:
    """alpha[j]: sum over segmentations of the first j letters, times SCALE^j, by word and language."""
    alpha = np.zeros((n + 1, size, table.shape[1]))
    alpha[0] = 1
    for j in range(1, n + 1):
        for k in range(1, j + 1):
            if (j, k) in parts:
                alpha[j] += table[parts[j, k]] * alpha[j - k] * SCALE ** k
    return alpha


def by_length(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    for n, at in groups.items():
        for start in range(0, len(at), 8192):
            yield n, at[start:start + 8192]


def log_probabilities(words: list[str], table: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    """Of each word, by language. Words carry their leading blank and aren't longer than LONGEST + 1."""
    out = np.zeros((len(words), table.shape[1]))
    for n, at in by_length(words):
        parts = _parts([words[k] for k in at], vocabulary)
        out[at] = np.log(_forward(parts, n, len(at), table)[n]) - n * np.log(SCALE)
    return out


def expected_uses(words: list[str], counts: np.ndarray, table: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    """Expected uses of each piece in one language, whose probabilities are ``table`` (one column)."""
    uses = np.zeros(vocabulary.count + 2)
    for n, at in by_length(words):
        parts = _parts([words[k] for k in at], vocabulary)
        alpha = _forward(parts, n, len(at), table)[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[n] = 1
        for j in range(n, 0, -1):
            for k in range(1, j + 1):
                if (j, k) in parts:
                    beta[j - k] += table[parts[j, k], 0] * beta[j] * SCALE ** k
        weight = counts[at] / alpha[n]
        for (j, k), ids in parts.items():
            uses += np.bincount(ids, alpha[j - k] * table[ids, 0] * SCALE ** k * beta[j] * weight, len(uses))
    return uses


def word_lists(texts: pa.Array) -> pa.ListArray:
    """Runs of letters of each text in lower case; marks and all else part them."""
    plain = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), r"\PL+", " "))
    found = pc.split_pattern(plain, " ")
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def in_parts(word: str) -> list[str]:
    return [" " + word[:LONGEST]] + [word[k:k + LONGEST] for k in range(LONGEST, len(word), LONGEST)]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    path: str


def _start(vocabulary: Pieces) -> np.ndarray:
    table = np.full((vocabulary.count + 2, 1), 1.0 / max(1, vocabulary.count))
    table[-2], table[-1] = 0, UNSEEN
    return table


def train(docs: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang",
          path: str | None = None, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """Learns from ``sample`` documents of each language among those that ``learn`` admits (all if there are fewer),
    taken by the hash of their ids. Only rows that ``learn`` admits and that bear the language count, whatever other
    rows share their ids. Null languages aren't learned. The driver gets one number per piece and language, which the
    vocabulary bounds."""
    path = path or public_tokenizers.path(DEFAULT_VOCABULARY)
    admitted = docs.filter(learn & F.col(language_column).isNotNull())
    language = F.col(language_column).cast("string").alias("_lang")
    chosen = hashed_sample(admitted.select(id_key(id_column).alias("_id"), language).distinct(), "_lang", sample)
    texts = keyed(admitted, id_column, text_column, language).join(F.broadcast(chosen), ["_id", "_lang"]).select("_lang", "_text")

    def words(rows: Iterator[tuple]) -> Iterator[tuple]:
        for language, text in rows:
            for part, n in Counter(p for w in word_lists(pa.array([text]))[0].as_py() if w for p in in_parts(w)).items():
                yield language, part, n

    counted = staged(map_rows(texts, "lang string, word string, n long", words).groupBy("lang", "word").agg(F.sum("n").alias("n")))
    languages = [r[0] for r in chosen.select("_lang").distinct().orderBy("_lang").collect()]
    table = np.repeat(_start(pieces(path)), len(languages), axis=1)
    for _ in range(rounds if languages else 0):
        given = dict(zip(languages, table.T))

        def expect(batches: Iterator[tuple]) -> Iterator[tuple]:
            vocabulary, uses = pieces(path), {}
            held: dict[str, list[tuple[str, int]]] = {}
            for language, word, n in batches:
                held.setdefault(language, []).append((word, n))
                if len(held[language]) >= 20_000:
                    _add(uses, language, held.pop(language), given, vocabulary)
            for language, pairs in held.items():
                _add(uses, language, pairs, given, vocabulary)
            for language, sums in uses.items():
                for piece in np.flatnonzero(sums[:vocabulary.count]).tolist():
                    yield language, piece, float(sums[piece])

        sums = map_rows(counted, "lang string, piece int, uses double", expect).groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))
        table = np.full((pieces(path).count + 2, len(languages)), ADDED)
        for language, piece, uses in sums.collect():
            table[piece, languages.index(language)] += uses
        table[-2:] = 0
        table /= table.sum(axis=0)
        table[-1] = UNSEEN
    return Model(languages, table, path)


def _add(uses: dict, language: str, pairs: list[tuple[str, int]], given: dict, vocabulary: Pieces) -> None:
    words, counts = zip(*pairs)
    found = expected_uses(list(words), np.array(counts, float), given[language][:, None], vocabulary)
    uses[language] = uses.get(language, 0) + found


def score_texts(texts: pa.Array, model: Model) -> Iterator[tuple[str, float]]:
    """(language, probability among the learned ones) of each text; no letter: (und, 0)."""
    lists = word_lists(texts)
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    scores = np.zeros((len(words), len(model.languages)))
    if model.languages:
        short = [k for k, w in enumerate(words) if 0 < len(w) <= LONGEST]
        if short:
            scores[short] = log_probabilities([" " + words[k] for k in short], model.table, pieces(model.path))
        for k, w in enumerate(words):
            if len(w) > LONGEST:
                scores[k] = log_probabilities(in_parts(w), model.table, pieces(model.path)).sum(axis=0)
    which = coded.indices.to_numpy()
    empty = np.array([not w for w in words], bool)
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        own = which[start:end]
        if not model.languages or not len(own) or empty[own].all():
            yield UNKNOWN, 0.0
            continue
        total = scores[own].sum(axis=0)
        best = int(total.argmax())
        yield model.languages[best], float(1 / np.exp(total - total[best]).sum())


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(_id, _tie, lang_pred, score) of every row. The prediction is a function of the text alone; a null text, one
    without a letter and any text where no language was learned are "und" with score 0. Languages that are as likely
    go by their names. The model is as large as the vocabulary times the languages."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + TOGETHER, side="right")))
                part = batch.slice(start, end - start)
                yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), score_texts(part.column(2), model))
                start = end

    return map_rows(keyed(docs, id_column, text_column), "_id long, _tie long, lang_pred string, score double",
                    lambda rows: ((i, t, *found) for i, t, found in rows), read)


def annotate(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """(_row, lang_pred, score): every row whole, as a struct, with the prediction for its text (see predict). The rows pass
    through the tasks that score them, so nothing is shuffled or joined."""
    at = docs.columns.index(text_column)
    schema = T.StructType([T.StructField("_row", docs.schema), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(at).cast(pa.string()), "")
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TOGETHER, side="right")))
                part = batch.slice(start, end - start)
                named, scores = zip(*score_texts(texts.slice(start, end - start), model))
                whole = pa.StructArray.from_arrays(part.columns, fields=list(part.schema))
                yield pa.RecordBatch.from_arrays([whole, pa.array(named, pa.string()), pa.array(scores, pa.float64())], ["_row", "lang_pred", "score"])
                start = end
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, schema)


def held_out(id_column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 by 3; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang", **settings) -> DataFrame:
    """(_id, _tie, lang_pred, score): learned from the documents that aren't held out, predicted for all. Rows with a
    null id aren't learned from."""
    return predict(docs, learned(docs, id_column, text_column, language_column, **settings), id_column, text_column)


def learned(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang", **settings) -> Model:
    """The model of the documents that have an id and aren't held out."""
    learn = ~held_out(id_column) & F.col(id_column).isNotNull()
    return train(docs, learn, id_column, text_column, language_column, **settings)


def report(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, held_out, lang_pred, score)."""
    found = identify(docs, **settings).withColumn("doc_id", id_back())
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
