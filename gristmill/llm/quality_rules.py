"""Quality rules by line sequence labelling (operator 6).

A linear-chain conditional random field marks each line of a text as content or boilerplate; Viterbi decoding finds
the likeliest marks, and the share of words in content lines decides whether a text that passes the base rules stays.
The field is trained on a bounded sample of labelled documents. Labels are of documents, so it learns where marks change
from texts joined out of lines of good and bad documents, whose seams are known, besides the documents themselves.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.rows import hashed_sample, id_back, id_key, keyed, map_rows

# Symbols, blanks, and limits of the base rules.
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Documents of each label to learn from, and the most lines that such a document has.
SAMPLE, SAMPLE_LINES = 300, 200
#: Least share of words in content lines.
CONTENT = 0.5
STEPS, RATE, DECAY = 200, 0.3, 1e-3
FEATURES = 12


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = text.encode().split()
    n = len(words)
    lines = text.split("\n")
    seen: set[str] = set()
    duplicates = 0
    for line in lines:
        if line in seen:
            duplicates += 1
        elif line.strip(BLANKS):
            seen.add(line)
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) < len(windows):
        end = 0  # words before it are counted
        for k, window in enumerate(windows):
            if counts[window] > 1:
                repeated += k + 3 - max(end, k)
                end = k + 3
    return n, len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), duplicates, repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED * n_words


def line_features(text: str) -> tuple[list[list[float]], list[int]]:
    """Features and numbers of words of each line with a word."""
    rows, sizes = [], []
    seen: Counter = Counter()
    for line in text.split("\n"):
        words = line.split()
        if not words:
            continue
        n, chars = len(words), sum(map(len, words))
        symbols = sum(map(line.count, SYMBOLS))
        marks = line.count("!") + line.count("?")
        upper = sum(w.isupper() and len(w) > 1 for w in words)
        alone = sum(not w[0].isalnum() and len(w) == 1 for w in words)
        digits = sum(w[0].isdigit() for w in words)
        odd_end = sum(not w[-1].isalnum() and w[-1] not in ".,;:" for w in words)
        rows.append([1.0, math.log1p(n) / 5, min(chars / n, 20.0) / 10, symbols / n, marks / n, upper / n, alone / n, digits / n, odd_end / n,
                     1 - len(set(words)) / n, float(line.rstrip()[-1] in ".!?"), float(seen[line] > 0)])
        sizes.append(n)
        seen[line] += 1
    return rows, sizes


@dataclass
class Field:
    """Scores of a line's marks (0 boilerplate, 1 content) by feature, and of a mark after a mark."""
    weights: np.ndarray  # FEATURES x 2
    steps: np.ndarray    # 2 x 2

    def decode(self, rows: list[list[float]]) -> list[int]:
        """The likeliest marks, by Viterbi; ties are content."""
        if not rows:
            return []
        scores = (np.array(rows) @ self.weights).tolist()
        (s00, s01), (s10, s11) = self.steps.tolist()
        zero, one = scores[0]
        back = []
        for a, b in scores[1:]:
            from_zero, from_one = zero + s00 > one + s10, zero + s01 > one + s11
            back.append((0 if from_zero else 1, 0 if from_one else 1))
            zero, one = a + (zero + s00 if from_zero else one + s10), b + (zero + s01 if from_one else one + s11)
        marks = [0 if zero > one else 1]
        for before in reversed(back):
            marks.append(before[marks[-1]])
        return marks[::-1]


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def seamed(good: list[np.ndarray], bad: list[np.ndarray], most: int, seed: int = 0) -> list[tuple[np.ndarray, list[int]]]:
    """Texts joined out of runs of lines of good and bad documents, with a mark for each line: a good text with a bad tail,
    one with a bad head, one with bad lines in its middle, and a bad text with a good tail. The documents meet in turn until
    each has been used; places and lengths of runs are drawn with ``seed``, and a text has at most ``most`` lines."""
    draw = np.random.default_rng(seed)
    out = []
    for k in range(max(len(good), len(bad))):
        a, b = good[k % len(good)], bad[k % len(bad)]
        cut = int(draw.integers(0, len(a) + 1))
        shapes = ((a, 1, b, 0), (b, 0, a, 1), (a[:cut], 1, b, 0, a[cut:], 1), (b, 0, a, 1, b, 0))
        for whole, shape in enumerate(shapes):
            rows, marks = [], []
            for run, mark in zip(shape[::2], shape[1::2]):
                if len(run) and (mark == 0 or whole == 3):
                    start = int(draw.integers(0, len(run)))
                    run = run[start:start + int(draw.integers(1, len(run) + 1))]
                rows.append(run)
                marks += [mark] * len(run)
            out.append((np.concatenate(rows)[:most], marks[:most]))
    return out


def _expected(x: np.ndarray, lengths: np.ndarray, weights: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected sums of features by mark and numbers of steps between marks, over texts side by side, padded to the longest."""
    size, most = x.shape[:2]
    inside = np.arange(most) < lengths[:, None]
    unary = x @ weights
    forward, backward = np.zeros((most, size, 2)), np.zeros((most, size, 2))
    forward[0] = unary[:, 0]
    for t in range(1, most):
        new = unary[:, t] + _sum_exp(forward[t - 1][:, :, None] + steps, 1)
        forward[t] = np.where(inside[:, t, None], new, forward[t - 1])
    z = _sum_exp(forward[-1], 1)
    for t in range(most - 2, -1, -1):
        new = _sum_exp(steps + (unary[:, t + 1] + backward[t + 1])[:, None, :], 2)
        backward[t] = np.where(inside[:, t + 1, None], new, 0)
    chance = np.exp(forward + backward - z[:, None]).transpose(1, 0, 2) * inside[:, :, None]
    before, after = forward[:-1].transpose(1, 0, 2), (unary[:, 1:] + backward[1:].transpose(1, 0, 2))
    pairs = np.exp(np.where(inside[:, 1:, None, None], before[:, :, :, None] + steps + after[:, :, None, :] - z[:, None, None, None], -np.inf))
    return np.einsum("ntf,ntm->fm", x, chance), pairs.sum(axis=(0, 1))


def fit(texts: list[np.ndarray], marks: list[list[int]], steps: int = STEPS) -> Field:
    """Maximum likelihood of the lines' marks with a quadratic penalty, by Adam; texts of like length go side by side."""
    groups: dict[int, list[int]] = {}
    for k, rows in enumerate(texts):
        groups.setdefault(len(rows).bit_length(), []).append(k)
    padded = []
    for at in groups.values():
        lengths = np.array([len(texts[k]) for k in at])
        x = np.zeros((len(at), lengths.max(), FEATURES))
        for row, k in enumerate(at):
            x[row, :len(texts[k])] = texts[k]
        padded.append((x, lengths))
    gold_x, gold_steps = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    for rows, own in zip(texts, marks):
        np.add.at(gold_x.T, own, rows)
        np.add.at(gold_steps, (own[:-1], own[1:]), 1)
    total = sum(map(len, texts))
    parameters = np.zeros(FEATURES * 2 + 4)
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    for step in range(1, steps + 1):
        weights, between = parameters[:-4].reshape(FEATURES, 2), parameters[-4:].reshape(2, 2)
        found = [_expected(x, lengths, weights, between) for x, lengths in padded]
        slope = np.concatenate([(gold_x - sum(f for f, _ in found)).ravel(), (gold_steps - sum(p for _, p in found)).ravel()]
                               ) / total - DECAY * parameters
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope ** 2
        parameters = parameters + RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return Field(parameters[:-4].reshape(FEATURES, 2), parameters[-4:].reshape(2, 2))


def fit_documents(good: list[np.ndarray], bad: list[np.ndarray], lines: int = SAMPLE_LINES) -> Field:
    """A field from the line features of good and of bad documents, alone and joined."""
    pairs = [(x, [mark] * len(x)) for mark, xs in ((0, bad), (1, good)) for x in xs] + seamed(good, bad, lines)
    return fit([x for x, _ in pairs], [m for _, m in pairs])


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
          sample: int = SAMPLE, lines: int = SAMPLE_LINES) -> Field | None:
    """A field from ``sample`` documents of each label, 0 and 1, with one to ``lines`` lines, taken by the hash of their
    ids; None if a label has none. Null ids and labels are left out."""
    rows = labels.select(id_key(id_column).alias("_id"), F.col(label_column).cast("int").alias("_label"), F.col(id_column).isNotNull().alias("_known"))
    known = rows.filter("_known AND _label IN (0, 1)").groupBy("_id").agg(F.max("_label").alias("_label"))
    chosen = hashed_sample(known, "_label", sample)
    texts = keyed(docs, id_column, text_column).join(F.broadcast(chosen), "_id").select("_id", "_label", "_text")

    def features(rows: Iterator[tuple]) -> Iterator[tuple]:
        for i, label, text in rows:
            found, _ = line_features(text)
            if 0 < len(found) <= lines:
                yield i, label, [v for row in found for v in row]

    found = sorted(map(tuple, map_rows(texts, "_id long, label int, features array<double>", features).collect()))
    bad, good = ([np.array(x).reshape(-1, FEATURES) for _, own, x in found if own == label] for label in (0, 1))
    return fit_documents(good, bad, lines) if good and bad else None


def judged(text: str, field: Field | None) -> tuple:
    n, chars, symbols, duplicates, repeated = base_counts(text)
    failed = base_failed(n, repeated)
    rows, sizes = line_features(text)
    share = 1.0
    if field and sizes:
        share = sum(s for s, mark in zip(sizes, field.decode(rows)) if mark) / sum(sizes)
    return n, chars, symbols, duplicates, repeated, failed, not failed and share >= CONTENT, share


def judge(docs: DataFrame, field: Field | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The counts, verdicts and content share of every row's whole text. A null text has no words and fails the base
    rules. Without a field every text that passes the base rules is kept."""
    out = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
           "kept boolean, content_share double")
    return map_rows(keyed(docs, id_column, text_column), out, lambda rows: ((i, *judged(text, field)) for i, _, text in rows)
                    ).withColumn("doc_id", id_back("doc_id"))
