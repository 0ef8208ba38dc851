"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line with a word is a node with two states, bad and good. Its potential is linear in
features of the line and of the lines before and after it; neighbouring lines share a
transition potential. Forward-backward gives each line's probability to be good; the mean
weighted by line length is the document's raw quality, and a one-variable logistic fit maps it
to the score.

Fitting uses a bounded sample of labelled documents: at most ``max_train`` ids, half of each
label, lowest hash of the id first, never a held-out id, texts of at most ``max_train_chars``
characters and ``max_train_lines`` lines. Labels belong to documents; lines of a good document
count as good, lines of a bad one as bad unless a first fit without transitions calls them good
(the worst line stays bad). Only the sample's line features come to the driver. Scores depend
on the text alone.

Defined results: a null text, or one without words, has no lines and scores 0; without both
labels in the sample every other document scores 0.5; a null id is not held out; repeated rows
stay, a row each; other columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import map_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL_WORD = re.compile(r"[^\s]*[#*$%&|<>{}=_~^\\][^\s]*")
FEATURES = 15


@dataclass(frozen=True)
class Training:
    folds: int = 5
    max_train: int = 3000
    max_train_chars: int = 20_000
    max_train_lines: int = 400
    steps: int = 120
    rate: float = 0.1
    ridge: float = 1e-3


def held_out(id_col: str, folds: int) -> Column:
    """Whether crc32 of the id as text falls in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features by line, line lengths) of the lines that have a word."""
    rows, lengths, seen = [], [], set()
    for line in text.split("\n"):
        words = WORD.findall(line)
        n = len(words)
        if not n:
            continue
        chars, distinct = sum(map(len, words)), len(set(words))
        bars, symbols = words.count("|"), len(SYMBOL_WORD.findall(line))
        repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
        windows = set(zip(words, words[1:], words[2:], strict=False))
        stops = line.count(". ") + line.count(", ") + line.endswith((".", ","))
        digits = sum(map(line.count, "0123456789"))
        rows.append((1.0, math.log1p(n) / 5, symbols / n, bars / n, repeats / n, distinct / n,
                     1 - len(windows) / (n - 2) if n > 2 else 0.0, chars / n / 10, stops / n, digits / chars,
                     float(line[:1].isupper()), float(line.endswith((".", "!", "?"))), float(line in seen),
                     line.count("!") / n, sum(map(str.isupper, words)) / n))
        lengths.append(len(line))
        seen.add(line)
    return np.array(rows, np.float32).reshape(-1, FEATURES), np.array(lengths, np.float64)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the lines before and after it (zeros at the ends)."""
    edge = np.zeros((1, x.shape[1]), x.dtype)
    return np.hstack([x, np.vstack([edge, x[:-1]]), np.vstack([x[1:], edge])]) if len(x) else np.zeros((0, 3 * x.shape[1]))


def forward_backward(unary: list[float], move: np.ndarray) -> tuple[list[float], list[list[float]]]:
    """P(good) of each line, and expected counts of the four transitions; ``unary`` is the log odds of good."""
    (bb, bg), (gb, gg) = np.exp(move).tolist()
    odds = [math.exp(max(-30.0, min(30.0, u))) for u in unary]
    n = len(odds)
    ahead = [0.0] * n  # P(good) given the lines so far
    p = odds[0] / (1 + odds[0])
    ahead[0] = p
    for k in range(1, n):
        good, bad = (p * gg + (1 - p) * bg) * odds[k], p * gb + (1 - p) * bb
        p = ahead[k] = good / (good + bad)
    marginal, counts = [0.0] * n, [[0.0, 0.0], [0.0, 0.0]]
    back_good, back_bad = 1.0, 1.0
    for k in range(n - 1, -1, -1):
        good, bad = ahead[k] * back_good, (1 - ahead[k]) * back_bad
        marginal[k] = good / (good + bad)
        if k:
            before, g, b = ahead[k - 1], odds[k] * back_good, back_bad
            parts = ((1 - before) * bb * b, (1 - before) * bg * g, before * gb * b, before * gg * g)
            total = sum(parts)
            for i, part in enumerate(parts):
                counts[i // 2][i % 2] += part / total
            back_good, back_bad = gg * g + gb * b, bg * g + bb * b
            scale = back_good + back_bad
            back_good, back_bad = back_good / scale, back_bad / scale
    return marginal, counts


def climb(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    """Adam ascent."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for k in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    move: np.ndarray
    slope: float
    shift: float

    def raw(self, x: np.ndarray, lengths: np.ndarray) -> float:
        """Length-weighted mean probability of good lines."""
        marginal, _ = forward_backward((with_neighbours(x) @ self.weights).tolist(), self.move)
        return float(np.dot(marginal, lengths) / lengths.sum())

    def score(self, text: str) -> float:
        x, lengths = line_features(text)
        if not len(x):
            return 0.0
        return 1 / (1 + math.exp(-(self.slope * self.raw(x, lengths) + self.shift)))


def fit_sample(sample: list[tuple[np.ndarray, np.ndarray, int]], training: Training) -> Model:
    """Fit on (line features, line lengths, label) of the sampled documents."""
    width = 3 * FEATURES
    labels = np.array([label for _, _, label in sample], float)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(width), np.zeros((2, 2)), 0.0, 0.0)
    parts = [with_neighbours(x) for x, _, _ in sample]
    ends = np.cumsum([len(p) for p in parts])
    x, begins = np.vstack(parts).astype(float), np.concatenate([[0], ends[:-1]])
    y = np.repeat(labels, [len(p) for p in parts])

    def plain(w):
        return x.T @ (y - 1 / (1 + np.exp(-x @ w))) / len(y) - training.ridge * w

    first = x @ climb(plain, width, training.steps, training.rate)
    for label, a, b in zip(labels, begins, ends, strict=True):
        if not label:
            y[a:b] = first[a:b] > 0
            y[a + int(np.argmin(first[a:b]))] = 0
    seen = np.zeros((2, 2))
    for a, b in zip(begins, ends, strict=True):
        np.add.at(seen, (y[a:b - 1].astype(int), y[a + 1:b].astype(int)), 1)

    def chained(w):
        unary, move = (x @ w[:width]).tolist(), w[width:].reshape(2, 2)
        marginal, expected = np.zeros(len(y)), np.zeros((2, 2))
        for a, b in zip(begins, ends, strict=True):
            marginal[a:b], counts = forward_backward(unary[a:b], move)
            expected += counts
        return np.concatenate([x.T @ (y - marginal), (seen - expected).ravel()]) / len(y) - training.ridge * w

    w = climb(chained, width + 4, training.steps // 2, training.rate)
    model = Model(w[:width], w[width:].reshape(2, 2), 1.0, 0.0)
    raw = np.array([model.raw(f, n) for f, n, _ in sample])

    def logistic(v):
        rest = labels - 1 / (1 + np.exp(-(v[0] * raw + v[1])))
        return np.array([rest @ raw, rest.sum()]) / len(raw) - 1e-4 * v

    slope, shift = climb(logistic, 2, 600, 0.2)
    return Model(model.weights, model.move, float(slope), float(shift))


def fit(docs: DataFrame, labels: DataFrame, *, training: Training = Training(), id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on the bounded sample; eager."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col, training.folds))
    known = known.groupBy(F.col(id_col).alias("sample_id")).agg(F.min(label_col).alias("sample_label"))
    half = [known.filter(F.col("sample_label") == value).orderBy(F.xxhash64("sample_id"), "sample_id").limit(training.max_train // 2)
            for value in (0, 1)]
    chosen = F.broadcast(half[0].unionByName(half[1]))
    base = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("row_text"))  # no other column, whatever its name
    texts = (base.filter((F.length("row_text") <= training.max_train_chars)
                         & (F.length("row_text") - F.length(F.replace(F.col("row_text"), F.lit("\n"), F.lit(""))) < training.max_train_lines))
             .join(chosen, F.col("row_id") == F.col("sample_id")).select("sample_id", "sample_label", "row_text")
             .dropDuplicates(["sample_id"]))

    def start():
        def step(columns):
            found = [line_features(text) for text in columns[2]]
            return [columns[0], [int(v) for v in columns[1]], [x.tobytes() for x, _ in found], [n.tobytes() for _, n in found]]

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    rows = map_rows(texts, ["sample_id", "sample_label", "row_text"],
                    f"sample_id {kind}, label int, x binary, n binary", start).collect()
    sample = [(np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES), np.frombuffer(r["n"], np.float64), r["label"])
              for r in sorted(rows, key=lambda r: str(r["sample_id"])) if r["n"]]
    return fit_sample(sample, training)


def classify(docs: DataFrame, model: Model, *, threshold: float = 0.3, folds: int = 5, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        def step(columns):
            ids, out, texts = columns
            scores = [round(model.score(text or ""), 9) for text in texts]
            return [ids, out, scores, [int(s >= threshold) for s in scores]]

        return step

    flagged = docs.select(id_col, held_out(id_col, folds).alias("held_out"), text_col)
    return map_rows(flagged, flagged.columns, f"`{id_col}` {kind}, held_out boolean, score double, predicted int", start)
