"""Quality classifier: gradient-boosted trees over histograms of document statistics.

Trained on the driver from a bounded sample of labelled documents' statistics
(``sample`` rows at most), then flattened into arrays that numpy walks for a
whole batch at once. Statistics are of whole texts; labels, language, source and
id are no inputs.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.llm.shared import column_name
from vellumflow.llm.text_stats import SYMBOLS, lines_with_words, n_of, word_chars

STATISTICS = ["log_words", "word_length", "symbols", "exclaims", "capitals", "digits", "stops", "distinct", "same_as_last", "repeated_lines", "line_words", "other_signs", "beyond_ascii", "log_bytes"]
THRESHOLD = 0.3
_LOWER = b"abcdefghijklmnopqrstuvwxyz"
_UPPER, _DIGIT = _LOWER.upper(), b"0123456789"


def statistics(text: bytes) -> tuple[float, ...]:
    words, lines = text.split(), lines_with_words(text)
    n, chars, size = max(1, len(words)), max(1, word_chars(text)), max(1, len(text))
    ascii_size = len(text.translate(None, bytes(range(128, 256))))
    upper, digit, lower = n_of(text, _UPPER), n_of(text, _DIGIT), n_of(text, _LOWER)
    return (
        np.log1p(len(words)),
        chars / n,
        n_of(text, SYMBOLS) / n,
        n_of(text, b"!") / n,
        upper / chars,
        digit / chars,
        n_of(text, b".,;:") / n,
        len(set(words)) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        len(words) / max(1, len(lines)),
        (ascii_size - upper - digit - lower) / size,
        (len(text) - ascii_size) / size,
        np.log1p(len(text)),
    )


def statistics_of(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t.as_py() or b"") for t in texts], np.float64).reshape(-1, len(STATISTICS))


@dataclass
class Trees:
    """All trees in flat arrays; a leaf's children are itself."""

    prior: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, *, rounds: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Boost ``rounds`` trees on the logistic loss; without both labels, a constant (0.5 for no rows)."""
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    share = (y.sum() + 0.5) / (len(y) + 1)
    prior = float(np.log(share / (1 - share)))
    width = x.shape[1]
    if 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
        code = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)  # x <= cuts[k] iff code <= k
        margin = np.full(len(y), prior)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            at = np.zeros(len(y), np.int64)  # node of each row within the level
            base = len(feature)
            roots.append(base)
            ids, alive = [base], [True]
            add = lambda: [a.append(v) for a, v in ((feature, 0), (threshold, np.inf), (left, len(feature)), (right, len(feature)), (value, 0.0))]
            add()
            node = np.full(len(y), base)
            for level in range(depth + 1):
                k = len(ids)
                g, h = np.bincount(at[at >= 0], grad[at >= 0], k), np.bincount(at[at >= 0], hess[at >= 0], k)
                for i, n in enumerate(ids):
                    value[n] = float(-rate * g[i] / (h[i] + ridge))
                if level == depth:
                    break
                held = at >= 0
                best = np.full(k, 1e-6)
                choice = np.full((k, 2), -1)
                for f in range(width):
                    size = len(cuts[f]) + 1
                    key = at[held] * size + code[held, f]
                    gl = np.cumsum(np.bincount(key, grad[held], k * size).reshape(k, size), 1)[:, :-1]
                    hl = np.cumsum(np.bincount(key, hess[held], k * size).reshape(k, size), 1)[:, :-1]
                    gr, hr = g[:, None] - gl, h[:, None] - hl
                    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (g**2 / (h + ridge))[:, None]
                    gain[(hl < least * 0.01) | (hr < least * 0.01)] = -1
                    if size > 1:
                        j = gain.argmax(1)
                        v = gain[np.arange(k), j]
                        better = v > best
                        best[better], choice[better] = v[better], np.stack([np.full(k, f), j], 1)[better]
                new_ids, where = [], np.full((k, 2), -1)
                for i, n in enumerate(ids):
                    f, j = choice[i]
                    if f < 0:
                        continue
                    feature[n], threshold[n] = int(f), float(cuts[f][j])
                    left[n], right[n] = len(feature), len(feature) + 1
                    add(), add()
                    where[i] = len(new_ids), len(new_ids) + 1
                    new_ids += [left[n], right[n]]
                if not new_ids:
                    break
                rows = np.flatnonzero(held)
                a = at[rows]
                goes_right = x[rows, np.array(feature)[np.array(ids)[a]]] > np.array(threshold)[np.array(ids)[a]]
                at[rows] = where[a, goes_right.astype(int)]
                moved = rows[at[rows] >= 0]
                node[moved] = np.array(new_ids)[at[moved]]
                ids = new_ids
            margin += np.array(value)[node]
    elif not len(y):
        prior = 0.0
    return Trees(prior, np.array(feature, np.int32), np.array(threshold, float), np.array(left, np.int32), np.array(right, np.int32), np.array(value, float), np.array(roots, np.int32), depth)


def fold(doc_id: Column) -> Column:
    """CRC-32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def fit_quality(docs: DataFrame, labels: DataFrame, *, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **how) -> Trees:
    """Train from the labelled rows outside fold 0.

    An id counts once: of its labels the smallest, of its documents the one whose
    text has the smallest hash. At most ``sample`` ids take part, those of the
    smallest id hashes, so that what reaches the driver is bounded by ``sample``
    rows of statistics, however often an id is repeated. Null labels and labels
    without a document take no part.
    """
    labelled = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_y is not null and _id is not null").filter(fold(F.col("_id")) != 0)
    chosen = labelled.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    joined = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("binary").alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))

    def measure(texts: pa.Array) -> pa.Array:
        return pa.array(list(statistics_of(texts)), pa.list_(pa.float64()))

    measured = joined.select("_id", "_y", F.xxhash64("_text").alias("_hash"), F.arrow_udf(measure, "array<double>")(F.col("_text")).alias("_x"))
    once = measured.groupBy("_id").agg(F.min(F.struct("_hash", "_x", "_y")).alias("_first")).select("_id", "_first._y", "_first._x")
    got = sorted((r["_id"], r["_y"], r["_x"]) for r in once.collect())
    x = np.array([r[2] for r in got], np.float64).reshape(-1, len(STATISTICS))
    return train(x, np.array([float(r[1] > 0) for r in got]), **how)


def quality_score(model: Trees, text: Column) -> Column:
    """Score in [0, 1] of a text column; null counts as empty."""

    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(statistics_of(texts)), pa.float64())

    return F.arrow_udf(scored, "double")(text.cast("binary"))


def score_documents(docs: DataFrame, model: Trees, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, a row per row of ``docs``."""
    scored = docs.select(F.col(id_col).alias("doc_id"), quality_score(model, F.col(text_col)).alias("score"))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: Trees, *, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their columns only."""
    name = column_name(docs, "quality_score")
    return docs.withColumn(name, quality_score(model, F.col(text_col))).filter(F.col(name) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
