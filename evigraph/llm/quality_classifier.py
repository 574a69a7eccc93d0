"""Document quality by a regularised quadratic discriminant on text statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import held_out, mapped, stored, text_steps

#: Byte classes: letters a-z, A-Z, digits, blanks, line ends, sentence marks, bytes beyond
#: ASCII, and everything else (symbols).
LOWER, UPPER, DIGIT, BLANK, LINE, MARK, WIDE, SYMBOL = range(8)
CLASSES = np.full(256, SYMBOL, np.uint8)
for _chars, _kind in ((b"abcdefghijklmnopqrstuvwxyz", LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER),
                      (b"0123456789", DIGIT), (b" \t\x0b\x0c\r", BLANK), (b"\n", LINE),
                      (b".,;:?'\"()-", MARK)):
    CLASSES[list(_chars)] = _kind
CLASSES[128:] = WIDE

FEATURES = ("words", "word_length", "distinct", "upper", "digits", "marks", "symbols", "wide",
            "lines", "echo", "line_copies", "density")
#: Weight of the pooled covariance in each class's, then of its own diagonal.
TO_POOLED, TO_DIAGONAL = 0.2, 0.05
THRESHOLD = 0.3


def statistics(text: bytes, kinds: np.ndarray, pack) -> list[float]:
    """The transformed statistics of one whole text."""
    n = len(text)
    words = text.split()
    k = len(words)
    count = np.bincount(kinds, minlength=8)
    lines = [x for x in text.split(b"\n") if x.strip()]

    def share(part: float, of: float) -> float:
        return float(np.log((part + 0.002 * of + 0.01) / (of - part + 0.002 * of + 0.01)))

    solid = max(n - int(count[BLANK] + count[LINE]), 0)
    return [
        np.log1p(k), np.log1p(solid / max(k, 1)),
        np.log1p(len(set(words))) - 0.8 * np.log1p(k),
        share(int(count[UPPER]), solid), share(int(count[DIGIT]), solid),
        share(int(count[MARK]), solid), share(int(count[SYMBOL]), solid),
        share(int(count[WIDE]), solid), np.log1p(len(lines)) - 0.5 * np.log1p(k),
        share(sum(map(eq, words, words[1:])), max(k, 1)),
        share(len(lines) - len(set(lines)), max(len(lines), 1)),
        np.log((len(pack(text)) + 8) / (n + 16)),
    ]


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    out = np.zeros((batch.num_rows, len(FEATURES)))
    pack = zstandard.ZstdCompressor(level=1).compress
    for first, last, data, starts in text_steps(batch, column):
        raw, kinds = data.tobytes(), CLASSES[data]
        for i in range(first, last):
            a, b = starts[i - first], starts[i - first + 1]
            out[i] = statistics(raw[a:b], kinds[a:b], pack)
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and one column per statistic, for every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x[:, i]) for i in range(x.shape[1]))],
                ["doc_id", *FEATURES])

    schema = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)
    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), measure, schema)


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of class 0 and 1."""

    means: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1: the logistic of the difference of log densities."""
        if not len(x):
            return np.zeros(0)
        if not np.isfinite(self.log_prior).all():  # one class or none was learned from
            only = np.isfinite(self.log_prior)
            return np.full(len(x), float(only[1]) if only.any() else 0.5)
        logs = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.whiten[k].T
            logs.append(self.log_prior[k] - self.log_det[k] - 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit(features: DataFrame, labels: DataFrame, to_pooled: float = TO_POOLED,
        to_diagonal: float = TO_DIAGONAL) -> Discriminant:
    """Learn from all labelled rows that are not held out.

    Counts, sums and products of the statistics are summed by Spark; two rows of numbers
    reach the driver. Rows without a label of 0 or 1 teach nothing.
    """
    d = len(FEATURES)
    known = labels.where("quality in (0, 1)").select("doc_id", "quality")
    train = features.join(known, "doc_id").where(~held_out(F.col("doc_id")))
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    sums += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}")
             for i in range(d) for j in range(i + 1)]
    rows = {r["quality"]: r for r in train.groupBy("quality").agg(
        F.count("*").alias("n"), *sums).collect()}
    n = np.array([rows[k]["n"] if k in rows else 0 for k in (0, 1)], float)
    means, scatter = np.zeros((2, d)), np.zeros((2, d, d))
    for k, r in rows.items():
        means[k] = [r[f"s{i}"] / r["n"] for i in range(d)]
        for i in range(d):
            for j in range(i + 1):
                scatter[k, i, j] = scatter[k, j, i] = (
                    r[f"p{i}_{j}"] - r["n"] * means[k, i] * means[k, j])
    pooled = scatter.sum(axis=0) / max(n.sum() - 2, 1)
    whiten, log_det = np.zeros((2, d, d)), np.zeros(2)
    for k in (0, 1):
        own = scatter[k] / max(n[k] - 1, 1)
        cov = (1 - to_pooled) * own + to_pooled * pooled
        cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(pooled))
        factor = np.linalg.cholesky(cov + 1e-4 * np.eye(d))
        whiten[k] = np.linalg.inv(factor)
        log_det[k] = np.log(np.diag(factor)).sum()
    with np.errstate(divide="ignore"):
        prior = np.log(n / max(n.sum(), 1))
    return Discriminant(means, whiten, log_det, prior)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Scores come from the whole text alone. Null and empty texts are scored like any other,
    by the statistics of an empty text; a null doc_id is scored and teaches nothing;
    repeated rows get equal scores and teach as often as they occur; without labels of
    either class every score is 0.5, with one class 0 or 1; an empty table gives no rows.
    Columns other than doc_id, text and quality are not read.
    """
    features = stored(measured(docs))
    model = fit(features, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy() for i in range(1, batch.num_columns)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))],
                                             ["doc_id", "score"])

    return mapped(features, score, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score ``threshold`` or more; texts stay where they are read."""
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = model.score(_matrix(batch, at)) >= threshold
            yield batch.filter(pa.array(good, pa.bool_()))

    return mapped(docs, keep, docs.schema)
