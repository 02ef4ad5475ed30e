"""Quality classifier: regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breathline.llm.skew import lookup
from breathline.llm.storage import materialise
from breathline.llm.textvec import LOWER, passes, word_bounds, word_hashes

_B = np.arange(256)
_UPPER = (_B >= 65) & (_B <= 90)
_DIGIT = (_B >= 48) & (_B <= 57)
_LETTER = _UPPER | ((_B >= 97) & (_B <= 122)) | (_B >= 128)
_PLAIN = _LETTER | _DIGIT | np.isin(_B, [9, 10, 11, 12, 13, 32, 39, 44, 45, 46])
_STOP = _B == 46
N_FEATURES = 8


def statistics(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text; shares are in square roots, sizes in logarithms."""
    out = np.zeros((len(column), N_FEATURES))
    for first, end, data, offsets in passes(column):
        n = end - first
        size = np.diff(offsets)
        at_least = np.maximum(size, 1)

        def share(table, data=data, offsets=offsets, at_least=at_least):
            sums = np.concatenate(([0], np.cumsum(table[data])))
            return np.sqrt((sums[offsets[1:]] - sums[offsets[:-1]]) / at_least)

        starts, ends, rows = word_bounds(data, offsets)
        words = np.bincount(rows, minlength=n)
        hashes = word_hashes(LOWER[data], starts, ends)
        order = np.lexsort((hashes, rows))
        h, r = hashes[order], rows[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        distinct = np.bincount(r[fresh], minlength=n)
        chars = np.bincount(rows, weights=ends - starts, minlength=n)
        some = np.maximum(words, 1)
        out[first:end] = np.column_stack([np.log1p(size), share(_UPPER), share(~_PLAIN), share(_DIGIT), share(_STOP), np.log1p(chars / some), np.log(np.maximum(distinct, 1)) - 0.75 * np.log(some), np.log1p(words)])
    return out


@dataclass
class Model:
    """Class 1 against class 0: means, inverse Cholesky factors, log determinants and log prior odds."""

    means: np.ndarray
    roots: np.ndarray
    logdets: np.ndarray
    log_odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), 1 / (1 + np.exp(-self.log_odds)))
        log = [-0.5 * (((x - m) @ root.T) ** 2).sum(1) - 0.5 * d for m, root, d in zip(self.means, self.roots, self.logdets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0] + self.log_odds, -500, 500)))


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sum and sum of products per class in each batch."""
    for batch in batches:
        x, y = statistics(batch.column("text")), np.asarray(batch.column("label"))
        rows = [(k, int((y == k).sum()), x[y == k].sum(0).tolist(), (x[y == k].T @ x[y == k]).ravel().tolist()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)], ["label", "n", "s", "p"])


def fit(docs: DataFrame, labels: DataFrame, shrinkage: float = 0.1) -> Model:
    """Fit on every labelled row: ``docs`` (id, text), ``labels`` (id, label 0 or 1).

    Means and covariances come from sums over all rows, so nothing is sampled. Each
    covariance is shrunk towards the pooled one by ``shrinkage`` plus a small multiple of
    the identity. Null labels are ignored, of an id's repeated labels the largest counts;
    with an absent class the score is the prior alone.
    """
    labels = materialise(labels.filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"), F.count(F.lit(1)).alias("n")), "labels")
    rows = lookup(docs, labels, "id", "n", 1)
    parts = rows.select("text", F.col("label").cast("int").alias("label")).mapInArrow(_sums, "label int, n long, s array<double>, p array<double>")
    flat = parts.select("label", "n", F.posexplode(F.concat("s", "p")).alias("at", "v")).groupBy("label", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    total = np.zeros((2, N_FEATURES + N_FEATURES**2))
    n = np.zeros(2)
    for row in flat.collect():  # two classes times 72 sums
        total[row.label, row.at], n[row.label] = row.v, row.n
    log_odds = float(np.log((n[1] + 1) / (n[0] + 1)))
    if n.min() < 1:
        return Model(np.zeros((0, N_FEATURES)), np.zeros((0, 0, 0)), np.zeros(0), log_odds)
    means = total[:, :N_FEATURES] / n[:, None]
    scatter = total[:, N_FEATURES:].reshape(2, N_FEATURES, N_FEATURES) - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(0) / n.sum()
    roots, logdets = [], []
    for k in (0, 1):
        cov = (1 - shrinkage) * scatter[k] / n[k] + shrinkage * pooled + 1e-4 * np.eye(N_FEATURES)
        root = np.linalg.cholesky(cov)
        roots.append(np.linalg.inv(root))
        logdets.append(2 * np.log(np.diag(root)).sum())
    return Model(means, np.array(roots), np.array(logdets), log_odds)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(id, score) of each row; null and empty texts are scored by their statistics, all zero."""

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(statistics(batch.column("text"))))], ["id", "score"])

    return docs.select("id", "text").mapInArrow(apply, "id long, score double")
