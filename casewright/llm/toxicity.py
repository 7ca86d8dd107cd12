"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; any other text of the corpus is unlabelled. A numpy linear classifier over
hashed word and word-prefix shares minimises the class-prior-corrected risk ``prior * R_p(+) + max(0, R_u(-) - prior *
R_p(-))``: where the corrected negative risk falls below zero its gradient is turned round, which keeps a flexible
model from fitting the unlabelled toxic texts as clean. The prior is the share of label 1 among the labelled
training rows.

Training takes at most ``most_positive`` positives and ``most_unlabelled`` unlabelled texts, those with the smallest
hashes of their ids; scoring is one pass over every whole text with only the weights sent out, and needs no shuffle.

Null and empty texts, and texts without letters, get the score of the bias alone. Very long texts are read whole.
Equal texts get equal scores. Extra columns are ignored. Without a positive or an unlabelled text to learn from,
every text gets the prior (0 where there are no labels). An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm import wordhash
from casewright.llm.packing import lean, pack, unpack

BITS = 18
PREFIXES = (4, 5, 6)
#: A share of a hundredth of a text's words counts as one.
SCALE = 100.0


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, one row for each word; text of each word's first row; words of each text)."""
    w = wordhash.read(column, lower=True, gap=wordhash.NO_LETTER)
    kinds = [w.hash] + [wordhash.prefixes(w, k) for k in PREFIXES]
    bucket = np.stack([(h >> np.uint64(64 - BITS)).astype(np.int64) for h in kinds], axis=1)
    bucket[:, 1:][np.stack(kinds[1:], axis=1) == 0] = 2**BITS
    return bucket, w.first, np.diff(w.first)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        bucket, first, n = features(column)
        held = np.append(self.weights, np.float32(0))
        value = np.concatenate([[0.0], np.cumsum(held[bucket].sum(axis=1, dtype=np.float64))])
        z = self.bias + SCALE * (value[first[1:]] - value[first[:-1]]) / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _matrix(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, value, row) of all texts."""
    got = [unpack(b) for b in blobs]
    row = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
    bucket = np.concatenate([g[0] for g in got]).astype(np.int64)
    value = np.concatenate([g[1].astype(np.float32) * np.float32(SCALE) / np.float32(max(1, int(g[2][0]))) for g in got])
    return bucket, value, row


def telling(bucket: np.ndarray, row: np.ndarray, n_p: int, n: int, least: float) -> np.ndarray:
    """True for features whose share of positive texts differs from that of unlabelled texts by ``least`` deviations."""
    in_p = np.bincount(bucket[row < n_p], minlength=2**BITS)
    in_u = np.bincount(bucket[row >= n_p], minlength=2**BITS)
    p, u = in_p / n_p, in_u / (n - n_p)
    both = (in_p + in_u + 1) / (n + 2)
    return np.abs(p - u) >= least * np.sqrt(both * (1 - both) * (1 / n_p + 1 / (n - n_p)))


def train(positive: list[bytes], unlabelled: list[bytes], prior: float, rounds: int = 300, rate: float = 0.05, decay: float = 1e-4, least: float = 4.0) -> Model:
    """Full-batch Adam on the non-negative PU risk with the logistic loss, over telling features."""
    bucket, value, row = _matrix(positive + unlabelled)
    n_p, n = len(positive), len(positive) + len(unlabelled)
    used = telling(bucket, row, n_p, n, least)
    bucket, value, row = (x[used[bucket]] for x in (bucket, value, row))
    names, column = np.unique(bucket, return_inverse=True)
    k = len(names)
    # steps fit values of about one; shares of a whole text would be a hundred times that
    size = max(1.0, float(np.sqrt(np.mean(value.astype(np.float64) ** 2)))) if len(value) else 1.0
    value = value / size
    w, m, v = (np.zeros(k + 1) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[column] * value, n) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        soft = np.logaddexp(0, z)
        negative = soft[n_p:].mean() - prior * soft[:n_p].mean()
        g = np.zeros(n)
        if negative >= 0:
            g[:n_p] = -prior / n_p
            g[n_p:] = s[n_p:] / (n - n_p)
        else:
            g[:n_p] = prior * s[:n_p] / n_p
            g[n_p:] = -s[n_p:] / (n - n_p)
        grad = np.append(np.bincount(column, g[row] * value, k), g.sum())
        grad[:-1] += decay * w[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        w -= rate * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    held = np.zeros(2**BITS, np.float32)
    held[names] = w[:-1] / size
    return Model(held, float(w[-1]))


def fold(doc_id: Column, folds: int = 5) -> Column:
    """The rest of the CRC-32 of the id, as decimal text, by ``folds``."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def collected(docs: DataFrame, text: str = "text") -> list[bytes]:
    """Packed feature counts of a bounded number of texts, on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            for batch in batches:
                for part in wordhash.slices(batch, 0):
                    bucket, first, n = features(part.column(0))
                    out = []
                    for k in range(part.num_rows):
                        b, c = np.unique(bucket[first[k] : first[k + 1]], return_counts=True)
                        known = b < 2**BITS
                        out.append(pack(b[known].astype(np.uint32), c[known].astype(np.uint32), np.array([n[k]], np.uint32)))
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["blob"])

    return [r[0] for r in docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "blob binary").collect()]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", most_positive: int = 3000, most_unlabelled: int = 7000, folds: int = 5, held_out: int = 0) -> tuple[Model | None, float]:
    """A model from the rows outside the held-out fold, and the prior."""
    learn = labels.where((fold(F.col(doc_id), folds) != held_out) & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("_label"))
    total = learn.agg(F.avg((F.col("_label") == 1).cast("double"))).first()[0]
    if total is None:
        return None, 0.0
    prior = min(max(float(total), 1e-4), 0.9)
    source = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).where(fold(F.col("_id"), folds) != held_out)
    order = F.xxhash64("_id")
    chosen_p = learn.where("_label = 1").orderBy(order, "_id").limit(most_positive).select("_id")
    # one text for an id, so that no more than the bound come to the driver
    chosen = lambda ids: source.join(F.broadcast(ids), "_id").groupBy("_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).orderBy(order, "_id")
    positive = collected(chosen(chosen_p))
    chosen_u = source.select("_id").distinct().orderBy(order, "_id").limit(most_unlabelled)
    unlabelled = collected(chosen(chosen_u))
    if not positive or not unlabelled:
        return None, float(total)
    return train(positive, unlabelled, prior), prior


def score(docs: DataFrame, model: Model | None, prior: float, doc_id: str = "doc_id", text: str = "text", cut_at: float = 0.5, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            for batch in batches:
                for part in wordhash.slices(batch, 2):
                    got = np.full(part.num_rows, prior) if sent.value is None else sent.value.score(part.column(2))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.float64()), pa.array((got >= cut_at).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(fold(F.col(doc_id), folds) == 0, F.lit(True)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
