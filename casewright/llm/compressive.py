"""Quality by compression: which of two zstandard dictionaries makes a text smaller.

One dictionary is built from well-rated, one from badly rated text. A text is compressed with each; the difference of
the two sizes, divided by the size of the text, is turned into a score by a logistic curve fitted on labelled texts.
The curve also sees the mean of the two normalised sizes: a text that any dictionary makes very small repeats itself,
and its difference, small for that reason, says little by itself.

Dictionaries and curve learn from at most ``most`` texts of each label, those with the smallest hashes of their ids;
half of them make the dictionaries and the other half the curve. They are read whole. Scoring is one pass over every
whole text.

Null and empty texts get the curve's value at no difference. Of several texts of one id to learn from the smallest is
taken. Rows without id count as held out. Very long texts are compressed whole. Equal texts get
equal scores. Extra columns are ignored. Without texts of both labels to learn from, every text gets the share of
label 1 (0 without labels). An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.toxicity import fold

#: Bytes of a dictionary; compression level.
SIZE, LEVEL = 64 << 10, 3
#: Bytes of a sample that a dictionary is built from; a longer text gives several.
PIECE = 512


@dataclass
class Model:
    good: bytes
    bad: bytes
    curve: tuple[float, ...]

    def __post_init__(self):
        self._pair = None

    def __getstate__(self):
        return self.good, self.bad, self.curve

    def __setstate__(self, state):
        self.good, self.bad, self.curve = state
        self._pair = None

    def measures(self, texts: list[str | None]) -> np.ndarray:
        """(normalised size difference, mean normalised size) of each text; zeros for empty ones."""
        if self._pair is None:
            made = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO) for d in (self.good, self.bad)]
            for d in made:
                d.precompute_compress(level=LEVEL)
            self._pair = [zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False) for d in made]
        out = np.zeros((len(texts), 2))
        for k, t in enumerate(texts):
            raw = (t or "").encode("utf-8", "surrogatepass")
            if raw:
                g, b = (len(c.compress(raw)) for c in self._pair)
                out[k] = (b - g) / len(raw), (b + g) / (2 * len(raw))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return _curve(np.array(self.curve), self.measures(texts))


def _design(x: np.ndarray) -> np.ndarray:
    d, m = 10 * np.clip(x[:, 0], -0.5, 0.5), np.minimum(x[:, 1], 1.0)
    return np.stack([np.ones(len(x)), d, m, d * d, m * m, d * m], axis=1)


def _curve(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_design(x) @ w, -40, 40)))


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> tuple[float, ...]:
    """A logistic curve by Newton steps; every label weighs as often as it occurs."""
    a, w = _design(x), np.zeros(6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(6)
        step = np.linalg.solve(h, a.T @ (p - y) + ridge * w)
        w = w - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
    return tuple(float(v) for v in w)


def dictionary(texts: list[str], size: int = SIZE) -> bytes:
    """A dictionary from all texts; raw content where there is too little to train on."""
    samples = []
    for t in texts:
        raw = t.encode("utf-8", "surrogatepass")
        samples += [raw[at : at + PIECE] for at in range(0, len(raw), PIECE)]
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def train(good: list[str], bad: list[str], share: float) -> Model:
    half = lambda x: (x[::2], x[1::2]) if len(x) > 1 else (x, x)
    (good_a, good_b), (bad_a, bad_b) = half(good), half(bad)
    model = Model(dictionary(good_a), dictionary(bad_a), (0.0,) * 6)
    x = np.concatenate([model.measures(good_b), model.measures(bad_b)])
    y = np.concatenate([np.ones(len(good_b)), np.zeros(len(bad_b))])
    model.curve = calibrate(x, y)
    # the sample holds as many of each label; the corpus does not
    shift = np.log(share / (1 - share)) - np.log(len(good_b) / len(bad_b))
    model.curve = (model.curve[0] + float(shift), *model.curve[1:])
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", most: int = 1500, folds: int = 5, held_out: int = 0) -> tuple[Model | None, float]:
    """A model from labelled rows outside the held-out fold, and the share of label 1."""
    learn = labels.where((fold(F.col(doc_id), folds) != held_out) & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("_label"))
    total = learn.agg(F.avg((F.col("_label") == 1).cast("double"))).first()[0]
    if total is None:
        return None, 0.0
    source = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text")).where("text is not null and text != ''")
    got = {}
    for value in (1, 0):
        chosen = learn.where((F.col("_label") == 1) == F.lit(value == 1)).orderBy(F.xxhash64("_id"), "_id").limit(most).select("_id")
        # one text for an id, so that no more than ``most`` come to the driver
        mine = source.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("text").alias("text"))
        got[value] = [r["text"] for r in mine.orderBy(F.xxhash64("_id"), "_id").collect()]
    if not got[1] or not got[0]:
        return None, float(total)
    return train(got[1], got[0], min(max(float(total), 1e-3), 1 - 1e-3)), float(total)


def score(docs: DataFrame, model: Model | None, share: float, doc_id: str = "doc_id", text: str = "text", cut_at: float = 0.3, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = np.full(part.num_rows, share) if model is None else model.score(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.float64()), pa.array((got >= cut_at).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(fold(F.col(doc_id), folds) == 0, F.lit(True)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
