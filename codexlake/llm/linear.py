"""Logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Per-coordinate learning rates and the L1 term leave most weights at zero; the others are a small
sorted array that is broadcast, and a text's score is a sparse dot product over its features.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexlake.llm.common import as_batch, bounds, only, pieces, prepare

Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Ftrl:
    """Settings. `train_rows` bounds the labelled rows that the model is fitted on, `train_features` their
    features together (8 bytes each); `prior` is the score of every text while there is no usable label."""

    bits: int = 20
    alpha: float = 0.15
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0
    epochs: int = 3
    train_rows: int = 6000
    train_features: int = 30_000_000
    prior: float = 0.5


@dataclass(frozen=True)
class Model:
    index: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 0):
    """True where crc32 of the id as text leaves this remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], s: Ftrl) -> Model:
    """One pass per epoch over (feature indices, values, label), in an order that the data and epoch decide; no rows give the prior."""
    if not rows:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log(s.prior / (1 - s.prior))), s.bits)
    z, n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)
    bz = bn = 0.0

    def bias() -> float:
        return -bz * s.alpha / (s.beta + bn**0.5)

    for epoch in range(s.epochs):
        for k in np.random.Generator(np.random.Philox(epoch)).permutation(len(rows)):
            i, x, y = rows[k]
            x = x.astype(np.float64)
            zi, ni = z[i], n[i]
            w = np.where(np.abs(zi) <= s.l1, 0, -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(ni)) / s.alpha + s.l2))
            b = bias()
            g = float(sigmoid(np.array([w @ x + b]))[0]) - y
            gx = g * x
            sigma = (np.sqrt(ni + gx * gx) - np.sqrt(ni)) / s.alpha
            z[i] = zi + gx - sigma * w
            n[i] = ni + gx * gx
            bs = ((bn + g * g) ** 0.5 - bn**0.5) / s.alpha
            bz, bn = bz + g - bs * b, bn + g * g
    w = np.where(np.abs(z) <= s.l1, 0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))
    on = np.flatnonzero(w)
    return Model(on.astype(np.int64), w[on].astype(np.float32), bias(), s.bits)


def train(docs: DataFrame, labels: DataFrame, label: str, features: Features, s: Ftrl, folds: int = 5, fold: int = 0) -> Model:
    """Fit on at most `train_rows` labelled texts outside the held-out fold, those of the smallest id hashes.

    Only the bounded sample of sparse features reaches the one task that runs the sequential updates,
    and only the nonzero weights reach the driver. Labels of a null id, null labels and labels of ids that no text
    has are passed over before the bound is taken, so they use up none of it; of several labels of an id the
    greatest counts; rows that repeat an id train each, up to the bound. With no usable label, or an empty table,
    every text scores `prior`.
    """
    spark = docs.sparkSession
    prepare(spark)
    marked = only(labels, "doc_id", label).toDF("doc_id", "label").where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    usable = marked.where(~held_out(folds=folds, fold=fold))
    # ids alone are joined here; the bounded choice then fetches its texts
    known = usable.join(only(docs, "doc_id").distinct(), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.train_rows)
    texts = only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "label")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in pieces(batch, "text"):
                rows, index, value = features(raw, offsets)
                cut = bounds(rows, len(part)).astype(np.int32)
                name = [zlib.crc32(index[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield as_batch(_SPARSE, part.column(0), name, part.column(2), pa.ListArray.from_arrays(cut, pa.array(index.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(value, pa.float32())))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for y, i, x in zip(*(batch.column(c) for c in range(3)), strict=True):
                if len(rows) < s.train_rows:
                    rows.append((i.values.to_numpy(zero_copy_only=False), x.values.to_numpy(zero_copy_only=False), y.as_py()))
        model = fit(rows, s)
        yield as_batch(_WEIGHTS, [*model.index, -1], [*model.weight, model.bias])

    sparse = texts.mapInArrow(extract, "doc_id bigint, name bigint, label int, i array<int>, x array<float>")
    # in one order whatever the partitions were: each task sends its first rows only, and what they hold is taken up to the bound on features
    place = [F.xxhash64("doc_id"), "doc_id", "name", "label"]
    order = Window.orderBy(*place)
    within = sparse.orderBy(*place).limit(s.train_rows).withColumn("before", F.sum(F.size("i")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    bounded = within.where(F.coalesce("before", F.lit(0)) <= s.train_features).select("label", "i", "x")
    fitted = bounded.coalesce(1).mapInArrow(learn, "i bigint, w double").toArrow()
    index, weight = fitted["i"].to_numpy(), fitted["w"].to_numpy()
    order = np.argsort(index)
    index, weight = index[order], weight[order]
    real = index >= 0
    bias = float(weight[~real][0]) if (~real).any() else float(np.log(s.prior / (1 - s.prior)))
    return Model(index[real], weight[real].astype(np.float32), bias, s.bits)


_SPARSE = pa.schema([("doc_id", pa.int64()), ("name", pa.int64()), ("label", pa.int32()), ("i", pa.list_(pa.int32())), ("x", pa.list_(pa.float32()))])
_WEIGHTS = pa.schema([("i", pa.int64()), ("w", pa.float64())])


class Scorer:
    """A model with its weights laid out for look-up, once a task."""

    def __init__(self, model: Model, features: Features):
        self.features, self.bias = features, model.bias
        self.dense = np.zeros(1 << model.bits, np.float32)
        self.dense[model.index] = model.weight

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, index, value = self.features(raw, offsets)
        return sigmoid(np.bincount(rows, weights=self.dense[index] * value, minlength=len(offsets) - 1) + self.bias)


def score(docs: DataFrame, model: Model, features: Features, threshold: float, folds: int = 5, fold: int = 0) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) of every text.

    Null and empty texts score the bias. Repeated rows score alike; a null id is held out as the empty
    text's remainder says. Other columns are not carried. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    narrow = only(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, features)
        for batch in batches:
            for part, raw, offsets in pieces(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer(raw, offsets), pa.float64())], names=["doc_id", "score"])

    out = narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out(folds=folds, fold=fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def chosen(docs: DataFrame, model: Model, features: Features, keep: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows whose score `keep` accepts, with all their columns as they are, whatever these are called.

    Null and empty texts score the bias. Rows are decided one by one, so rows that repeat an id or a text
    stay as often as they came. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns
    at = next((i for i, c in enumerate(names) if c == "text"), None)
    at = names.index(next(c for c in names if c.lower() == "text")) if at is None else at
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, features)
        for batch in batches:
            for part, raw, offsets in pieces(batch, f"c{at}", 1 << 20):
                yield part.filter(pa.array(keep(scorer(raw, offsets))))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
