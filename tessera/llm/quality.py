"""Quality scores: random Fourier features over document statistics, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow, join_small, stored, texts_of

#: Random features, width of the Gaussian kernel in standard deviations, ridge penalty, seed.
FEATURES, WIDTH, PENALTY, SEED = 256, 3.0, 1e-3, 7
#: Bins of raw scores over LOW..HIGH that calibration pools.
BINS, LOW, HIGH = 2000, -0.5, 1.5
#: A document is kept from this score on.
KEEP = 0.3
_CLASS = np.zeros(256, np.int64)  # 0 other ASCII signs, 1 upper, 2 lower, 3 digit, 4 white space, 5 beyond ASCII, 6 !, 7 |, 8 signs that rarely end words, 9 . and ,
for _codes, _kind in (((range(65, 91)), 1), (range(97, 123), 2), (range(48, 58), 3), ((9, 10, 11, 12, 13, 32), 4), (range(128, 256), 5), ((33,), 6), ((124,), 7), (b"#$%&*=<>~^@", 8), (b".,", 9)):
    _CLASS[list(_codes)] = _kind
STATISTICS = 20


def statistics(text: str) -> list[float]:
    """Statistics of a whole text, each finite, for any text."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = np.bincount(_CLASS, weights=np.bincount(raw, minlength=256), minlength=10)
    total, cased = max(1.0, n.sum()), max(1.0, n[1] + n[2])
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    count = max(1, len(words))
    distinct = len(set(words))
    repeats = sum(map(eq, words, words[1:]))
    length = total / count
    return [
        np.log1p(len(text)), n[1] / cased, n[3] / total, n[4] / total, n[0] / total, n[5] / total,
        *np.sqrt([n[6] / count, n[7] / count, n[8] / count, n[9] / count, repeats / count]),
        distinct / count, np.log1p(distinct), np.log1p(len(words)), min(length, 40.0),
        np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), count / max(1, len(lines)) / (50 + count / max(1, len(lines))),
        float(len(words) == 0), min(5.0, repeats),
    ]


def measured(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and its statistics ``x``; null and empty texts have those of no text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return arrow(docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")), measure, "doc_id long, x array<double>")


def held_out(id: str = "doc_id"):
    """The fold that is never learnt from; no id, no fold."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Kernel:
    """Standardised statistics to cosines whose products approximate a Gaussian kernel."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.RandomState(SEED)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w, self.b = rng.normal(size=(STATISTICS, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(np.clip((x - self.mean) / self.spread, -6, 6) @ self.w + self.b) * np.sqrt(2 / FEATURES)
        return np.hstack([z, np.ones((len(x), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


def _gram(rows: DataFrame, kernel: Kernel) -> np.ndarray:
    """Sums of products of (features, label) over all rows; one row of the matrix at a time goes through the shuffle."""
    size = FEATURES + 2

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            z = np.hstack([kernel(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False).reshape(-1, 1)])
            total += z.T @ z
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "v"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(v)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([r.tobytes() for r in total.values()], pa.binary())], names=["i", "v"])

    schema = "i int, v binary"
    parts = arrow(arrow(rows.select("x", F.col("y").cast("double")), products, schema).repartition("i"), summed, schema)
    out = np.zeros((size, size))
    for i, v in parts.collect():  # FEATURES + 2 rows
        out[i] = np.frombuffer(v)
    return out


def pooled(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted isotonic regression by pooling adjacent violators."""
    value: list[float] = []
    mass: list[float] = []
    length: list[int] = []
    for v, w in zip(y, weight, strict=True):
        value.append(v)
        mass.append(w)
        length.append(1)
        while len(value) > 1 and value[-2] >= value[-1]:
            m = mass[-2] + mass[-1]
            value[-2] = (value[-2] * mass[-2] + value[-1] * mass[-1]) / m
            mass[-2] = m
            length[-2] += length[-1]
            value.pop(), mass.pop(), length.pop()
    return np.repeat(value, length)


class Model:
    def __init__(self, kernel: Kernel, weights: np.ndarray, at: np.ndarray, level: np.ndarray):
        self.kernel, self.weights, self.at, self.level = kernel, weights, at, level

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.kernel(x) @ self.weights, LOW, HIGH)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        level = np.interp(raw, self.at, self.level) if len(self.at) else np.clip(raw, 0, 1)
        return np.clip(0.999 * level + 0.001 * (raw - LOW) / (HIGH - LOW), 0, 1)  # within a pooled block the raw score decides


def fit(stats: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "quality") -> Model:
    """stats: from measured(), stored. Learns from the labelled rows outside the held-out fold; rows with a null label or id are no rows."""
    moments = stats.select(F.posexplode("x")).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).collect()  # one row a statistic
    mean, spread = np.zeros(STATISTICS), np.ones(STATISTICS)
    for r in moments:
        mean[r.pos], spread[r.pos] = r.m, r.s
    kernel = Kernel(mean, spread)
    known = labels.select(F.col(id).cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    rows = stored(join_small(stats, stored(known), "doc_id").select("x", "y"))
    gram = _gram(rows, kernel)
    k = FEATURES + 1
    n = max(1.0, gram[k - 1, k - 1])
    weights = np.linalg.solve(gram[:k, :k] + PENALTY * n / FEATURES * np.eye(k), gram[:k, k])
    model = Model(kernel, weights, np.zeros(0), np.zeros(0))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = ((model.raw(_matrix(batch.column(0))) - LOW) / (HIGH - LOW) * (BINS - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(1)], names=["bin", "y"])

    bins = sorted(map(tuple, arrow(rows, binned, "bin int, y double").groupBy("bin").agg(F.avg("y"), F.count("*")).collect()))  # BINS rows at most
    if bins:
        at, y, n = (np.array(c, float) for c in zip(*bins, strict=True))
        model.at, model.level = LOW + (at + 0.5) / (BINS - 1) * (HIGH - LOW), pooled(y, n)
    return model


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for each row of statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value(_matrix(batch.column(1))), pa.float64())], names=["doc_id", "score"])

    return arrow(stats.select("doc_id", "x"), score, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``. Without any label all scores are 0 or near it.

    Null and empty texts have the score of no text; equal texts have equal scores. Equal rows, rows with one id and rows without an id are scored by
    themselves; of several labels of an id each counts. Other columns are left out.
    """
    stats = stored(measured(docs, id, text))
    return scored(stats, fit(stats, labels, id, label)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def with_score(docs: DataFrame, model: Model, *, text: str = "text", score: str = "score") -> DataFrame:
    """The rows of ``docs`` and their score, in one pass over the texts; a column of that name is replaced."""
    names = [c for c in docs.columns if c != score]
    at, shared = names.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in texts_of(batch.column(at))]).reshape(-1, STATISTICS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value(x), pa.float64())], names=[*names, score])

    return arrow(docs.select(*names), add, docs.select(*names).schema.add(score, "double"))
