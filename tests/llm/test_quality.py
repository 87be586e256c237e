import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import quality as Q


def test_held_out_accuracy(spark, data):
    docs, labels = (spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.classify(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    test = [r for r in rows if r.held_out]
    good, bad = ([r.score for r in test if r.quality == q] for q in (1, 0))
    auc = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    assert auc > 0.97
    assert np.mean([r.predicted == r.quality for r in test]) > 0.93
    assert np.mean([s >= Q.KEEP for s in good]) > 0.98


def test_scores_are_those_of_a_plain_fit(spark, data):
    """The same model by numpy alone: no sums over partitions, no shuffles."""
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r.score for r in Q.classify(docs.repartition(5), labels).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    x = {k: np.array(Q.statistics(t)) for k, t in texts.items()}
    every = np.array(list(x.values()))
    spread = every.std(axis=0)
    known = [(x[r.doc_id], r.quality) for r in labels.collect() if r.quality is not None and r.doc_id in x and zlib.crc32(str(r.doc_id).encode()) % 5]
    rng = np.random.RandomState(Q.SEED)
    w, b = rng.normal(size=(Q.STATISTICS, Q.FEATURES)) / Q.WIDTH, rng.uniform(0, 2 * np.pi, Q.FEATURES)
    features = lambda m: np.c_[np.cos(np.clip((m - every.mean(axis=0)) / np.where(spread > 1e-9, spread, 1), -6, 6) @ w + b) * np.sqrt(2 / Q.FEATURES), np.ones(len(m))]
    z, y = features(np.array([k for k, _ in known])), np.array([q for _, q in known], float)
    weights = np.linalg.solve(z.T @ z + Q.PENALTY * len(y) / Q.FEATURES * np.eye(Q.FEATURES + 1), z.T @ y)
    raw = lambda m: np.clip(features(m) @ weights, Q.LOW, Q.HIGH)
    bins = ((raw(np.array([k for k, _ in known])) - Q.LOW) / (Q.HIGH - Q.LOW) * (Q.BINS - 1)).astype(int)
    at = np.unique(bins)
    mean, mass = np.array([y[bins == k].mean() for k in at]), np.array([(bins == k).sum() for k in at])
    # isotonic regression by its definition: the largest mean that begins before, of the least that end behind
    total, size = np.r_[0, np.cumsum(mean * mass)], np.r_[0, np.cumsum(mass)]
    level = [max(min((total[j] - total[i]) / (size[j] - size[i]) for j in range(k + 1, len(at) + 1)) for i in range(k + 1)) for k in range(len(at))]
    score = lambda r: 0.999 * np.interp(r, Q.LOW + (at + 0.5) / (Q.BINS - 1) * (Q.HIGH - Q.LOW), level) + 0.001 * (r - Q.LOW) / (Q.HIGH - Q.LOW)
    want = dict(zip(x, np.clip(score(raw(every)), 0, 1), strict=True))
    assert found.keys() == want.keys() and max(abs(found[k] - want[k]) for k in want) < 1e-6


def test_pooling():
    rng = random.Random(1)
    for _ in range(50):
        n = rng.randint(1, 30)
        y, w = np.array([rng.random() for _ in range(n)]), np.array([rng.randint(1, 5) for _ in range(n)], float)
        fit = Q.pooled(y, w)
        assert (np.diff(fit) >= 0).all() and np.isclose((fit * w).sum(), (y * w).sum())
        best = ((fit - y) ** 2 * w).sum()
        for _ in range(50):
            other = np.sort(fit + rng.choice([1e-2, 0.1]) * np.array([rng.gauss(0, 1) for _ in range(n)]))
            assert ((other - y) ** 2 * w).sum() >= best - 1e-9


def test_features_approximate_the_kernel():
    rng = np.random.RandomState(2)
    x = rng.normal(size=(40, Q.STATISTICS))
    z = Q.Kernel(np.zeros(Q.STATISTICS), np.ones(Q.STATISTICS))(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 2 / Q.WIDTH**2)
    assert np.abs(z @ z.T - exact).mean() < 0.06


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "\x00" * 10), (4, "a" * 200_000), (None, "some words"), (5, "some words"), (5, "some words"), (6, "\n\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (5, 1), (5, 1), (None, 1), (3, None)], "doc_id long, quality int")
    found = Q.classify(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert all(np.isfinite(Q.statistics(t or "")).all() and len(Q.statistics(t or "")) == Q.STATISTICS for _, t in rows)
    assert Q.classify(docs.limit(0), labels).count() == 0
    assert Q.classify(docs, labels.limit(0)).count() == len(rows)
