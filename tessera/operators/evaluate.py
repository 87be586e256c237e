"""Scores of labelled pairs to metrics, thresholds, weights and rankings: one aggregation each."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.similarity import GRADE_MATCH, GRADE_WEIGHTS, weighted

#: Steps of 0.05 from 0.1 to 0.95.
GRID = [0.1 + 0.05 * k for k in range(18)]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def metrics(score: Column, label: Column, threshold: Column) -> list[Column]:
    """Aggregates of one pass: confusion matrix, mean score by class, and what follows; 0 where a division has nothing to divide by."""
    hit, match = F.coalesce(score, F.lit(0.0)) >= threshold, label == 1
    tp, fp, fn, tn = (F.count_if(c).cast("double") for c in (hit & match, hit & ~match, ~hit & match, ~hit & ~match))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    pos, neg = (F.coalesce(F.avg(F.when(c, score)), F.lit(0.0)) for c in (match, ~match))
    return [
        precision.alias("precision"), recall.alias("recall"), f1.alias("f1_score"), _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        *(c.cast("long").alias(n) for c, n in ((tp, "true_positives"), (fp, "false_positives"), (fn, "false_negatives"), (tn, "true_negatives"))),
        pos.alias("mean_similarity_positive"), neg.alias("mean_similarity_negative"), (pos - neg).alias("similarity_separation"),
    ]


def evaluate(scores: DataFrame, threshold: float) -> DataFrame:
    """scores: score, label."""
    return scores.agg(*metrics(F.col("score"), F.col("label"), F.lit(threshold)))


def long_scores(pairs: DataFrame, names: list[str]) -> DataFrame:
    """Wide score columns to rows (label, algorithm, score)."""
    return pairs.select("label", F.explode(F.array(*(F.struct(F.lit(n).alias("algorithm"), F.col(n).alias("score")) for n in names))).alias("s")).select("label", "s.*")


def threshold_sweep(scores: DataFrame, grid: list[float] = GRID) -> DataFrame:
    """Metrics of each algorithm at each threshold; scores: algorithm, score, label. The grid has a few rows, so each score makes as many."""
    rows = scores.withColumn("threshold", F.explode(F.array(*map(F.lit, grid))))
    return rows.groupBy("algorithm", "threshold").agg(*metrics(F.col("score"), F.col("label"), F.col("threshold")))


def best_thresholds(sweep: DataFrame) -> DataFrame:
    """The threshold of the highest F1, the lowest of equal ones."""
    return sweep.groupBy("algorithm").agg(F.max(F.struct(F.col("f1_score"), (-F.col("threshold")).alias("t"))).alias("m")).select("algorithm", (-F.col("m.t")).alias("threshold"), F.col("m.f1_score").alias("f1_score"))


def ranking(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("f1_score"), "algorithm")


def weight_vectors(n: int) -> list[tuple[float, ...]]:
    """Two scores: ninths of ten; three: fifths with at least a fifth for the last."""
    if n == 2:
        return [(k / 10, (10 - k) / 10) for k in range(1, 10)]
    if n == 3:
        return [(a / 10, b / 10, (10 - a - b) / 10) for a, b in product((2, 4, 6), repeat=2) if 10 - a - b > 1]
    raise ValueError("two or three scores")


def weight_grid(pairs: DataFrame, names: list[str], threshold: float = 0.75) -> DataFrame:
    """Metrics of the weighted scores ``names`` for each weight vector, in one pass."""
    vectors = F.array(*(F.array(*map(F.lit, v)) for v in weight_vectors(len(names))))
    score = sum((F.coalesce(F.col(n), F.lit(0.0)) * F.get(F.col("w"), k) for k, n in enumerate(names)), F.lit(0.0))
    rows = pairs.select("label", *names, F.explode(vectors).alias("w"))
    return rows.groupBy("w").agg(*metrics(score, F.col("label"), F.lit(threshold))).select(*(F.round(F.get("w", k), 1).alias(f"weight_{n}") for k, n in enumerate(names)), "precision", "recall", "f1_score")


def hybrid_scores(pairs: DataFrame, hybrids: dict[str, dict[str, float]]) -> DataFrame:
    """A column for each hybrid of scores that ``pairs`` has."""
    return pairs.select("*", *(weighted(w, {k: F.col(k) for k in w}).alias(n) for n, w in hybrids.items()))


def first_hits(results: DataFrame, query: str = "query_id", rank: str = "rank", hit: str = "is_match") -> DataFrame:
    """The rank of each query's first match, null without one."""
    return results.groupBy(query).agg(F.min(F.when(F.col(hit), F.col(rank))).alias("first_match"))


def top_k_accuracy(results: DataFrame, ks: tuple[int, ...] = (1, 3, 5), **names: str) -> DataFrame:
    return first_hits(results, **names).agg(F.count("*").alias("queries"), *(F.avg(F.when(F.col("first_match") <= k, 1.0).otherwise(0.0)).alias(f"top_{k}") for k in ks))


def graded_match(grades: dict[str, Column], expected: dict[str, Column]) -> tuple[Column, Column]:
    """Weighted grade over the components that are expected, and whether it is a match; nothing expected is none."""
    asked = {k: F.when(expected[k].isNotNull() & (expected[k] != ""), GRADE_WEIGHTS[k]).otherwise(0.0) for k in grades}
    total = sum(asked.values(), F.lit(0.0))
    grade = F.when(total > 0, sum((asked[k] * F.coalesce(grades[k], F.lit(0.0)) for k in grades), F.lit(0.0)) / total).otherwise(0.0)
    return grade, (total > 0) & (grade >= GRADE_MATCH)


def strict_match(found: dict[str, Column], expected: dict[str, Column], least: float = 0.7) -> Column:
    """At least that share of the expected components: postcodes equal, others contained. Nothing expected is a match."""
    asked, right = F.lit(0), F.lit(0)
    for k, want in expected.items():
        there = want.isNotNull() & (want != "")
        same = found[k] == want if k == "postcode" else F.lower(found[k]).contains(F.lower(want))
        asked = asked + F.when(there, 1).otherwise(0)
        right = right + F.when(there & F.coalesce(same, F.lit(False)), 1).otherwise(0)
    return F.when(asked == 0, True).otherwise(right >= asked * least)


def breakdown(results: DataFrame, by: str) -> DataFrame:
    """Successful queries by a column: how many, mean latency, share with a match at first place."""
    return results.where("success").groupBy(by).agg(F.count("*").alias("queries"), F.avg("latency").alias("mean_latency"), F.avg(F.col("top_1").cast("double")).alias("top_1"))


def accuracy_proxy(got: Column, expected: Column) -> Column:
    return F.when(expected > 0, F.least(F.lit(1.0), got / expected)).otherwise(F.when(got == 0, 1.0).otherwise(0.0))


def grid_frame(spark: SparkSession, grid: list[float] = GRID) -> DataFrame:
    return spark.createDataFrame([(float(t),) for t in grid], "threshold double")


def search_test_cases(rows: DataFrame, top: int = 20) -> DataFrame:
    """Queries with what they should find, from the ``top`` commonest addresses (street, number, postcode, city): whole and in part."""
    keys = ["street", "number", "postcode", "city"]
    common = rows.where("street is not null and city is not null").groupBy(*keys).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), *(F.asc_nulls_last(k) for k in keys)).limit(top)
    kinds = F.array(F.struct(F.lit("exact").alias("category"), F.lit("easy").alias("difficulty"), F.concat_ws(", ", "street", "number", "city").alias("query")), F.struct(F.lit("partial").alias("category"), F.lit("medium").alias("difficulty"), F.concat_ws(" ", "street", "city").alias("query")))
    return common.select(F.explode(kinds).alias("c"), "street", "city").select("c.*", F.col("street").alias("expected_street"), F.col("city").alias("expected_city"))
