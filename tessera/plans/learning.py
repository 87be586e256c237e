"""Queries for learned matching; trained models have no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import cities, features, learning
from tessera.operators.pairs import stratified_split
from tessera.plans.base import query, table
from tessera.plans.matching import scores
from tessera.sources.scratch import stored


def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Labelled name pairs with scores and statistics."""
    rows = scores(spark, sf_dir)
    a, b = F.col("a"), F.col("b")
    wide = rows.select("brand", "a", "b", "label", F.col("levenshtein").alias("phase2_levenshtein"), F.col("jaccard").alias("phase2_jaccard"), *(c.alias(k) for k, c in features.statistics(a, b).items()), *(c.alias(k) for k, c in features.interactions(F.col("levenshtein"), F.col("jaccard"), F.lit(0.0)).items()))
    names = [c for c in wide.columns if c not in ("brand", "a", "b", "label")]
    return learning.numeric(stratified_split(wide, "label", "brand", "a", "b"), names), names


def _trained(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    df, columns = _features(spark, sf_dir)
    out = learning.train(df, columns, names)
    return spark.createDataFrame([(n, *(float(m[k]) for k in ("accuracy", "precision", "recall", "f1_score", "roc_auc"))) for n, (_, m) in out.items()], "model string, accuracy double, precision double, recall double, f1_score double, roc_auc double")


def _tuned(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df, columns = _features(spark, sf_dir)
    _, found = learning.cross_validate(df.where("train"), columns, name)
    return spark.createDataFrame([(str(sorted(s.items())), float(f)) for s, f in found], "setting string, f1_score double")


@query()
def train_logistic_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir, ["logistic_regression"])


@query()
def train_support_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir, ["support_vectors"])


@query()
def train_random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir, ["random_forest"])


@query()
def train_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir, ["boosted_trees"])


@query()
def tuned_logistic_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tuned(spark, sf_dir, "logistic_regression")


@query()
def tuned_random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tuned(spark, sf_dir, "random_forest")


@query()
def tuned_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tuned(spark, sf_dir, "boosted_trees")


@query()
def tuned_support_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tuned(spark, sf_dir, "support_vectors")


@query()
def folded_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, columns = _features(spark, sf_dir)
    df = stored(df)
    return spark.createDataFrame([(n, float(learning.folded_f1(df.where("train"), columns, n))) for n in learning.classifiers()], "model string, f1_score double")


@query()
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, columns = _features(spark, sf_dir)
    return learning.mean_importance(spark, learning.train(df, columns), columns)


@query()
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, columns = _features(spark, sf_dir)
    return spark.createDataFrame([(k, float(m["f1_score"])) for k, m in learning.ablation(df, columns).items()], "family string, f1_score double")


@query()
def city_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "nation").select(F.concat(F.lit("Vila Nova "), F.col("n_name")).alias("name"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Vla Nova NATION_"), F.col("c_nationkey").cast("string")).alias("city"))
    return cities.repair(rows, "city", known)


@query()
def similar_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cities.name_groups(cities.similar_names(table(spark, sf_dir, "part"), "p_name", 200, 0.7))
