"""Match classifiers with MLlib: training, cross-validated tuning, importance, ablation by feature family."""

from __future__ import annotations

import itertools
from multiprocessing.pool import ThreadPool

import xxhash
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from tessera.operators.evaluate import metrics
from tessera.operators.features import families
from tessera.sources.scratch import stored

SEED = 42
#: Values a tuning run draws from.
GRIDS = {
    "logistic_regression": {"regParam": [0.0, 1e-4, 1e-3, 1e-2, 0.1], "elasticNetParam": [0.0, 0.5, 1.0]},
    "random_forest": {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 15], "minInstancesPerNode": [1, 2, 5]},
    "boosted_trees": {"maxIter": [20, 50], "maxDepth": [3, 5, 7], "stepSize": [0.05, 0.1, 0.2]},
    "support_vectors": {"regParam": [0.0, 1e-3, 1e-2, 0.1]},
}


def f1() -> MulticlassClassificationEvaluator:
    """Of the matches; made when a session is there."""
    return MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0)


def classifiers() -> dict:
    """support_vectors is linear: MLlib has no kernel machine."""
    return {
        "logistic_regression": LogisticRegression(maxIter=100),
        "random_forest": RandomForestClassifier(numTrees=100, seed=SEED),
        "support_vectors": LinearSVC(maxIter=50),
        "boosted_trees": GBTClassifier(maxIter=20, seed=SEED),
    }


def numeric(df: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """Features as doubles, missing or odd ones 0."""
    return df.select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns), F.col(label).cast("double").alias("label"), *(c for c in ("train",) if c in df.columns))


def pipeline(model, columns: list[str]) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features"), model])


def assess(predicted: DataFrame) -> dict[str, float]:
    score = vector_to_array("probability")[1] if "probability" in predicted.columns else F.col("prediction")
    row = predicted.select("prediction", "label", score.alias("s")).agg(*metrics(F.col("prediction"), F.col("label"), F.lit(0.5))).first()
    return {k: row[k] for k in ("accuracy", "precision", "recall", "f1_score")} | {"roc_auc": BinaryClassificationEvaluator().evaluate(predicted)}


def train(df: DataFrame, columns: list[str], names: list[str] | None = None) -> dict[str, tuple]:
    """Each classifier's fitted pipeline and test metrics; df: numeric() with the column train."""
    fit, test = df.where("train").cache(), df.where("not train").cache()
    out = {}
    for name in names or list(classifiers()):
        model = pipeline(classifiers()[name], columns).fit(fit)
        out[name] = model, assess(model.transform(test))
    return out


def draws(name: str, n: int) -> list[dict]:
    """n different settings, the same ones each time."""
    grid = GRIDS[name]
    every = [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]
    return sorted(every, key=lambda s: xxhash.xxh64_intdigest(repr(sorted(s.items())), seed=SEED))[:n]


def _scaler(df: DataFrame, columns: list[str]) -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features")]).fit(df)


def _ready(rows: DataFrame, columns: list[str], scaler: PipelineModel, whole: bool = False) -> DataFrame:
    """Scaled ``features, label, weight``: equal rows as one that weighs as many, or each by itself."""
    counted = rows.withColumn("weight", F.lit(1.0)) if whole else rows.groupBy(*columns, "label").agg(F.count("*").cast("double").alias("weight"))
    return stored(scaler.transform(counted).select("features", "label", "weight"))


def _fits(rows: DataFrame, columns: list[str], name: str, settings: list[dict], scored: DataFrame | None = None, parallelism: int = 4) -> list[tuple[PipelineModel, float | None]]:
    """For each setting the pipeline fitted on the rows and, if there are rows to score, its F1 on them.

    Rows are scaled and equal ones counted once for all settings. A loss is a sum over rows, so weights stand for copies exactly; features have one
    scale already, so the model's own scaling is left out, whose variances take weights otherwise. A forest draws rows and counts those of a leaf: it gets each row.
    """
    scaler, model = _scaler(rows, columns), classifiers()[name]
    forest = name == "random_forest"
    fit, test = _ready(rows, columns, scaler, forest), scored and _ready(scored, columns, scaler)
    fit.cache(), test and test.cache()
    own = {} if forest else {model.weightCol: "weight"} | ({model.standardization: False} if model.hasParam("standardization") else {})

    def one(setting: dict) -> tuple[PipelineModel, float | None]:
        fitted = model.fit(fit, own | {model.getParam(k): v for k, v in setting.items()})
        return PipelineModel([*scaler.stages, fitted]), test and f1().setWeightCol("weight").evaluate(fitted.transform(test))

    with ThreadPool(parallelism) as pool:
        out = pool.map(inheritable_thread_target(rows.sparkSession)(one), settings)
    fit.unpersist(), test and test.unpersist()
    return out


def _fold_f1(df: DataFrame, columns: list[str], name: str, settings: list[dict], folds: int, parallelism: int) -> list[float]:
    """Each setting's mean F1 over the folds."""
    rows = stored(df.select(*columns, "label").withColumn("_fold", F.floor(F.rand(SEED) * folds)))
    one = lambda k: [f for _, f in _fits(rows.where(F.col("_fold") != k), columns, name, settings, rows.where(F.col("_fold") == k), parallelism)]
    with ThreadPool(max(1, parallelism // len(settings))) as pool:
        each = pool.map(inheritable_thread_target(df.sparkSession)(one), range(folds))
    return [sum(f) / folds for f in zip(*each, strict=True)]


def cross_validate(df: DataFrame, columns: list[str], name: str, n: int = 20, folds: int = 3, parallelism: int = 4) -> tuple[PipelineModel, list[tuple[dict, float]]]:
    """The best of n drawn settings by F1 over the folds: model and mean F1 of each setting."""
    df = stored(df)
    settings = draws(name, n)
    found = _fold_f1(df, columns, name, settings, folds, parallelism)
    (model, _), = _fits(df, columns, name, [settings[max(range(len(found)), key=found.__getitem__)]])
    return model, list(zip(settings, found, strict=True))


def folded_f1(df: DataFrame, columns: list[str], name: str, folds: int = 5, parallelism: int = 4) -> float:
    """Mean F1 over the folds of a classifier with its own settings."""
    return _fold_f1(df, columns, name, [{}], folds, parallelism)[0]


def importance(fitted, columns: list[str]) -> dict[str, float]:
    """Of trees as they tell it, of linear models the size of coefficients."""
    model = fitted.stages[-1]
    values = model.featureImportances.toArray() if hasattr(model, "featureImportances") else abs(model.coefficients.toArray())
    return dict(zip(columns, map(float, values), strict=True))


def mean_importance(df_session, models: dict[str, tuple], columns: list[str], top: int = 20) -> DataFrame:
    rows = [(m, c, v) for m, (fitted, _) in models.items() for c, v in importance(fitted, columns).items()]
    each = df_session.createDataFrame(rows, "model string, feature string, importance double")
    return each.groupBy("feature").agg(F.avg("importance").alias("importance"), F.stddev_pop("importance").alias("spread")).orderBy(F.desc("importance"), "feature").limit(top)


def ablation(df: DataFrame, columns: list[str], name: str = "random_forest") -> dict[str, dict[str, float]]:
    """Test metrics of one classifier on each feature family alone."""
    return {family: train(df, own, [name])[name][1] for family, own in families(columns).items() if own}


def best(results: dict[str, tuple]) -> str:
    return max(results, key=lambda k: (results[k][1]["f1_score"], k))


def save(models: dict[str, PipelineModel], path: str) -> None:
    """Each fitted pipeline below ``path``, written over what was there."""
    for name, model in models.items():
        model.write().overwrite().save(f"{path.rstrip('/')}/{name}")


def load(path: str, names: list[str]) -> dict[str, PipelineModel]:
    return {name: PipelineModel.load(f"{path.rstrip('/')}/{name}") for name in names}
