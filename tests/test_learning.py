"""The learning queries do what their operators do by default; the operators are replaced, as the whole jobs take minutes."""

import pytest
from pyspark.ml.classification import LogisticRegression

from tessera.operators import learning
from tessera.plans import catalog


def test_queries_do_the_whole_job(spark, data, monkeypatch):
    met = []

    def tuned(df, columns, name, n=20, folds=3):
        met.append(("tuned", name, n, folds))
        return None, [(s, 0.5) for s in learning.draws(name, n)]

    def trained(df, columns, names=None):
        met.append(("trained", *(names or learning.classifiers())))
        return {k: (None, {"f1_score": 0.5}) for k in names or learning.classifiers()}

    monkeypatch.setattr(learning, "cross_validate", tuned)
    monkeypatch.setattr(learning, "train", trained)
    monkeypatch.setattr(learning, "folded_f1", lambda df, columns, name, folds=5: met.append(("folded", name, folds)) or 0.5)
    monkeypatch.setattr(learning, "importance", lambda fitted, columns: dict.fromkeys(columns, 1.0))
    found = catalog.queries()
    for name, settings in (("logistic_regression", 15), ("random_forest", 20), ("boosted_trees", 18), ("support_vectors", 4)):
        assert found[f"tuned_{name}"](spark, data).count() == settings
        assert met.pop() == ("tuned", name, 20, 3)
    found["feature_importance"](spark, data)
    assert met.pop() == ("trained", "logistic_regression", "random_forest", "support_vectors", "boosted_trees")
    assert found["folded_f1"](spark, data).count() == 4 and {m[2] for m in met} == {5}
    met.clear()
    found["ablation"](spark, data)
    assert met and set(met) == {("trained", "random_forest")}


class Counting(LogisticRegression):
    met = []

    def _fit(self, rows):
        Counting.met.append(rows.count())
        return super()._fit(rows)


def test_tuning_meets_equal_rows_once_and_fits_as_on_all(spark, monkeypatch):
    rows = [(k % 13 / 13, k * 7 % 11 / 11, float(k % 13 + k * 7 % 5 > 8)) for k in range(60)]
    df = spark.createDataFrame(rows * 40, "x double, y double, label double")
    own = LogisticRegression(maxIter=100)
    monkeypatch.setattr(learning, "classifiers", lambda: {"logistic_regression": Counting(maxIter=100)})
    model, found = learning.cross_validate(df, ["x", "y"], "logistic_regression", n=4, folds=3)
    assert [s for s, _ in found] == learning.draws("logistic_regression", 4) and all(0 <= f <= 1 for _, f in found)
    assert Counting.met and max(Counting.met) <= 60
    best = max(found, key=lambda x: x[1])[0]
    plain = learning.pipeline(own.copy({own.getParam(k): v for k, v in best.items()}), ["x", "y"]).fit(df)
    assert list(model.stages[-1].coefficients) == pytest.approx(list(plain.stages[-1].coefficients), abs=1e-3, rel=1e-3)
    each = lambda m: [r.prediction for r in m.transform(spark.createDataFrame(rows, df.schema)).collect()]
    assert each(model) == each(plain)
    assert 0 <= learning.folded_f1(df, ["x", "y"], "logistic_regression", 3) <= 1
