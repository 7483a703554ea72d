import json
from types import SimpleNamespace

import numpy as np
import pytest
from conftest import by, rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tabassay.operators import calibration, models, robustness, splits
from tabassay.plans import catalog_queries


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, [1, 3], (400, 2))
    y = 2 * x[:, 0] - x[:, 1] + 5 + rng.normal(0, 0.5, 400)
    data = [(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(data, "id int, a double, b double, y double").coalesce(1)


@pytest.fixture(scope="module")
def flags(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (600, 3))
    y = (rng.random(600) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))).astype(int)
    data = [(i, *map(float, r), int(c), "yes" if c else "no") for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "id int, a double, b double, c double, y int, word string").coalesce(1)
    return x, y, df


def test_linear_regression_is_least_squares(numbers):
    x, y, df = numbers
    fitted = models.fit_model({"name": "linear_regression"}, df, "y", ["a", "b"])
    exact = np.linalg.lstsq(np.c_[x, np.ones(len(x))], y, rcond=None)[0]
    assert np.allclose([*fitted.model.coefficients, fitted.model.intercept], exact, atol=1e-6)


@pytest.mark.parametrize("alpha", [0.1, 10.0])
def test_ridge_has_the_closed_form(numbers, alpha):
    x, y, df = numbers
    fitted = models.fit_model({"name": "ridge_regression", "params": {"alpha": alpha}}, df, "y", ["a", "b"])
    xc, yc = x - x.mean(0), y - y.mean()
    exact = np.linalg.solve(xc.T @ xc + alpha * np.eye(2), xc.T @ yc)
    assert np.allclose(fitted.model.coefficients.toArray(), exact, atol=1e-5)


def test_logistic_regression_minimises_the_summed_loss(flags):
    x, y, df = flags
    fitted = models.fit_model({"name": "logistic_regression", "params": {"C": 0.5}}, df, "y", ["a", "b", "c"])
    w, b = np.zeros(3), 0.0
    for _ in range(50):  # Newton
        p = 1 / (1 + np.exp(-(x @ w + b)))
        grad = np.r_[x.T @ (p - y) + w / 0.5, (p - y).sum()]
        z = np.c_[x, np.ones(len(x))]
        hess = z.T @ (z * (p * (1 - p))[:, None]) + np.diag([2.0, 2.0, 2.0, 0.0])
        step = np.linalg.solve(hess, grad)
        w, b = w - step[:3], b - step[3]
    assert np.allclose(fitted.model.coefficients.toArray(), w, atol=1e-3)


def test_text_labels_and_probability(flags):
    _, _, df = flags
    fitted = models.fit_model({"name": "logistic_regression"}, df, "word", ["a", "b", "c"])
    got = fitted.score(df)
    assert {r["yhat"] for r in rows(got.select("yhat").distinct())} == {"yes", "no"}
    measured = by(models.evaluate_model(fitted, df, "word"), "metric")
    assert measured["accuracy"]["value"] > 0.7 and measured["roc_auc"]["value"] > 0.8


def test_ladder_ranks_models_and_skips_a_failing_one(flags):
    _, _, df = flags
    parted = splits.random_split(df, "y", ["id"])
    train, val = splits.split_rows(parted, "train"), splits.split_rows(parted, "val")
    specs = [
        {"name": "logistic_regression"},
        {"name": "random_forest_classifier", "params": {"n_estimators": 10, "max_depth": 4}},
        {"name": "unheard_of"},
    ]
    trained, failed = models.train_ladder(train, val, "y", ["a", "b", "c"], specs=specs)
    assert list(failed) == ["unheard_of"]
    board = rows(models.leaderboard(df, trained).orderBy("rank"))
    assert [r["rank"] for r in board] == [1, 2]
    assert board[0]["primary_score"] >= board[1]["primary_score"] > 0.6
    assert rows(models.leaderboard(df, trained, "no_such_metric")) == []


def test_regression_ladder_ranks_by_mae(numbers):
    _, _, df = numbers
    specs = [
        {"name": "random_forest_regressor", "params": {"n_estimators": 3, "max_depth": 2}},
        {"name": "linear_regression"},
    ]
    trained, failed = models.train_ladder(df, df, "y", ["a", "b"], specs=specs)
    assert not failed
    assert rows(models.leaderboard(df, trained).orderBy("rank"))[0]["model_id"] == "linear_regression"


@pytest.mark.parametrize("name", ["ladder_classification", "ladder_regression"])
def test_ladder_queries_do_not_leave_out_a_candidate(spark, sf, monkeypatch, name):
    def fit(spec, *_):
        if "forest" in spec["name"]:
            raise error
        return models.TrainedModel("", spec, None, [], "", val_metrics=metrics)

    monkeypatch.setattr(models, "train_model", fit)
    metrics = {"accuracy": 0.5, "mae": 0.5}
    for error in (ValueError("a forest too deep"), PySparkException("a lost task of a forest")):
        with pytest.raises(Exception, match="forest"):
            catalog_queries.QUERIES[name](spark, sf)
    monkeypatch.setattr(models, "train_model", lambda spec, *_: models.TrainedModel("", spec, None, [], ""))
    with pytest.raises(RuntimeError, match="no value"):
        catalog_queries.QUERIES[name](spark, sf)


def test_ladder_raises_what_is_not_a_candidates_own(spark, numbers):
    _, _, df = numbers
    specs = [{"name": "linear_regression"}, {"name": "random_forest_regressor", "params": {"n_estimators": 2}}]
    gaps = df.withColumn("a", F.when(F.col("id") % 7 != 0, F.col("a")))
    with pytest.raises(Exception, match="(?i)null"):
        models.train_ladder(gaps, df, "y", ["a", "b"], "regression", specs)
    specs = [{"name": "linear_regression"}, {"name": "random_forest_regressor", "params": {"n_estimators": 0}}]
    trained, failed = models.train_ladder(df, df, "y", ["a", "b"], "regression", specs)
    assert [m.model_id for m in trained] == ["linear_regression"] and list(failed) == ["random_forest_regressor"]
    with pytest.raises(RuntimeError, match="No model"):
        models.train_ladder(df, df, "y", ["a", "b"], "regression", specs[1:])


def test_unknown_names(flags):
    _, _, df = flags
    with pytest.raises(ValueError, match="estimator"):
        models.fit_model({"name": "svm"}, df, "y", ["a"])
    with pytest.raises(ValueError, match="search space"):
        models.grid_search(df, "y", ["a"], "svm")


def test_grid_search(numbers, flags):
    _, _, df = numbers
    folded = splits.assign_folds(df, ["id"], 3)
    trials = models.grid_search(folded, "y", ["a", "b"], "logistic_regression")
    got = rows(trials.orderBy("rank"))
    assert len(got) == 3 and got[0]["name"] == "ridge_regression"
    assert got[0]["score"] >= got[-1]["score"] and got[0]["score"] > -1
    assert models.best_spec(trials)["params"]["alpha"] in (0.1, 1.0, 10.0)
    _, _, df = flags
    folded = splits.assign_folds(df, ["id"], 2, "y")
    space = {"n_estimators": [3], "max_depth": [2, None]}
    trials = rows(models.grid_search(folded, "y", ["a", "b", "c"], "random_forest", space=space))
    assert all(t["name"] == "random_forest_classifier" and t["score"] > 0.6 for t in trials)


def test_default_spaces():
    assert len(models._grid(models.SEARCH_SPACES["random_forest"])) == 36
    assert len(models._grid(models.SEARCH_SPACES["ridge"])) == 3


def test_forest_query_searches_the_whole_space(spark, sf, monkeypatch):
    seen = []
    model = SimpleNamespace(score_vectors=lambda held: held)
    measured = SimpleNamespace(first=lambda: {"accuracy": 0.5})
    monkeypatch.setattr(models, "fit_model", lambda spec, *_: seen.append(spec["params"]) or model)
    monkeypatch.setattr(models, "classification_metrics", lambda *_: measured)
    trials = rows(catalog_queries.QUERIES["grid_forest"](spark, sf).orderBy("trial_id"))
    space = models._grid(models.SEARCH_SPACES["random_forest"])
    assert [json.loads(t["params"]) for t in trials] == space
    assert len(seen) == 108 and all(seen.count(params) == models.FOLDS for params in space)


def test_deep_forest_is_the_same_with_kept_nodes(flags, monkeypatch):
    _, _, df = flags
    spec = {"name": "random_forest_classifier", "params": {"n_estimators": 4, "max_depth": models.KEPT_NODES_DEPTH}}
    kept = models.fit_model(spec, df, "y", ["a", "b", "c"])
    monkeypatch.setattr(models, "KEPT_NODES_DEPTH", 99)
    sought = models.fit_model(spec, df, "y", ["a", "b", "c"])
    assert kept.model.getCacheNodeIds() and not sought.model.getCacheNodeIds()
    assert kept.model.toDebugString.split("\n")[1:] == sought.model.toDebugString.split("\n")[1:]


# --- calibration ------------------------------------------------------------


def pool_adjacent(p, y):
    blocks = []
    for s in sorted(set(p)):
        blocks.append([float(y[p == s].sum()), int((p == s).sum()), [s]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1], blocks[-1][2] + a[2]]
    return {s: b[0] / b[1] for b in blocks for s in b[2]}


@pytest.fixture(scope="module")
def overconfident(spark):
    rng = np.random.default_rng(9)
    p = np.round(rng.random(2000), 2)
    p[::3] = 0.5
    y = (rng.random(2000) < 0.3 + 0.4 * p).astype(int)
    return p, y, spark.createDataFrame([(int(b), float(a)) for a, b in zip(p, y)], "y int, p double").repartition(4)


def test_isotonic_is_pool_adjacent_violators(overconfident):
    p, y, df = overconfident
    done, _ = calibration.calibrate(df)
    expected = pool_adjacent(p, y)
    for r in rows(done.select("p", "p_calibrated").distinct()):
        assert r["p_calibrated"] == pytest.approx(expected[r["p"]], abs=1e-9)


def test_calibration_improves(overconfident):
    _, _, df = overconfident
    for method in ("isotonic", "sigmoid"):
        done, _ = calibration.calibrate(df, method=method)
        got = rows(calibration.calibration_report(done))[0]
        assert got["ece_improvement"] > 0 and got["brier_improvement"] > 0
    with pytest.raises(ValueError):
        calibration.calibrate(df, method="other")


def test_sigmoid_has_the_smoothed_optimum(overconfident):
    p, y, df = overconfident
    _, fitted = calibration.calibrate(df, method="sigmoid")
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.zeros(2)
    z = np.c_[p, np.ones(len(p))]
    for _ in range(50):
        q = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (q * (1 - q))[:, None]), z.T @ (q - t))
    assert fitted.model.coefficients[0] == pytest.approx(w[0], abs=1e-3)
    assert fitted.model.intercept == pytest.approx(w[1], abs=1e-3)


def test_no_probability_no_calibration(spark):
    df = spark.createDataFrame([(1, 1)], "y int, yhat int")
    assert calibration.calibrate(df) == (df, None)


# --- robustness -------------------------------------------------------------


def test_ablation_finds_the_useful_feature(flags):
    _, _, df = flags
    fitted = models.fit_model(
        {"name": "random_forest_classifier", "params": {"n_estimators": 20, "max_depth": 4}}, df, "y", ["a", "b", "c"]
    )
    weights = fitted.importances()
    assert sum(weights.values()) == pytest.approx(1) and max(weights, key=weights.get) == "a"
    got = by(robustness.ablation(df, fitted, "y", 2), "feature")
    assert set(got) == set(sorted(weights, key=weights.get)[-2:])
    assert got["a"]["performance_drop"] > 0.1
    summary = rows(robustness.drop_summary(robustness.ablation(df, fitted, "y", 2)))[0]
    assert summary["max_performance_drop"] == pytest.approx(got["a"]["performance_drop"])


def test_ablated_score_is_the_score_on_the_ablated_table(numbers):
    from tabassay.operators.metrics import regression_metrics

    _, _, df = numbers
    fitted = models.fit_model({"name": "linear_regression"}, df, "y", ["a", "b"])
    got = by(robustness.ablation(df, fitted, "y"), "feature")
    assert [r["importance"] for r in got.values()] == [1.0, 1.0]
    direct = rows(regression_metrics(fitted.score(robustness.ablate(df, "b")), "y", "yhat"))[0]["mae"]
    assert got["b"]["ablated_score"] == pytest.approx(direct)
    assert got["b"]["performance_drop"] == pytest.approx(direct - got["b"]["baseline_score"])


def test_shocks_are_repeatable(numbers):
    from tabassay.operators.metrics import regression_metrics

    _, _, df = numbers
    fitted = models.fit_model({"name": "linear_regression"}, df, "y", ["a", "b"])
    got = by(robustness.shock_tests(df, fitted, "y", ["id"]), "test")
    again = by(robustness.shock_tests(df.repartition(5), fitted, "y", ["id"]), "test")
    for test in ("missing_values", "noise_injection"):
        assert got[test]["score"] == pytest.approx(again[test]["score"])
    shocked = robustness.missing_shock(df, ["a", "b"], ["id"])
    direct = rows(regression_metrics(fitted.score(shocked), "y", "yhat"))[0]["mae"]
    assert got["missing_values"]["score"] == pytest.approx(direct)
    changed = shocked.join(df.select("id", F.col("a").alias("was")), "id").where("a <> was").count()
    assert 20 < changed < 65


@pytest.mark.parametrize(
    "passed, grade", [([True, True], "A"), ([True, False], "C"), ([True] * 3 + [False], "B"), ([False] * 2, "D"), ([], "C")]
)
def test_grades(spark, passed, grade):
    df = spark.createDataFrame([(p,) for p in passed], "passed boolean")
    assert rows(robustness.grade(df))[0]["resilience_grade"] == grade


def test_ablate_text_takes_the_mode(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "t string")
    assert {r["t"] for r in rows(robustness.ablate(df, "t"))} == {"a"}


def test_a_forest_gets_partitions_by_its_rows(spark, monkeypatch):
    few = spark.range(4000).select((F.col("id") % 13).alias("x"), (F.col("id") % 2).alias("y")).coalesce(1).cache()
    assert models.dealt(few, 10, 1).rdd.getNumPartitions() == 1
    monkeypatch.setattr(models, "TASK_BYTES", 64_000)
    out = models.dealt(few, 10, 1)
    assert out.rdd.getNumPartitions() == 9 and out.count() == 4000
    seen = []
    monkeypatch.setattr(models, "dealt", lambda df, trees, width: seen.append((trees, width)) or df)
    models.fit_model({"name": "random_forest_classifier", "params": {"n_estimators": 3, "max_depth": 2}}, few, "y", ["x"])
    folded = few.withColumn("fold", (F.col("x") % 2).cast("int"))
    models.grid_search(folded, "y", ["x"], "random_forest", "classification", {"n_estimators": [2, 4], "max_depth": [2]})
    assert seen == [(3, 1), (4, 1)]
    models.fit_model({"name": "logistic_regression"}, few, "y", ["x"])
    assert len(seen) == 2
