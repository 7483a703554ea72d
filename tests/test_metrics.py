import math

import numpy as np
import pytest
from conftest import by, rows
from pyspark.sql import functions as F

from tabassay.operators import bootstrap, curves, fairness, metrics


def scored(spark, data):
    return spark.createDataFrame(data, "y int, yhat int")


def weighted_by_hand(y, g):
    y, g = np.array(y), np.array(g)
    out = {"accuracy": (y == g).mean(), "f1_score": 0.0, "precision": 0.0, "recall": 0.0}
    for c in set(y):
        tp, pred, sup = ((y == c) & (g == c)).sum(), (g == c).sum(), (y == c).sum()
        p, r = tp / pred if pred else 0.0, tp / sup
        out["precision"] += p * sup / len(y)
        out["recall"] += r * sup / len(y)
        out["f1_score"] += (2 * p * r / (p + r) if p + r else 0.0) * sup / len(y)
    return out


@pytest.mark.parametrize(
    "y, g",
    [
        ([0, 0, 1, 2, 2, 2], [0, 1, 1, 2, 0, 2]),
        ([0, 0, 0, 0], [1, 1, 1, 1]),  # nothing right, a class never true
        ([1, 1, 1, 0], [1, 1, 1, 1]),  # a class never predicted
    ],
)
def test_classification_metrics(spark, y, g):
    got = rows(metrics.classification_metrics(scored(spark, list(zip(y, g)))))[0]
    for m, v in weighted_by_hand(y, g).items():
        assert got[m] == pytest.approx(v), m


def test_classes_compare_across_types(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 1.0)], "y int, yhat double")
    assert rows(metrics.classification_metrics(df))[0]["accuracy"] == 0.5


def test_no_rows_give_no_metrics(spark):
    assert rows(metrics.classification_metrics(scored(spark, []))) == [
        {"n_rows": None, "accuracy": None, "f1_score": None, "precision": None, "recall": None}
    ]


def test_regression_metrics(spark):
    rng = np.random.default_rng(0)
    y, g = rng.normal(5, 2, 200), rng.normal(5, 2, 200)
    y[0] = 0.0
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, g)], "y double, yhat double")
    got = rows(metrics.regression_metrics(df))[0]
    assert got["mae"] == pytest.approx(np.abs(y - g).mean())
    assert got["rmse"] == pytest.approx(math.sqrt(((y - g) ** 2).mean()))
    assert got["r2"] == pytest.approx(1 - ((y - g) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert got["mape"] == pytest.approx((np.abs(y - g) / np.maximum(np.abs(y), 1e-8)).mean() * 100)


@pytest.mark.parametrize("yhat, r2", [(3.0, 1.0), (4.0, 0.0)])
def test_r2_of_a_constant_target(spark, yhat, r2):
    df = spark.createDataFrame([(3.0, yhat)] * 4, "y double, yhat double")
    assert rows(metrics.regression_metrics(df))[0]["r2"] == r2


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def brute_ap(y, p):
    area, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        top = y[p >= t]
        recall = top.sum() / y.sum()
        area += (recall - last) * top.mean()
        last = recall
    return area


@pytest.fixture(scope="module")
def ties(spark):
    """A third of the rows share one score."""
    rng = np.random.default_rng(5)
    y = (rng.random(1500) < 0.3).astype(int)
    p = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
    p[rng.random(1500) < 0.33] = 0.5
    data = [(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))]
    return y, p, spark.createDataFrame(data, "id int, y int, p double").repartition(4)


@pytest.mark.parametrize("buckets", [1, 7, None])
def test_ranking_metrics_and_curve(ties, buckets):
    y, p, df = ties
    got = rows(metrics.ranking_metrics(df, buckets=buckets))[0]
    assert got["roc_auc"] == pytest.approx(brute_auc(y, p))
    assert got["pr_auc"] == pytest.approx(brute_ap(y, p))
    curve = by(curves.pr_curve(df, buckets=buckets), "threshold")
    assert set(curve) == set(p)
    for t in sorted(set(p)):
        top = y[p >= t]
        assert curve[t]["precision"] == pytest.approx(top.mean())
        assert curve[t]["recall"] == pytest.approx(top.sum() / y.sum())


def test_reversed_scores_mirror_the_auc(ties):
    _, _, df = ties
    a = rows(metrics.ranking_metrics(df))[0]["roc_auc"]
    b = rows(metrics.ranking_metrics(df.withColumn("p", -F.col("p"))))[0]["roc_auc"]
    assert a + b == pytest.approx(1)


@pytest.mark.parametrize("labels", [[1, 1], [0, 1, 2]])
def test_ranking_needs_two_labels(spark, labels):
    df = spark.createDataFrame([(v, 0.1 * v) for v in labels], "y int, p double")
    assert rows(metrics.ranking_metrics(df)) == [{"roc_auc": None, "pr_auc": None}]
    assert rows(curves.pr_curve(df)) == []
    assert rows(curves.lift_curve(df, ["p"])) == []
    assert rows(curves.lift_summary(curves.lift_curve(df, ["p"])))[0]["max_lift"] == 1.0


def test_two_labels_other_than_0_and_1(spark):
    df = spark.createDataFrame([("no", 0.1), ("yes", 0.9), ("no", 0.4), ("yes", 0.3)], "y string, p double")
    assert rows(metrics.ranking_metrics(df))[0]["roc_auc"] == 0.75


def test_optimal_threshold_is_the_lowest_on_a_tie(spark):
    curve = spark.createDataFrame(
        [(0.2, 0.5, 1.0), (0.6, 1.0, 0.5), (0.9, 1.0, 0.1)], "threshold double, precision double, recall double"
    )
    assert rows(curves.optimal_threshold(curve))[0]["optimal_threshold"] == 0.2
    assert rows(curves.operating_point(curve))[0]["threshold"] == 0.2


def test_lift_with_ties(ties):
    y, p, df = ties
    got = by(curves.lift_curve(df, ["id"]), "share")
    from tabassay.functions.hashing import uniform

    u = {r["id"]: r["u"] for r in rows(df.select("id", uniform(["id"], 42, "lift").alias("u")))}
    order = sorted(range(len(y)), key=lambda i: (-p[i], u[i]))
    for share in curves.LIFT_SHARES:
        k = int(share * len(y))
        hits = y[order[:k]].sum()
        assert (got[share]["n_top"], got[share]["positives"]) == (k, hits)
        assert got[share]["lift"] == pytest.approx(hits / k / y.mean())
    assert got[curves.LIFT_SHARES[-1]]["lift"] == pytest.approx(1)


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 1.0), (1, 0.1), (0, 0.3), (1, 0.35)], "y int, p double")
    left = by(curves.calibration_curve(df, closed="left"), "bin")
    assert {b: r["n_rows"] for b, r in left.items()} == {0: 1, 1: 1, 2: 1, 3: 1, 9: 1}
    right = by(curves.calibration_curve(df, closed="right"), "bin")
    assert {b: r["n_rows"] for b, r in right.items()} == {0: 1, 2: 1, 3: 1, 9: 1}
    # 0.0 is in no bin: four bins of one row, and five rows
    gaps = abs(0.1 - 1) + abs(0.3 - 0) + abs(0.35 - 1) + 0
    assert rows(curves.ece(df))[0]["ece"] == pytest.approx(gaps / 5)
    centers = abs(0.05 - 0) + abs(0.15 - 1) + abs(0.25 - 0) + abs(0.35 - 1) + abs(0.95 - 1)
    assert rows(curves.ece(df, closed="left", at="center"))[0]["ece"] == pytest.approx(centers / 5)
    assert rows(curves.brier(df))[0]["brier"] == pytest.approx((0 + 0 + 0.81 + 0.09 + 0.65**2) / 5)


def test_bars(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 3.0)], "c string, v double")
    assert {r["category"]: r["value"] for r in rows(curves.bars(df, "c"))} == {"a": 2.0, "b": 1.0}
    assert {r["category"]: r["value"] for r in rows(curves.bars(df, "c", "v"))} == {"a": 4.0, "b": 2.0}
    with pytest.raises(ValueError):
        curves.bars(df, "none")
    with pytest.raises(ValueError):
        curves.bars(df, "c", "v", "median")


def test_rank_models(spark):
    results = spark.createDataFrame(
        [("a", 0.8, 2.0), ("b", 0.9, 3.0), ("c", None, None), ("d", 0.8, 1.0)], "model_id string, accuracy double, mae double"
    )
    order = lambda m: [r["model_id"] for r in rows(metrics.rank_models(results, m).orderBy("rank"))]
    assert order("accuracy") == ["b", "a", "d"]
    assert order("mae") == ["d", "a", "b"]
    assert order("r2") == []
    assert [r["rank"] for r in rows(metrics.top_models(metrics.rank_models(results, "mae"), 2))] == [1, 2]


# --- bootstrap --------------------------------------------------------------


@pytest.mark.parametrize("units", [1000, 300])
def test_bootstrap_agrees_with_resampling_rows(spark, units):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 3, 2000)
    g = np.where(rng.random(2000) < 0.75, y, rng.integers(0, 3, 2000))
    df = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(y, g))], "id int, y int, yhat int")
    got = rows(bootstrap.bootstrap_ci(df, ["id"], "accuracy", replicates=400, units=units))[0]
    exact = [(y[i] == g[i]).mean() for i in rng.integers(0, 2000, (400, 2000))]
    assert got["n_bootstrap"] == 400
    assert got["mean"] == pytest.approx(np.mean(exact), abs=0.003)
    assert got["std"] == pytest.approx(np.std(exact), rel=0.2)
    assert got["lower"] == pytest.approx(np.quantile(exact, 0.025), abs=0.006)
    assert got["upper"] == pytest.approx(np.quantile(exact, 0.975), abs=0.006)


@pytest.mark.parametrize("metric", bootstrap.METRICS)
def test_every_metric_has_an_interval_around_it(spark, metric):
    df = spark.range(3000).select(
        "id", (F.col("id") % 2).alias("y"), F.when(F.col("id") % 5 == 0, 0).otherwise(F.col("id") % 2).alias("yhat")
    )
    got = rows(bootstrap.bootstrap_ci(df, ["id"], metric, replicates=100, units=200))[0]
    task = "classification" if metric in metrics.CLASSIFICATION else "regression"
    value = rows(metrics.task_metrics(df, task))[0][metric]
    assert got["lower"] < value < got["upper"]


def test_unknown_metric(spark):
    with pytest.raises(ValueError, match="Unknown metric"):
        bootstrap.bootstrap_ci(spark.range(1), ["id"], "auc")


# --- fairness ---------------------------------------------------------------


@pytest.fixture(scope="module")
def sliced(spark):
    data = [(1, 1, "a", "k")] * 8 + [(1, 0, "a", "k")] * 2 + [(0, 0, "b", "k")] * 5 + [(0, 1, "b", "k")] * 5
    return spark.createDataFrame([*data, (1, 1, None, "k")], "y int, yhat int, g string, one string")


def test_slices(sliced):
    got = by(fairness.slice_metrics(sliced, ["g", "one", "absent"], "classification"), "column", "slice")
    assert set(got) == {("g", "a"), ("g", "b"), ("one", "k")}
    assert got[("g", "a")]["accuracy"] == 0.8 and got[("g", "a")]["sample_size"] == 10
    assert got[("g", "b")]["f1_score"] == pytest.approx(weighted_by_hand([0] * 10, [0] * 5 + [1] * 5)["f1_score"])


def test_disparity_levels(spark):
    make = lambda *v: spark.createDataFrame(
        [(c, f"s{i}", a) for c, values in v for i, a in enumerate(values)], "column string, slice string, accuracy double"
    )
    got = by(fairness.disparity(make(("x", [0.9, 0.75]), ("y", [0.9, 0.5]), ("z", [0.9, 0.85]), ("one", [0.1]))), "column")
    assert {c: r["severity"] for c, r in got.items()} == {"x": "medium", "y": "high"}
    errors = make(("x", [1.0, 1.6]), ("y", [0.0, 1.0]), ("z", [1.0, 1.4])).withColumnRenamed("accuracy", "mae")
    got = by(fairness.disparity(errors), "column")
    assert {c: r["severity"] for c, r in got.items()} == {"x": "medium", "y": "high"}
    assert got["y"]["disparity"] == float("inf")


def test_fairness_summary(spark, sliced):
    status = lambda cols: rows(fairness.fairness_summary(fairness.slice_metrics(sliced, cols, "classification")))[0]
    assert status(["g"]) == {"status": "issues_found", "total_issues": 1}
    assert status(["one"]) == {"status": "no_issues", "total_issues": 0}
    assert status(["absent"])["status"] == "no_sensitive_columns"
    slices = fairness.slice_metrics(sliced, ["g"], "classification")
    assert fairness.require_fair(slices).count() == 1
    with pytest.raises(ValueError, match="High disparity"):
        fairness.require_fair(slices, "block")


@pytest.mark.parametrize("metric", ["mae", "r2"])
def test_error_units_take_the_guess_once(spark, metric):
    rng = np.random.default_rng(5)
    y, g = 1e9 + rng.normal(size=300), 1e9 + rng.normal(size=300)
    data = [(i, None if i % 10 == 0 else float(y[i]), None if i % 7 == 0 else float(g[i])) for i in range(300)]
    df = spark.createDataFrame(data, "id int, y double, yhat double")
    unit = bootstrap._units(df, ["id"], 8, 42)[0]
    found = rows(bootstrap._error_units(df, unit, F.col("y"), F.col("yhat"), metric == "r2"))
    used = np.array([i for i in range(300) if i % 10 and i % 7])
    assert sum(r["n"] for r in found) == len(used)
    assert sum(r["abs"] for r in found) == pytest.approx(np.abs(y - g)[used].sum())
    if metric == "r2":
        assert sum(r["yy"] for r in found) == pytest.approx(((y[used] - y[used].mean()) ** 2).sum(), rel=1e-6)
        assert sum(r["y"] for r in found) == pytest.approx(0.0, abs=1e-4)
    plan = bootstrap.bootstrap_scores(df, ["id"], metric)._jdf.queryExecution().optimizedPlan().toString()
    assert "yhat" not in plan  # the units are stored: nothing of a row is computed twice
