"""Encoders, powers, products and executed plans on small tables."""

import math

import numpy as np
import pytest
from conftest import by, rows
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabassay.functions.ordering import numbered
from tabassay.operators import bootstrap, encoders, features, models, splits, transforms
from tabassay.plans import transform_queries


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(1200):
        group = f"g{rng.integers(0, 300)}" if i % 3 else "hot"
        data.append((
            i, group, [None, "x", "y"][i % 3], float(rng.lognormal(1, 0.7)), None if i % 4 == 0 else float(i % 10),
            float(rng.random()), None, "train" if i % 5 else "test",
        ))
    schema = "id int, grp string, small string, pos double, gap double, target double, void double, split string"
    return spark.createDataFrame(data, schema).repartition(4).cache()


def _corr(df, a, b):
    return df.agg(F.corr(a, b)).first()[0]


@pytest.mark.parametrize("small_rows", [None, 2])
def test_random_target_gives_no_gain(table, small_rows):
    train = table.where("split = 'train'")
    means = encoders.fit_target_means(train, ["grp"], "target", ["id"], smoothing=0.001, small_rows=small_rows)
    assert means.small == (small_rows is None)
    fair = encoders.target_encode(table, means).where("split = 'train'")
    leaky = encoders.target_encode(table, means, learned=F.lit(False)).where("split = 'train'")
    assert abs(_corr(fair, "grp", "target")) < 0.12
    assert _corr(leaky, "grp", "target") > 0.4


def test_target_means_of_known_rows(spark):
    df = spark.createDataFrame(
        [(1, "a", True), (2, "a", False), (3, "b", True), (4, None, True), (5, "a", None)], "id int, c string, y boolean"
    )
    means = encoders.fit_target_means(df, ["c"], "y", ["id"], folds=2, smoothing=1.0)
    assert (means.total, means.rows) == (3.0, 4)
    new = spark.createDataFrame([(9, "a", 7), (9, "zz", 7), (9, None, 7)], "id int, c string, total int")
    found = [r["c"] for r in rows(encoders.target_encode(new, means))]
    assert sorted(found) == pytest.approx(sorted([(1 + 0.75) / 3, 0.75, (1 + 0.75) / 2]))
    with pytest.raises(ValueError):
        encoders.fit_target_means(df, ["c"], "y", ["id"], folds=1)
    empty = encoders.fit_target_means(df.limit(0), ["c"], "y", ["id"])
    assert [r["c"] for r in rows(encoders.target_encode(new, empty))] == [None] * 3


def test_hot_category_of_a_large_table_of_means(table):
    train = table.where("split = 'train'")
    small = encoders.fit_target_means(train, ["grp"], "target", ["id"])
    large = encoders.fit_target_means(train, ["grp"], "target", ["id"], small_rows=1)
    a = by(encoders.target_encode(table, small), "id")
    b = by(encoders.target_encode(table, large), "id")
    assert all(a[i]["grp"] == pytest.approx(b[i]["grp"]) for i in a)


@pytest.mark.parametrize("small_rows", [None, 1])
@pytest.mark.parametrize("drop", [False, True])
def test_one_hot(spark, table, small_rows, drop):
    vocabulary, small = features.fit_vocabulary(table.where("small is null or small = 'x'"), ["small"], small_rows)
    out = encoders.one_hot(table, vocabulary, ["small"], small, drop).select("id", vector_to_array("small").alias("v"))
    want = {None: [1.0, 0.0], "x": [0.0, 1.0], "y": [0.0, 0.0]}  # 'missing' sorts before 'x'; 'y' is unseen
    if drop:
        want = {k: v[:1] for k, v in want.items()}
    texts = by(table, "id")
    assert all(r["v"] == want[texts[r["id"]]["small"]] for r in rows(out))


def test_slot_of_a_wide_vector_is_read_from_its_one_entry(spark):
    words = [(i, f"w{i:05d}") for i in range(5000)] + [(5000, None)]
    df = spark.createDataFrame(words, "id int, c string")
    vocabulary, small = features.fit_vocabulary(df.where("id % 2 = 0"), ["c"])
    out = encoders.one_hot(df, vocabulary, ["c"], small).select("id", encoders.hot_slot("c").alias("slot"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "unwrap_udt" in plan.lower() or "UnwrapUDT" in plan
    got = {r["id"]: r["slot"] for r in rows(out)}
    # 'missing' sorts before 'w'; odd ones are unseen
    assert got == {i: None if i % 2 else i // 2 + 1 for i in range(5000)} | {5000: 0}


def test_vectors_train_a_forest(table):
    plan = {"small": ["one_hot_encode"], "grp": ["high_cardinality_encode"], "pos": ["standard_scale"]}
    params = transforms.fit_plan(table, plan, options=transforms.Options(hash_width=8))
    ready = transforms.apply_plan(table, params).select("small", "grp", "pos", F.col("pos").alias("y"))
    names = models.model_features(ready, "y")
    assert names == ["small", "grp", "pos"]
    spec = {"name": "random_forest_regressor", "params": {"n_estimators": 5, "max_depth": 4}}
    fitted = models.fit_model(spec, ready, "y", names)
    weights = fitted.importances()
    assert fitted.widths == [3, 8, 1]
    assert sum(weights.values()) == pytest.approx(1.0) and weights["pos"] > 0.9
    assert fitted.score(ready).count() == table.count()


def test_hashed_slots_do_not_depend_on_the_rows(table):
    whole = encoders.hash_encode(table, ["grp"], 16)
    part = encoders.hash_encode(table.where("id < 50"), ["grp"], 16)
    a = by(whole.select("id", vector_to_array("grp").alias("v")), "id")
    for r in rows(part.select("id", vector_to_array("grp").alias("v"))):
        assert r["v"] == a[r["id"]]["v"] and sorted(map(abs, r["v"])) == [0.0] * 15 + [1.0]
    with pytest.raises(ValueError):
        encoders.hash_encode(table, ["grp"], 0)


def _likelihood(x, e):
    y = np.log(x) if abs(e) < 1e-12 else (x**e - 1) / e
    return (e - 1) * np.log(x).sum() - len(x) / 2 * math.log(y.var())


def test_box_cox_exponent(table):
    x = np.array([r["pos"] for r in rows(table)])
    (e, mean, variance) = transforms.box_cox_exponents(table, {"pos": F.col("pos")})["pos"]
    low, high = -2.0, 2.0
    while high - low > 1e-7:
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (a, high) if _likelihood(x, a) < _likelihood(x, b) else (low, b)
    assert e == pytest.approx(low, abs=1e-4)
    y = (x**e - 1) / e
    assert (mean, variance) == (pytest.approx(y.mean()), pytest.approx(y.var()))


@pytest.mark.parametrize("e", [-2.0, 0.0, 0.3, 3.0])
def test_box_cox_from_logarithms(spark, e):
    df = spark.createDataFrame([(0.5,), (1.0,), (7.0,), (None,)], "x double")
    curve = transforms._curve(F.ln("x"), F.lit(e))
    got = rows(df.select(curve.alias("a"), transforms.box_cox(F.col("x"), e).alias("b")))
    assert all(r["a"] == (None if r["b"] is None else pytest.approx(r["b"], rel=1e-12)) for r in got)


def test_box_cox_candidates_are_compiled_together(spark):
    # mean and variance keep five numbers per candidate, beside the two keys
    most = int(spark.conf.get("spark.sql.codegen.maxFields"))
    assert transforms.CANDIDATES % transforms.TOGETHER == 0 and 5 * transforms.TOGETHER + 2 <= most


def test_box_cox_of_odd_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 2.0, None)], "a double, b double, c double")
    found = transforms.box_cox_exponents(df.where("a > 0"), {"b": F.col("b"), "c": F.col("c")})
    assert found["b"][0] == 1.0 and found["c"][0] == 1.0
    with pytest.raises(ValueError, match="positive"):
        transforms.box_cox_exponents(df, {"z": F.col("a") - 1})


def test_modes(spark):
    df = spark.createDataFrame([("b", 1, 2.0), ("a", 1, float("nan")), ("a", None, 3.0), ("b", 2, None)], "t string, n int, x double")
    assert transforms.modes(df, ["t", "n", "x"]) == {"t": "a", "n": 1, "x": 2.0}


CHAINS = {
    "gap": ["impute_median", "log_transform", "standard_scale"],
    "pos": ["box_cox_transform", "min_max_scale"],
    "void": ["impute_mean", "standard_scale"],
    "small": ["impute_mode", "label_encode"],
}


def test_plan_follows_its_transforms(table):
    train = table.where("split = 'train'")
    out, params = transforms.run_plan(table, _plan(table, CHAINS), "target", ["id"])
    data = {r["id"]: r for r in rows(train)}
    gap = np.array([np.nan if r["gap"] is None else r["gap"] for r in data.values()])
    filled = np.log1p(np.where(np.isnan(gap), np.nanmedian(gap), gap))
    pos = np.array([r["pos"] for r in data.values()])
    e = params.exponents["pos"]
    bent = (pos**e - 1) / e
    found = by(out, "id")
    for r, g, p in zip(data, (filled - filled.mean()) / filled.std(), (bent - bent.min()) / (bent.max() - bent.min())):
        assert found[r]["gap"] == pytest.approx(g) and found[r]["pos"] == pytest.approx(p)
        assert found[r]["void"] is None
    assert {r["small"] for r in found.values()} == {0, 1}
    assert {"gap", "pos", "void", "small"} == set(by(params.table(table), "column"))


def _plan(df, steps):
    plan = [(i, c, list(s)) for i, (c, s) in enumerate(steps.items())]
    return df.sparkSession.createDataFrame(plan, "position int, column string, transforms array<string>")


@pytest.mark.parametrize("scale", ["standard_scale", "min_max_scale", "robust_scale"])
@pytest.mark.parametrize("impute", ["impute_median", "impute_mean", "impute_mode"])
def test_editing_the_plan_changes_the_result(table, impute, scale):
    out, _ = transforms.run_plan(table, _plan(table, {"gap": [scale, "sqrt_transform", impute]}), "target")
    got = [r["gap"] for r in rows(out.where("split = 'train'").orderBy("id"))]
    x = [r["gap"] for r in rows(table.where("split = 'train'").orderBy("id"))]
    present = np.array([v for v in x if v is not None])
    values, counts = np.unique(present, return_counts=True)
    fill = {"impute_median": np.median(present), "impute_mean": present.mean(), "impute_mode": values[counts.argmax()]}[impute]
    y = np.sqrt([fill if v is None else v for v in x])
    shift, spread = {
        "standard_scale": (y.mean(), y.std()),
        "min_max_scale": (y.min(), y.max() - y.min()),
        "robust_scale": (np.median(y), np.quantile(y, 0.75) - np.quantile(y, 0.25)),
    }[scale]
    assert got == pytest.approx(list((y - shift) / spread))


def test_plans_that_do_not_fit(table):
    for steps in (
        {"nope": ["standard_scale"]}, {"pos": ["shuffle"]}, {"grp": ["standard_scale"]}, {"pos": ["label_encode"]},
        {"pos": ["standard_scale", "robust_scale"]}, {"pos": ["impute_mean", "impute_mode"]},
    ):
        with pytest.raises(ValueError):
            transforms.fit_plan(table, steps)
    with pytest.raises(ValueError, match="target"):
        transforms.fit_plan(table, {"grp": ["target_encode"]})


def test_empty_training_rows(table):
    params = transforms.fit_plan(table.limit(0), CHAINS)
    out = transforms.apply_plan(table, params)
    assert out.where("gap is not null or pos is not null").count() == 0
    assert {r["small"] for r in rows(out)} == {features.UNSEEN}


def test_products(spark):
    df = spark.createDataFrame([(2, 3.0)], "a int, b double")
    names = transforms.monomials(["a", "b"], 3)
    out = rows(transforms.add_products(df, names))[0]
    assert out == {"a": 2, "b": 3.0, "a^2": 4.0, "a*b": 6.0, "b^2": 9.0, "a^3": 8.0, "a^2*b": 12.0, "a*b^2": 18.0, "b^3": 27.0}
    assert transforms.monomials(["a", "b"], 3, repeated=False) == [("a", "b")]
    with pytest.raises(ValueError, match="most"):
        transforms.monomials([str(i) for i in range(60)], 3)


# --- rolling splits, numbers of rows, exact resampling


def test_rolling_splits(spark):
    df = spark.range(100).select("id", F.timestamp_seconds(F.col("id") * 3600).alias("at"))
    parted, roles = splits.rolling_split(df, "at", ["id"], folds=3, gap=1, val=1)
    sizes = {(r["fold"], r["role"]): r["n_rows"] for r in rows(splits.rolling_summary(parted, roles, "at"))}
    per = {r["stretch"]: r["count"] for r in rows(parted.groupBy("stretch").count())}
    assert sum(per.values()) == 100 and len(per) == 6
    for k in range(3):
        assert sizes[k, "train"] == sum(per[i] for i in range(k + 1))
        assert sizes[k, "val"] == per[k + 2] and sizes[k, "test"] == per[k + 3]
        train = splits.rolling_rows(parted, roles, k, "train").agg(F.max("id")).first()[0]
        held = splits.rolling_rows(parted, roles, k, "test").agg(F.min("id")).first()[0]
        assert train < held
    moving = {(r["fold"], r["role"]): (r["first"], r["last"]) for r in rows(splits.rolling_roles(df, 3, window=1))}
    assert moving[2, "train"] == (2, 2) and moving[2, "test"] == (3, 3)
    with pytest.raises(ValueError):
        splits.rolling_roles(df, 0)


def test_grid_search_on_rolling_splits(spark):
    df = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("x"), F.col("id").cast("double").alias("at"))
    parted, roles = splits.rolling_split(df.withColumn("y", F.col("x") * 2 + 1), "at", ["id"], folds=2)
    found = models.grid_search(
        parted, "y", ["x"], "logistic_regression", "regression", {"alpha": [0.001, 1000.0]}, roles=roles
    )
    assert models.best_spec(found)["params"] == {"alpha": 0.001}


def test_row_numbers(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"), "id").repartition(7)
    found = rows(numbered(df, [F.col("v")]))
    assert all(r["position"] == r["v"] for r in found) and len(found) == 1000


@pytest.mark.parametrize("metric", ["mae", "r2", "accuracy"])
def test_exact_resampling(spark, metric):
    df = spark.range(60).select("id", (F.col("id") % 2).alias("y"), (F.col("id") % 3 == 0).cast("int").alias("yhat"))
    weights = bootstrap.exact_weights(df, ["id"], 20, 1)
    assert {r["n"] for r in rows(weights.groupBy("replicate").agg(F.sum("weight").alias("n")))} == {60}
    scores = rows(bootstrap.bootstrap_scores(df, ["id"], metric, replicates=20, method="exact", seed=1))
    data = {}
    for r in rows(weights):
        data.setdefault(r["replicate"], []).append((r["y"], r["yhat"], r["weight"]))
    for r in scores:
        y, g, w = (np.array(x, float) for x in zip(*data[r["replicate"]]))
        mean = (y * w).sum() / w.sum()
        want = {
            "mae": (w * abs(y - g)).sum() / w.sum(),
            "accuracy": (w * (y == g)).sum() / w.sum(),
            "r2": 1 - (w * (y - g) ** 2).sum() / (w * (y - mean) ** 2).sum(),
        }[metric]
        assert r["score"] == pytest.approx(want)
    with pytest.raises(ValueError):
        bootstrap.bootstrap_scores(df, ["id"], metric, method="other")


def test_weights_drawn_row_by_row(spark, monkeypatch):
    df = spark.range(60).select("id", (F.col("id") % 2).alias("y"), (F.col("id") % 3 == 0).cast("int").alias("yhat"))
    args = (df, ["id"], "accuracy", "y", "yhat", 10)
    usual = by(bootstrap.bootstrap_scores(*args), "replicate")
    monkeypatch.setattr(bootstrap, "BROADCAST_WEIGHTS", 0)
    assert by(bootstrap.bootstrap_scores(*args), "replicate") == usual


def test_too_many_classes(spark):
    with pytest.raises(ValueError, match="classes"):
        models.class_labels(spark.range(50).withColumnRenamed("id", "y"), "y", most=20)


def test_rolling_rows_are_joined_once(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(transform_queries.models, "grid_search", lambda df, *_, **__: seen.append(df) or spark.range(1))
    transform_queries.grid_rolling(spark, sf)
    assert "Join Inner" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
