import datetime
import math

import numpy as np
import pytest
from conftest import by, rows
from pyspark.sql import functions as F

from tabassay.operators import features, splits

NAN = float("nan")


@pytest.fixture(scope="module")
def labelled(spark):
    """997 rows; one class holds a third of the rows, one has a single row."""
    data = [(i, "a" if i % 3 == 0 else "b" if i % 7 else "c", float(i)) for i in range(996)]
    return spark.createDataFrame([*data, (996, "rare", 1.0)], "id int, y string, x double")


def split_of(df):
    return {r["id"]: r["split"] for r in rows(df.select("id", "split"))}


def test_random_split_is_an_exact_stratified_cover(labelled):
    done = splits.random_split(labelled, "y", ["id"])
    got = split_of(done)
    assert len(got) == 997
    n_test = math.ceil(0.2 * 997)
    n_val = math.ceil(0.25 * (997 - n_test))
    sizes = {r["split"]: r["n_rows"] for r in rows(splits.split_summary(done))}
    assert sizes == {"test": n_test, "val": n_val, "train": 997 - n_test - n_val}
    share = by(splits.class_distribution(done, "y"), "split", "value")
    for y, n in (("a", 332), ("b", 569), ("c", 95)):
        assert abs(share[("test", y)]["n_rows"] - 0.2 * n) <= 1
        assert abs(share[("val", y)]["n_rows"] - 0.2 * n) <= 1.5


def test_random_split_does_not_depend_on_partitions(labelled):
    first = split_of(splits.random_split(labelled, "y", ["id"]))
    assert first == split_of(splits.random_split(labelled.repartition(13), "y", ["id"]))
    assert first != split_of(splits.random_split(labelled, "y", ["id"], seed=7))


def test_continuous_target_is_not_stratified(labelled):
    done = splits.random_split(labelled, "x", ["id"], 0.1, 0.3)
    sizes = {r["split"]: r["n_rows"] for r in rows(splits.split_summary(done))}
    assert sizes["test"] == 100 and sizes["val"] == math.ceil(0.3 / 0.9 * 897)
    assert rows(splits.class_distribution(done, "x")) == []


def test_null_target_rows_are_split_too(spark):
    df = spark.createDataFrame([(i, None if i < 10 else "a") for i in range(50)], "id int, y string")
    assert len(split_of(splits.random_split(df, "y", ["id"]))) == 50


def test_no_shuffle_of_rows_to_label_them(labelled):
    plan = splits.random_split(labelled, "y", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


def test_time_split_follows_time_not_row_order(spark):
    start = datetime.datetime(2024, 1, 1)
    data = [(i, start + datetime.timedelta(microseconds=(i * 37) % 101)) for i in range(101)]
    df = spark.createDataFrame(data, "id int, at timestamp_ntz").repartition(5)
    got = split_of(splits.make_splits(df, "id", "time", ["id"], "at"))
    ordered = [i for i, _ in sorted(data, key=lambda d: d[1])]
    test_start = int(101 * 0.8)
    val_start = int(test_start * 0.8)
    assert [got[i] for i in ordered] == (
        ["train"] * val_start + ["val"] * (test_start - val_start) + ["test"] * (101 - test_start)
    )


@pytest.mark.parametrize("kind", ["date", "timestamp", "long"])
def test_time_split_with_one_hot_instant(spark, kind):
    at = {"date": "date'2024-01-01'", "timestamp": "timestamp'2024-01-01 10:00:00'", "long": "5L"}[kind]
    df = spark.range(300).select("id", F.expr(at).alias("at"))
    sizes = {r["split"]: r["n_rows"] for r in rows(splits.split_summary(splits.time_split(df, "at", ["id"])))}
    assert sizes == {"train": 192, "val": 48, "test": 60}


def test_bad_split_arguments(labelled):
    with pytest.raises(ValueError, match="no target column"):
        splits.make_splits(labelled, "nope", "iid", ["id"])
    with pytest.raises(ValueError, match="No split is made by"):
        splits.make_splits(labelled, "y", "other", ["id"])
    with pytest.raises(ValueError):
        splits.make_splits(labelled, "y", "time", ["id"])
    with pytest.raises(ValueError):
        splits.make_splits(labelled, "y", "time", ["id"], "nope")


def test_hashed_split_runs_no_job_and_is_near(labelled):
    done = splits.hashed_split(labelled, ["id"])
    share = {r["split"]: r["proportion"] for r in rows(splits.split_summary(done))}
    assert abs(share["train"] - 0.6) < 0.06


def test_folds_are_balanced_per_class(labelled):
    done = splits.assign_folds(labelled, ["id"], 3, "y")
    per = done.groupBy("y").pivot("fold", [0, 1, 2]).count().na.fill(0)
    for r in rows(per):
        assert max(r["0"], r["1"], r["2"]) - min(r["0"], r["1"], r["2"]) <= 1
    plain = [r["count"] for r in rows(splits.assign_folds(labelled, ["id"], 4).groupBy("fold").count())]
    assert sorted(plain) == [249, 249, 249, 250]


def test_time_folds_are_ordered(spark):
    df = spark.range(100).withColumn("at", F.col("id") * 2)
    got = by(splits.time_folds(df, "at", ["id"]).groupBy("fold").agg(F.min("id"), F.max("id")), "fold")
    assert [(got[f]["min(id)"], got[f]["max(id)"]) for f in range(4)] == [(0, 24), (25, 49), (50, 74), (75, 99)]


def test_stratified_sample(labelled):
    got = splits.stratified_sample(labelled, "y", ["id"], 100)
    assert got.count() == 100
    assert splits.stratified_sample(labelled, "y", ["id"], 10**6).count() == 997


def test_infer_task(spark):
    df = spark.range(100).select(
        (F.col("id") % 2).alias("flag"), "id", (F.col("id") % 2).cast("double").alias("real"),
        F.col("id").cast("string").alias("word"),
    )
    got = [splits.infer_task(df, c) for c in ("flag", "id", "real", "word")]
    assert got == ["classification", "regression", "regression", "regression"]


def test_distinct_up_to_has_an_exact_limit(spark):
    from tabassay.functions.columns import distinct_up_to

    for n in (19, 20, 21, 59, 61, 5000):
        df = spark.range(n).select((F.col("id") * 7).alias("v"))
        got = distinct_up_to(df, F.col("v"), 20)
        assert (got == [7 * i for i in range(n)]) if n <= 20 else got is None


# --- features ---------------------------------------------------------------


@pytest.fixture(scope="module")
def table(spark):
    data = [
        ("train", 1.0, 5, "b", True, 0),
        ("train", 2.0, 5, "a", False, 1),
        ("train", 3.0, 5, None, True, 0),
        ("train", 4.0, 5, "b", True, 1),
        ("train", None, 5, "b", True, 1),
        ("train", NAN, 5, "b", True, 1),
        ("test", 100.0, 9, "zzz", False, 0),
        ("val", None, None, None, None, 1),
    ]
    return spark.createDataFrame(data, "split string, x double, flat int, t string, ok boolean, y int")


def test_fit_uses_training_rows_and_transforms_all(table):
    done, params = features.fit_transform(table, "y")
    filled = np.array([1, 2, 3, 4, 2.5, 2.5])
    median, mean, std = params.numeric["x"]
    assert median == 2.5 and mean == pytest.approx(filled.mean()) and std == pytest.approx(filled.std())
    assert params.numeric["flat"] == (5.0, 5.0, 0.0)
    got = rows(done)
    test = next(r for r in got if r["split"] == "test")
    val = next(r for r in got if r["split"] == "val")
    assert test["x"] == pytest.approx((100 - filled.mean()) / filled.std())
    assert test["flat"] == 4.0  # zero variance: centred only
    assert test["t"] == -1 and val["t"] == 2  # a, b, missing
    assert val["x"] == pytest.approx((2.5 - filled.mean()) / filled.std())
    assert test["ok"] is False and val["y"] == 1


def test_fit_ignores_other_splits(spark, table):
    more = table.union(spark.createDataFrame([("test", 1e9, 1, "aa", True, 0)], table.schema))
    a, b = features.fit_transform(table, "y")[1], features.fit_transform(more, "y")[1]
    assert a.numeric == b.numeric
    assert rows(a.vocabulary.orderBy("idx")) == rows(b.vocabulary.orderBy("idx"))


def test_all_missing_column(spark):
    df = spark.createDataFrame([("train", None, 1), ("train", None, 2)], "split string, x double, y int")
    done, params = features.fit_transform(df, "y")
    assert params.numeric["x"] == (None, None, None)
    assert [r["x"] for r in rows(done)] == [None, None]


def test_large_vocabulary_gives_the_same_codes(spark):
    """A third of the rows share one word; the shuffled way must agree with the broadcast way."""
    words = [("hot" if i % 3 == 0 else f"w{i % 500:03d}", i) for i in range(3000)] + [(None, -1), ("new", -2)]
    df = spark.createDataFrame(words, "t string, id int")
    train = df.where("id > -2")
    small, n = features.fit_vocabulary(train, ["t"])
    expected = {(r["id"]): r["t"] for r in rows(features.encode(df, small, ["t"], n))}
    large, m = features.fit_vocabulary(train, ["t"], small_rows=3)
    assert n and not m
    assert by(large.drop("share"), "value") == by(small, "value")
    assert [r["value"] for r in rows(large) if r["share"] >= features.HOT_SHARE] == ["hot"]
    got = features.encode(df, large, ["t"], m)
    assert {r["id"]: r["t"] for r in rows(got)} == expected
    assert expected[-2] == -1 and got.count() == len(words)


def test_identical_rows_of_a_hot_value_are_dealt_out(spark):
    df = spark.createDataFrame([("hot",)] * 900 + [(f"w{i}",) for i in range(90)], "t string").repartition(3)
    words, small = features.fit_vocabulary(df, ["t"], small_rows=3)
    coded = features.encode(df, words, ["t"], small)
    assert coded.where("t = 0").count() == 900 and coded.distinct().count() == 91


def test_two_columns_in_one_large_vocabulary(spark):
    df = spark.createDataFrame([(f"a{i}", f"b{i % 40}") for i in range(300)], "s string, t string")
    small, _ = features.fit_vocabulary(df, ["s", "t"])
    large, _ = features.fit_vocabulary(df, ["s", "t"], small_rows=3)
    assert by(large.drop("share"), "column", "value") == by(small, "column", "value")


def test_plan(spark):
    df = spark.createDataFrame(
        [(float(i), None if i == 3 else f"v{i}", f"v{i % 5}", None if i else True, i, i) for i in range(60)],
        "x double, many string, few string, ok boolean, deny int, y int",
    )
    got = by(features.plan(df, "y", ["deny"]), "column")
    assert {c: r["transforms"] for c, r in got.items()} == {
        "x": ["standard_scale"],
        "many": ["impute_mode", "high_cardinality_encode"],
        "few": ["label_encode"],
        "ok": ["impute_mode"],
    }
    summary = rows(features.plan_summary(df, "y", ["deny"]))[0]
    assert summary == {
        "total_features": 4, "excluded_features": 1, "numeric_features": 1,
        "categorical_features": 2, "missing_data_columns": 2,
    }
    assert rows(features.plan(df.select("y"), "y")) == []
