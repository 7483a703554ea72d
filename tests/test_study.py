import pytest
from conftest import by, rows
from pyspark.sql import functions as F

from tabassay.functions.hashing import uniform
from tabassay.plans.study import Settings, run_study

FAST = [
    {"name": "logistic_regression"},
    {"name": "random_forest_classifier", "params": {"n_estimators": 5, "max_depth": 3}},
]


@pytest.fixture(scope="module")
def table(spark):
    u = lambda salt: uniform(["key"], 3, salt)
    return (
        spark.range(1200)
        .withColumnRenamed("id", "key")
        .withColumn("x", 10 * u("x"))
        .withColumn("group", F.when(u("g") < 0.5, "left").otherwise("right"))
        .withColumn("note", F.when(F.col("key") % 10 == 0, "call 415-555-0100").otherwise("fine"))
        .withColumn("y", (F.col("x") + 2 * u("n") > 6).cast("int"))
        .withColumn("x", F.when(F.col("key") % 9 != 0, F.col("x")))
        .withColumn("twin", 2 * F.col("y") + 1)
    )


def test_blocking_leakage_stops_the_study(table):
    with pytest.raises(RuntimeError, match="twin"):
        run_study(table, Settings("y", ["key"], specs=FAST))


def test_all_stages(table):
    settings = Settings("y", ["key"], sensitive=["group"], drop_leaky=True, specs=FAST, calibrate="sigmoid")
    study = run_study(table, settings)
    assert by(study.tables["pii"], "pattern")["phone"]["n_matches"] == 120
    assert study.params.numeric.keys() == {"x"} and set(study.params.text) == {"group", "note"}
    assert "415" not in str(rows(study.params.vocabulary))  # redacted before it is learnt
    assert "twin" not in study.best.features and "key" not in study.best.features
    measured = by(study.tables["test_metrics"], "metric")
    assert measured["accuracy"]["value"] > 0.8 and measured["roc_auc"]["value"] > 0.8
    assert {r["slice"] for r in rows(study.tables["slices"])} == {"left", "right"}
    assert rows(study.tables["grade"])[0]["total_tests"] == 2
    assert rows(study.tables["calibration"])[0]["brier_after"] is not None
    sections = {r["section"] for r in rows(study.tables["report"])}
    assert {"insights", "verdict", "splits", "leaderboard", "test_metrics", "grade"} <= sections
    again = run_study(table.repartition(6), settings)
    assert by(again.tables["splits"], "split") == by(study.tables["splits"], "split")
    assert rows(again.tables["classes"].orderBy("split", "value")) == rows(
        study.tables["classes"].orderBy("split", "value")
    )


def test_regression_ranks_by_error(table):
    noise = 20 * uniform(["key"], 2)  # enough that the feature is not taken for a leak
    numbers = table.select("key", "x", (3 * F.coalesce("x", F.lit(0.0)) + noise).alias("y"))
    specs = [{"name": "linear_regression"}, {"name": "random_forest_regressor", "params": {"n_estimators": 3, "max_depth": 3}}]
    found = run_study(numbers, Settings("y", ["key"], specs=specs, pii_action="none"))
    board = rows(found.tables["leaderboard"].orderBy("rank"))
    assert len(board) == 2 and board[0]["mae"] <= board[1]["mae"]
    assert "mape" in by(found.tables["test_metrics"], "metric")
