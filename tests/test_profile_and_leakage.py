import datetime

import numpy as np
import pandas as pd
import pytest
from conftest import by, rows
from pyspark.sql import functions as F

from tabassay.operators import exploration, leakage, profile

NAN = float("nan")


@pytest.fixture(scope="module")
def messy(spark):
    data = [
        (1, 1.0, 5.0, "a", None, True, datetime.date(2024, 1, 1)),
        (2, NAN, 5.0, "b", None, False, datetime.date(2024, 1, 2)),
        (3, None, 5.0, "b", None, None, None),
        (4, 4.0, 5.0, None, None, True, datetime.date(2024, 1, 2)),
    ]
    return spark.createDataFrame(
        data, "`row id` int, x double, flat double, t string, void double, ok boolean, day date"
    )


def test_missing_counts_nan_and_null(messy):
    got = by(profile.missing_profile(messy), "column")
    assert got["x"]["missing_count"] == 2 and got["x"]["missing_pct"] == 50.0
    assert got["void"]["missing_count"] == 4
    assert got["row id"]["missing_count"] == 0
    assert got["t"]["total_missing"] == 2 + 4 + 1 + 1 + 1


def test_percent_rounds_half_to_even(spark):
    df = spark.range(1600).select(F.when(F.col("id") >= 2, F.col("id")).alias("x"))
    assert rows(profile.missing_profile(df))[0]["missing_pct"] == 0.12  # 0.125


def test_numeric_profile_edges(messy):
    got = by(profile.numeric_profile(messy), "column")
    assert got["x"] | {"std": None} == {
        "column": "x", "count": 2, "mean": 2.5, "std": None, "min": 1.0,
        "p25": 1.75, "p50": 2.5, "p75": 3.25, "max": 4.0,
    }
    assert got["flat"]["std"] == 0.0
    assert got["void"]["count"] == 0 and got["void"]["p50"] is None
    assert "ok" not in got and "row id" in got


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, t string")
    assert rows(profile.shape(df)) == [{"n_rows": 0, "n_columns": 2}]
    assert rows(profile.missing_profile(df))[0]["missing_pct"] is None
    assert rows(profile.numeric_profile(df))[0]["count"] == 0
    assert rows(profile.categorical_profile(df)) == [
        {"column": "t", "unique_values": 0, "most_frequent": None, "most_frequent_count": 0}
    ]
    assert rows(profile.candidate_targets(df)) == []


def test_frequent_values_break_ties_by_value(spark):
    words = ["c"] * 3 + ["b"] * 3 + ["a"] + ["d", "e", "f", "g"]
    df = spark.createDataFrame([(w,) for w in words], "t string").repartition(4)
    got = [(r["value"], r["n"]) for r in rows(profile.top_values(df).orderBy("rank"))]
    assert got == [("b", 3), ("c", 3), ("a", 1), ("d", 1), ("e", 1)]
    top = rows(profile.categorical_profile(df))[0]
    assert (top["unique_values"], top["most_frequent"], top["most_frequent_count"]) == (7, "b", 3)


def test_top_values_filter_before_the_shuffle(spark):
    df = spark.createDataFrame([("a",)], "t string")
    plan = profile.top_values(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_distinct_counts_of_every_kind(messy):
    got = by(profile.distinct_counts(messy), "column")
    assert {c: r["unique_values"] for c, r in got.items()} == {
        "row id": 4, "x": 2, "flat": 1, "t": 2, "void": 0, "ok": 2, "day": 2,
    }


def test_large_integers_stay_distinct(spark):
    big = 2**53
    df = spark.createDataFrame([(big,), (big + 1,)], "x long")
    assert rows(profile.distinct_counts(df))[0]["unique_values"] == 2


def test_candidate_targets(spark):
    df = spark.range(30).select(
        "id", (F.col("id") % 2).alias("two"), F.lit(1).alias("one"), F.col("id").cast("string").alias("t")
    )
    got = by(profile.candidate_targets(df), "column")
    assert {c: r["type"] for c, r in got.items()} == {
        "id": "regression_candidate",
        "two": "classification_candidate",
    }


def test_insights(messy):
    got = [r["insight"] for r in rows(profile.insights(messy).orderBy("position"))]
    assert got == [
        "Dataset has 4 rows and 7 columns",
        "Missing data: 9 total missing values",
        "Data types: 4 numeric, 1 categorical",
    ]


def test_correlation_of_gaps_and_constants(spark):
    data = [(float(i), 2.0 * i if i % 3 else None, 3.0, NAN if i == 1 else -float(i)) for i in range(20)]
    df = spark.createDataFrame(data, "y double, twice double, flat double, minus double")
    got = by(leakage.correlations(df, "y"), "column")
    assert got["twice"]["correlation"] == pytest.approx(1)
    assert got["minus"]["correlation"] == pytest.approx(-1)
    assert got["flat"]["correlation"] is None
    found = by(leakage.leakage_findings(df, "y"), "column")
    assert found["minus"]["severity"] == "block"
    assert leakage.deny_list(leakage.leakage_findings(df, "y")) == ["minus", "twice"]


def test_text_target_has_no_correlations(spark):
    df = spark.createDataFrame([("a", 1.0)], "y string, x double")
    assert rows(leakage.correlations(df, "y")) == []
    assert rows(leakage.leakage_verdict(leakage.leakage_findings(df, "y"), 1))[0]["status"] == "pass"


def test_names_match_parts_first_pattern_wins(spark):
    df = spark.createDataFrame([(1, 1, 1, 1)], "Width int, classkey int, plain int, label int")
    got = by(leakage.name_findings(df, "label"), "column")
    assert {c: r["pattern"] for c, r in got.items()} == {"Width": "id", "classkey": "key"}


def test_time_column_checks(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0), (None, 2.0)], "at string, y double")
    assert rows(leakage.time_findings(df, "at")) == []
    bad = df.union(spark.createDataFrame([("soon", 3.0)], "at string, y double"))
    assert rows(leakage.time_findings(bad, "at"))[0]["severity"] == "warn"
    assert rows(leakage.time_findings(df, "none"))[0]["issue"] == "missing_time_column"
    found = leakage.leakage_findings(df, "y", "time", "none")
    assert rows(leakage.leakage_verdict(found, 1))[0]["status"] == "block"
    found = leakage.leakage_findings(df, "zzz")
    assert rows(found) == []
    assert rows(leakage.leakage_verdict(found, 1, target_present=False))[0]["status"] == "block"


def test_feature_pairs_and_outliers(spark):
    data = [(float(i), float(i) * 3, float((i * 7919) % 100), 1000.0 if i == 5 else float(i % 5)) for i in range(100)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double")
    got = rows(exploration.feature_correlations(df))
    assert [(r["feature1"], r["feature2"]) for r in got] == [("a", "b")]
    assert [(r["column"], r["n_outliers"]) for r in rows(exploration.outliers(df))] == [("d", 1)]


@pytest.mark.parametrize("block", [2, 3, 500])
def test_correlations_of_columns_with_gaps(spark, block):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6)) + [0, 1e6, 5, -3, 0, 0]
    data[:, 4] = 7.0
    table = [tuple(None if rng.random() < 0.2 else float(v) for v in row) + (None,) for row in data]
    table[0] = (*table[0][:5], float("nan"), None)
    names = [f"c{i}" for i in range(6)] + ["void"]
    df = spark.createDataFrame(table, ", ".join(f"{c} double" for c in names)).repartition(3)
    got = exploration.pair_correlations(df, names, block)
    plain = pd.DataFrame(table, columns=names).astype(float).corr().to_numpy()
    plain[4, :] = plain[:, 4] = np.nan
    off = ~np.eye(7, dtype=bool)
    assert np.allclose(got[off], plain[off], equal_nan=True, atol=1e-9)


def test_five_hundred_columns_in_one_scan(spark):
    names = [f"c{i}" for i in range(500)]
    df = spark.range(40).select(*[F.sin(F.col("id") * (i + 1)).alias(c) for i, c in enumerate(names)])
    found = exploration.feature_correlations(df, names, 0.999999)
    assert found.count() == sum(
        abs(r) > 0.999999 for i, row in enumerate(df.toPandas().corr().to_numpy()) for r in row[i + 1 :]
    )
