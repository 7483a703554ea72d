"""Metrics per value of sensitive columns, and the gaps between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, is_missing
from .metrics import classification_metrics, regression_metrics

# Gaps reported as medium and as high.
ACCURACY_GAP = (0.1, 0.2)
MAE_RATIO = (1.5, 2.0)

_METRICS = "column string, slice string, accuracy double, f1_score double, sample_size bigint"
_ERRORS = "column string, slice string, mae double, sample_size bigint"


def slice_metrics(
    df: DataFrame, sensitive: Sequence[str], task: str, y: str = "y", yhat: str = "yhat"
) -> DataFrame:
    """Metrics of every value of every sensitive column, in one pass.

    Columns the table lacks are skipped; rows without a value are in no slice.
    """
    if task not in ("classification", "regression"):
        raise ValueError(f"Unknown task: {task}")
    available = [c for c in sensitive if c in df.columns]
    if not available:
        schema = _METRICS if task == "classification" else _ERRORS
        return df.sparkSession.createDataFrame([], schema)
    slices = [
        F.struct(
            F.lit(c).alias("column"),
            F.when(~is_missing(df, c), col(c).cast("string")).alias("slice"),
        )
        for c in available
    ]
    long = df.select(
        col(y).alias("y"), col(yhat).alias("yhat"), F.inline(F.array(*slices))
    ).where(F.col("slice").isNotNull())
    if task == "classification":
        return classification_metrics(long, by=["column", "slice"]).select(
            "column", "slice", "accuracy", "f1_score", F.col("n_rows").alias("sample_size")
        )
    return regression_metrics(long, by=["column", "slice"]).select(
        "column", "slice", "mae", F.col("n_rows").alias("sample_size")
    )


def disparity(slices: DataFrame) -> DataFrame:
    """``column, metric, disparity, severity`` for columns with a notable gap.

    Accuracy: largest minus smallest. mae: largest over smallest, infinite when
    the smallest is 0. A column with one slice has no gap.
    """
    accuracy = "accuracy" in slices.columns
    metric = "accuracy" if accuracy else "mae"
    medium, high = ACCURACY_GAP if accuracy else MAE_RATIO
    most, least = F.col("most"), F.col("least")
    gap = (
        most - least
        if accuracy
        else F.when(least > 0, F.try_divide(most, least)).otherwise(F.lit(float("inf")))
    )
    return (
        slices.groupBy("column")
        .agg(
            F.max(metric).alias("most"),
            F.min(metric).alias("least"),
            F.count(metric).alias("n_slices"),
        )
        .where(F.col("n_slices") >= 2)
        .select("column", F.lit(metric).alias("metric"), gap.alias("disparity"))
        .where(F.col("disparity") > medium)
        .withColumn("severity", F.when(F.col("disparity") > high, "high").otherwise("medium"))
    )


def fairness_summary(slices: DataFrame) -> DataFrame:
    """One row ``status, total_issues``."""
    none_at_all = slices.agg(F.count(F.lit(1)).alias("n_slices"), F.lit(0).alias("issues"))
    issues = disparity(slices).agg(F.lit(0).alias("n_slices"), F.count(F.lit(1)).alias("issues"))
    both = none_at_all.unionByName(issues).agg(
        F.sum("n_slices").alias("n_slices"), F.sum("issues").alias("total_issues")
    )
    status = (
        F.when(F.col("n_slices") == 0, "no_sensitive_columns")
        .when(F.col("total_issues") > 0, "issues_found")
        .otherwise("no_issues")
    )
    return both.select(status.alias("status"), "total_issues")


def require_fair(slices: DataFrame, action: str = "warn") -> DataFrame:
    """The disparities; with ``action='block'`` a high one raises."""
    if action not in ("warn", "block"):
        raise ValueError(f"Unknown action: {action}")
    found = disparity(slices)
    if action == "block":
        bad = [r["column"] for r in found.where(F.col("severity") == "high").collect()]
        if bad:
            raise ValueError(f"High disparity in: {', '.join(sorted(bad))}")
    return found
