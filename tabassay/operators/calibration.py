"""Probability calibration of a fitted classifier on held-out rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.storage import kept
from .curves import brier, ece

METHODS = ("isotonic", "sigmoid")


@dataclass
class Calibrator:
    method: str
    model: object

    def transform(self, df: DataFrame, p: str = "p", out: str = "p_calibrated") -> DataFrame:
        """Add the calibrated probability of score ``p``."""
        kept = [col(c) for c in df.columns]
        vectors = _vectors(df.withColumn("_score", col(p).cast("double")))
        scored = self.model.transform(vectors)
        if self.method == "isotonic":
            return scored.select(*kept, F.col("prediction").alias(out))
        return scored.select(*kept, vector_to_array("probability")[1].alias(out))


def _vectors(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=["_score"], outputCol="features").transform(df)


def fit_calibrator(
    scored: DataFrame, y: str = "y", p: str = "p", method: str = "isotonic"
) -> Calibrator:
    """Fit on a scored table with y 0 or 1.

    Copies of a score are combined into weighted points first, so the fit works
    on distinct scores. Sigmoid uses the smoothed targets (n1 + 1) / (n1 + 2)
    and 1 / (n0 + 2) as weights of the two outcomes.
    """
    if method not in METHODS:
        raise ValueError(f"Unknown calibration method: {method}")
    truth = col(y).cast("double")
    points = (
        scored.where(truth.isNotNull() & col(p).isNotNull())
        .groupBy(col(p).cast("double").alias("_score"))
        .agg(F.sum(truth).alias("ones"), F.sum(1 - truth).alias("zeros"))
    )
    with kept(points):
        return _fit(points, method)


def _fit(points: DataFrame, method: str) -> Calibrator:
    if method == "isotonic":
        n = F.col("ones") + F.col("zeros")
        weighted = _vectors(points.select("_score", (F.col("ones") / n).alias("label"), n.alias("n")))
        return Calibrator(
            method, IsotonicRegression(labelCol="label", weightCol="n").fit(weighted)
        )
    n1, n0 = points.agg(F.sum("ones"), F.sum("zeros")).first()
    high, low = (n1 + 1) / (n1 + 2), 1 / (n0 + 2)
    outcomes = F.array(
        F.struct(
            F.lit(1.0).alias("label"),
            (F.col("ones") * high + F.col("zeros") * low).alias("n"),
        ),
        F.struct(
            F.lit(0.0).alias("label"),
            (F.col("ones") * (1 - high) + F.col("zeros") * (1 - low)).alias("n"),
        ),
    )
    weighted = _vectors(points.select("_score", F.inline(outcomes)))
    sigmoid = LogisticRegression(labelCol="label", weightCol="n", regParam=0.0, tol=1e-10)
    return Calibrator(method, sigmoid.fit(weighted))


def calibration_report(
    scored: DataFrame, y: str = "y", before: str = "p", after: str = "p_calibrated"
) -> DataFrame:
    """One row: ece and Brier score before and after, and the improvements."""
    two = F.array(
        F.struct(F.lit("before").alias("stage"), col(before).alias("p"), col(y).alias("y")),
        F.struct(F.lit("after").alias("stage"), col(after).alias("p"), col(y).alias("y")),
    )
    stages = scored.select(F.inline(two))
    measured = ece(stages, by=["stage"]).join(brier(stages, by=["stage"]), "stage")  # two rows
    at = lambda metric, stage: F.max(F.when(F.col("stage") == stage, F.col(metric)))
    out = measured.agg(
        *[at(m, s).alias(f"{m}_{s}") for m in ("ece", "brier") for s in ("before", "after")]
    )
    return out.select(
        "ece_before",
        "ece_after",
        (F.col("ece_before") - F.col("ece_after")).alias("ece_improvement"),
        "brier_before",
        "brier_after",
        (F.col("brier_before") - F.col("brier_after")).alias("brier_improvement"),
    )


def calibrate(
    scored: DataFrame, y: str = "y", p: str = "p", method: str = "isotonic"
) -> tuple[DataFrame, Calibrator | None]:
    """Fit and apply; a table without probabilities is returned unchanged."""
    if p not in scored.columns:
        return scored, None
    fitted = fit_calibrator(scored, y, p, method)
    return fitted.transform(scored, p), fitted
