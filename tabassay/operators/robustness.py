"""How much a model loses when features are ablated, go missing or get noisy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, kind, number
from ..functions.hashing import normal, uniform
from .metrics import classification_metrics, regression_metrics
from .models import TrainedModel
from .profile import mode

# Share of cells lost, noise in units of a column's std, the drops
# up to which a test passes, and the number of features ablated.
MISSING_SHARE = 0.1
NOISE_SCALE = 0.1
ALLOWED_DROP = {"missing_values": 0.1, "noise_injection": 0.05}
TOP_FEATURES = 5
SEED = 42

BASELINE = "baseline"


def ablate(df: DataFrame, name: str) -> DataFrame:
    """Replace a column by its mean, or by its mode when it is not numeric."""
    if kind(df.schema[name].dataType) == "numeric":
        stat = F.lit(df.agg(F.avg(number(df, name))).first()[0]).cast("double")
    else:
        stat = mode(df, name)
    return df.withColumn(name, stat)


def _lost(value: Column, name: str, keys: Sequence[Column | str], seed: int) -> Column:
    return F.when(uniform(keys, seed, "missing " + name) >= MISSING_SHARE, value)


def missing_shock(
    df: DataFrame, columns: Sequence[str], keys: Sequence[Column | str], seed: int = SEED
) -> DataFrame:
    """Lose a tenth of the cells of numeric columns, then fill them with the mean of the rest."""
    left = {c: _lost(number(df, c), c, keys, seed) for c in columns}
    means = df.agg(*[F.avg(v).alias(f"a{i}") for i, v in enumerate(left.values())]).first()
    filled = {
        c: F.coalesce(v, F.lit(means[i]).cast("double")) for i, (c, v) in enumerate(left.items())
    }
    return df.select(*[filled.get(c, col(c)).alias(c) for c in df.columns])


def noise_shock(
    df: DataFrame, columns: Sequence[str], keys: Sequence[Column | str], seed: int = SEED
) -> DataFrame:
    """Add normal noise of a tenth of the sample std to numeric columns."""
    row = df.agg(*[F.stddev_samp(number(df, c)).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    noisy = {
        c: number(df, c) + F.lit((row[i] or 0.0) * NOISE_SCALE) * normal(keys, seed, "noise " + c)
        for i, c in enumerate(columns)
    }
    return df.select(*[noisy.get(c, col(c)).alias(c) for c in df.columns])


def _variant_scores(
    df: DataFrame, fitted: TrainedModel, target: str, variants: dict[str, dict[str, Column]]
) -> dict[str, float]:
    """Accuracy or mae of the model on each variant of its features.

    All variants are scored in one pass: each row becomes one row per variant
    (a fixed few) and the metric is grouped by variant.
    """
    rows = [
        F.struct(
            F.lit(name).alias("variant"),
            F.array(
                *[changed.get(c, col(c)).cast("double") for c in fitted.features]
            ).alias("cells"),
        )
        for name, changed in variants.items()
    ]
    long = df.select(col(target), F.inline(F.array(*rows)))
    scored = fitted.score_vectors(
        long.select(col(target), "variant", array_to_vector("cells").alias("features"))
    )
    if fitted.task == "classification":
        found = classification_metrics(scored, target, "yhat", ["variant"]).select(
            "variant", F.col("accuracy").alias("score")
        )
    else:
        found = regression_metrics(scored, target, "yhat", ["variant"]).select(
            "variant", F.col("mae").alias("score")
        )
    return {r["variant"]: r["score"] for r in found.collect()}  # one row per variant


def _drop(fitted: TrainedModel, baseline: float, score: float) -> float:
    return baseline - score if fitted.task == "classification" else score - baseline


def top_features(fitted: TrainedModel, k: int = TOP_FEATURES) -> list[tuple[str, float]]:
    """The k features with the largest importance; without any, the first k with weight 1."""
    weights = fitted.importances()
    if not weights:
        return [(c, 1.0) for c in fitted.features[:k]]
    return sorted(weights.items(), key=lambda w: -w[1])[:k]


def feature_importance(df: DataFrame, fitted: TrainedModel) -> DataFrame:
    rows = list(fitted.importances().items())
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def ablation(
    val: DataFrame, fitted: TrainedModel, target: str, k: int = TOP_FEATURES
) -> DataFrame:
    """``feature, importance, baseline_score, ablated_score, performance_drop`` per top feature."""
    chosen = top_features(fitted, k)
    schema = (
        "feature string, importance double, baseline_score double, "
        "ablated_score double, performance_drop double"
    )
    if not chosen:
        return val.sparkSession.createDataFrame([], schema)
    means = val.agg(*[F.avg(col(c).cast("double")) for c, _ in chosen]).first()
    variants: dict[str, dict[str, Column]] = {BASELINE: {}}
    for i, (c, _) in enumerate(chosen):
        variants[f"without {c}"] = {c: F.lit(means[i]).cast("double")}
    scores = _variant_scores(val, fitted, target, variants)
    base = scores[BASELINE]
    rows = [
        (c, w, base, scores[f"without {c}"], _drop(fitted, base, scores[f"without {c}"]))
        for c, w in chosen
    ]
    return val.sparkSession.createDataFrame(rows, schema)


def shock_tests(
    val: DataFrame,
    fitted: TrainedModel,
    target: str,
    keys: Sequence[Column | str],
    seed: int = SEED,
) -> DataFrame:
    """``test, baseline_score, score, performance_drop, passed`` of both shocks."""
    features = fitted.features
    left = {c: _lost(col(c).cast("double"), c, keys, seed) for c in features}
    stats = val.agg(
        *[F.struct(F.avg(left[c]), F.stddev_samp(col(c).cast("double"))).alias(f"s{i}") for i, c in enumerate(features)]
    ).first()
    numeric = [c for c in features if kind(val.schema[c].dataType) == "numeric"]
    variants: dict[str, dict[str, Column]] = {
        BASELINE: {},
        "missing_values": {
            c: F.coalesce(left[c], F.lit(stats[i][0]).cast("double")) for i, c in enumerate(features)
        },
    }
    if numeric:
        variants["noise_injection"] = {
            c: col(c).cast("double")
            + F.lit((stats[i][1] or 0.0) * NOISE_SCALE) * normal(keys, seed, "noise " + c)
            for i, c in enumerate(features)
            if c in numeric
        }
    scores = _variant_scores(val, fitted, target, variants)
    base = scores[BASELINE]
    rows = []
    for test in variants:
        if test == BASELINE:
            continue
        drop = _drop(fitted, base, scores[test]) if test in scores else float("inf")
        rows.append((test, base, scores.get(test), drop, drop < ALLOWED_DROP[test]))
    return val.sparkSession.createDataFrame(
        rows, "test string, baseline_score double, score double, performance_drop double, passed boolean"
    )


def grade(shocks: DataFrame) -> DataFrame:
    """One row: grade A to D, tests passed, total and pass rate; C without any test."""
    passed, total = F.col("passed_tests"), F.col("total_tests")
    letter = (
        F.when(total == 0, "C")
        .when(passed == total, "A")
        .when(passed >= total * 0.75, "B")
        .when(passed >= total * 0.5, "C")
        .otherwise("D")
    )
    return shocks.agg(
        F.count_if("passed").alias("passed_tests"), F.count(F.lit(1)).alias("total_tests")
    ).select(
        letter.alias("resilience_grade"),
        "passed_tests",
        "total_tests",
        F.coalesce(F.try_divide(passed, total), F.lit(0.0)).cast("double").alias("pass_rate"),
    )


def drop_summary(results: DataFrame) -> DataFrame:
    """Largest and mean performance drop (0 without results)."""
    return results.agg(
        F.coalesce(F.max("performance_drop"), F.lit(0.0)).alias("max_performance_drop"),
        F.coalesce(F.avg("performance_drop"), F.lit(0.0)).alias("avg_performance_drop"),
    )
