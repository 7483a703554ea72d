"""Classification, regression and ranking metrics of a scored table, and model ranking.

Every metric takes ``by`` columns and is computed for all groups in one pass:
slices, bootstrap replicates, folds and feature variants are just groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from ..functions.ordering import running_totals
from ..functions.storage import stored

CLASSIFICATION = ("accuracy", "f1_score", "precision", "recall")
REGRESSION = ("mae", "rmse", "r2", "mape")
# Metrics where smaller is better, and the floor of the mape divisor.
LOWER_IS_BETTER = ("mae", "rmse", "mape")
MAPE_FLOOR = 1e-8


def _labels(df: DataFrame, y: str, yhat: str) -> tuple[Column, Column]:
    """Truth and prediction in one type, so that 1 and 1.0 are the same class."""
    a, b = df.schema[y].dataType, df.schema[yhat].dataType
    if a == b:
        return col(y), col(yhat)
    to = "double" if isinstance(a, T.NumericType) and isinstance(b, T.NumericType) else "string"
    return col(y).cast(to), col(yhat).cast(to)


def confusion(df: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()) -> DataFrame:
    """``y, yhat, n`` (per group): the confusion matrix in long form.

    Counted on the map side first, so a class with a third of all rows is one
    partial row per task.
    """
    truth, guess = _labels(df, y, yhat)
    return (
        df.select(*[col(b) for b in by], truth.alias("y"), guess.alias("yhat"))
        .where(F.col("y").isNotNull())
        .groupBy(*by, "y", "yhat")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def class_report(cells: DataFrame, by: Sequence[str] = (), n: str = "n") -> DataFrame:
    """Per class: support, predicted, precision, recall, f1_score (0 where undefined)."""
    one, zero = F.col(n), F.lit(0).cast(cells.schema[n].dataType)
    rows = [
        F.struct(
            F.col("y").alias("class"),
            one.alias("support"),
            zero.alias("predicted"),
            F.when(F.col("y") == F.col("yhat"), one).otherwise(zero).alias("hits"),
        ),
        F.struct(
            F.col("yhat").alias("class"), zero.alias("support"), one.alias("predicted"), zero.alias("hits")
        ),
    ]
    sides = cells.select(*by, F.inline(F.array(*rows)))
    totals = sides.groupBy(*by, "class").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "hits")]
    )
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    support, predicted, hits = F.col("support"), F.col("predicted"), F.col("hits")
    return totals.select(
        *by,
        "class",
        "support",
        "predicted",
        "hits",
        share(hits, predicted).alias("precision"),
        share(hits, support).alias("recall"),
        share(2 * hits, support + predicted).alias("f1_score"),
    )


def metrics_of_cells(cells: DataFrame, by: Sequence[str] = (), n: str = "n") -> DataFrame:
    """Accuracy and support-weighted f1, precision and recall from confusion cells."""
    report = class_report(cells, by, n)
    total = F.sum("support")
    weighted = lambda c: F.try_divide(F.sum(F.col(c) * F.col("support")), total)
    return report.groupBy(*by).agg(
        total.cast("bigint").alias("n_rows"),
        F.try_divide(F.sum("hits").cast("double"), total.cast("double")).alias("accuracy"),
        *[weighted(c).alias(c) for c in ("f1_score", "precision", "recall")],
    )


def classification_metrics(
    df: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()
) -> DataFrame:
    return metrics_of_cells(confusion(df, y, yhat, by), by)


def error_sums(truth: Column, guess: Column) -> dict[str, Column]:
    """The per-row terms whose sums give every regression metric."""
    error = truth - guess
    return {
        "n": F.lit(1.0),
        "abs": F.abs(error),
        "sq": error * error,
        "rel": F.abs(error) / F.greatest(F.abs(truth), F.lit(MAPE_FLOOR)),
    }


def _r2(residual: Column, total: Column) -> Column:
    perfect = F.when(residual == 0, 1.0).otherwise(0.0)
    return F.when(total == 0, perfect).otherwise(1 - F.try_divide(residual, total))


def regression_metrics(
    df: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()
) -> DataFrame:
    """mae, rmse, r2 and mape (percent) in one aggregate; rows with a gap are left out."""
    pair = df.select(
        *[col(b) for b in by], col(y).cast("double").alias("_y"), col(yhat).cast("double").alias("_yhat")
    )
    terms = error_sums(F.col("_y"), F.col("_yhat"))
    n = F.count(terms["abs"])
    truth = F.when(F.col("_yhat").isNotNull(), F.col("_y"))
    return (
        pair.groupBy(*by)
        .agg(
            n.alias("n_rows"),
            F.avg(terms["abs"]).alias("mae"),
            F.sqrt(F.avg(terms["sq"])).alias("rmse"),
            _r2(F.sum(terms["sq"]), F.var_pop(truth) * n).alias("r2"),
            (F.avg(terms["rel"]) * 100).alias("mape"),
        )
        .where((F.col("n_rows") > 0) | F.lit(not by))
    )


def task_metrics(
    df: DataFrame, task: str, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()
) -> DataFrame:
    if task == "classification":
        return classification_metrics(df, y, yhat, by)
    if task == "regression":
        return regression_metrics(df, y, yhat, by)
    raise ValueError(f"Unknown task: {task}")


def to_long(metrics: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``metric, value`` rows from a table with one column per metric."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names]
    return metrics.select(*by, F.inline(F.array(*rows)))


# --- ranking of scores ------------------------------------------------------


@dataclass(frozen=True)
class Labels:
    """The larger of two labels, and the number of rows of each."""

    positive: object
    n_pos: int
    n_neg: int


def two_labels(scored: DataFrame, y: str) -> Labels | None:
    """The labels of a scored table when there are exactly two, else None."""
    tally = scored.groupBy(col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    found = sorted((r["y"], r["n"]) for r in tally.limit(3).collect())
    return Labels(found[1][0], found[1][1], found[0][1]) if len(found) == 2 else None


def _scored(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.where(col(y).isNotNull() & col(p).isNotNull())


def score_points(
    df: DataFrame, y: str = "y", p: str = "p", buckets: int | None = None
) -> tuple[DataFrame, Labels] | None:
    """``p, pos, neg, cum_pos, cum_neg`` per distinct score, highest score first, and the labels.

    The rows are read once, into a count per score and label; all else works on these.
    None unless there are two labels.
    """
    counted = stored(
        _scored(df, y, p).groupBy(col(p).cast("double").alias("p"), col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    )
    tally = counted.groupBy("y").agg(F.sum("n").alias("n")).limit(3).collect()
    found = sorted((r["y"], r["n"]) for r in tally)
    if len(found) != 2:
        return None
    labels = Labels(found[1][0], found[1][1], found[0][1])
    hit = F.col("y") == F.lit(labels.positive)
    count = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
    points = counted.groupBy("p").agg(count(hit).alias("pos"), count(~hit).alias("neg"))
    return running_totals(points, "p", {"cum_pos": "pos", "cum_neg": "neg"}, True, buckets), labels


def ranking_metrics(
    df: DataFrame, y: str = "y", p: str = "p", buckets: int | None = None
) -> DataFrame:
    """One row ``roc_auc, pr_auc``; tied scores count one half, pr_auc is average precision.

    NULL for both unless there are exactly two labels.
    """
    found = score_points(df, y, p, buckets)
    if found is None:
        return df.sparkSession.createDataFrame([(None, None)], "roc_auc double, pr_auc double")
    points, labels = found
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    higher = F.col("cum_pos") - F.col("pos")
    return points.agg(
        (F.sum(neg * (higher + pos / 2)) / F.lit(float(labels.n_pos) * labels.n_neg)).alias("roc_auc"),
        (F.sum(pos * precision) / F.lit(float(labels.n_pos))).alias("pr_auc"),
    )


def evaluate(
    df: DataFrame, task: str, y: str = "y", yhat: str = "yhat", p: str | None = None
) -> DataFrame:
    """All metrics of a scored table as ``metric, value`` rows."""
    if task == "regression":
        return to_long(regression_metrics(df, y, yhat), REGRESSION)
    found = to_long(classification_metrics(df, y, yhat), CLASSIFICATION)
    if p is not None:
        ranked = to_long(ranking_metrics(df, y, p), ("roc_auc", "pr_auc"))
        found = found.unionByName(ranked.where(F.col("value").isNotNull()))
    return found


# --- ranking of models ------------------------------------------------------


def rank_models(results: DataFrame, primary: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank models by one metric, best first.

    ``results`` has one row per model: ``model_id`` and a column per metric. A
    model without the metric is left out; equal scores rank in model order.
    """
    if primary not in results.columns:
        return results.limit(0).select(
            *by, F.lit(0).alias("rank"), "model_id", F.lit(0.0).alias("primary_score")
        )
    score = F.col(primary).cast("double")
    best_first = score.asc() if primary in LOWER_IS_BETTER else score.desc()
    group = list(by) or [F.lit(0)]  # one row per model
    order = Window.partitionBy(*group).orderBy(best_first, F.col("model_id"))
    others = [c for c in results.columns if c not in {*by, "model_id"}]
    return results.where(score.isNotNull()).select(
        *by,
        F.row_number().over(order).alias("rank"),
        "model_id",
        score.alias("primary_score"),
        *others,
    )


def top_models(ranking: DataFrame, k: int = 3) -> DataFrame:
    return ranking.where(F.col("rank") <= k)


def residual_bins(df: DataFrame, y: str = "y", yhat: str = "yhat", n_bins: int = 10) -> DataFrame:
    """Residual count, mean and sample std in equal-width bins of the prediction."""
    guess, error = col(yhat).cast("double"), col(y).cast("double") - col(yhat).cast("double")
    low, high = df.agg(F.min(guess), F.max(guess)).first()
    if low is None:
        return df.sparkSession.createDataFrame(
            [], "bin int, n_rows bigint, mean_residual double, std_residual double"
        )
    width = (high - low) / n_bins or 1.0
    at = F.least(F.floor((guess - F.lit(low)) / F.lit(width)), F.lit(n_bins - 1)).cast("int")
    return (
        df.where(error.isNotNull())
        .groupBy(at.alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.avg(error).alias("mean_residual"),
            F.stddev_samp(error).alias("std_residual"),
        )
    )
