"""Tables behind precision-recall, lift, calibration and bar charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.hashing import uniform
from ..functions.ordering import rank_cuts
from ..functions.storage import kept
from .metrics import score_points, two_labels

# Shares 0.1, 0.2, ... 1.0 of a lift curve as running doubles
# (the third is 0.30000000000000004), and the number of calibration bins.
LIFT_SHARES = tuple(0.1 + i * 0.1 for i in range(10))
BINS = 10


def pr_curve(
    df: DataFrame, y: str = "y", p: str = "p", buckets: int | None = None
) -> DataFrame:
    """``threshold, precision, recall`` at each distinct score. Empty unless binary."""
    found = score_points(df, y, p, buckets)
    if found is None:
        return df.sparkSession.createDataFrame(
            [], "threshold double, precision double, recall double"
        )
    points, labels = found
    return points.select(
        F.col("p").alias("threshold"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        (F.col("cum_pos") / F.lit(labels.n_pos)).alias("recall"),
    )


def optimal_threshold(curve: DataFrame) -> DataFrame:
    """The threshold with the largest precision + recall, the lowest one on a tie."""
    gain = F.col("precision") + F.col("recall")
    return curve.agg(
        F.max_by("threshold", F.struct(gain, -F.col("threshold"))).alias("optimal_threshold")
    )


def operating_point(curve: DataFrame) -> DataFrame:
    """The threshold with the largest f1, with its precision and recall."""
    f1 = F.coalesce(
        F.try_divide(
            2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
        ),
        F.lit(0.0),
    )
    point = F.struct("threshold", "precision", "recall", f1.alias("f1"))
    return curve.agg(F.max_by(point, F.struct(f1, -F.col("threshold"))).alias("best")).select(
        "best.*"
    )


def lift_curve(
    df: DataFrame,
    keys: Sequence[Column | str],
    y: str = "y",
    p: str = "p",
    shares: Sequence[float] = LIFT_SHARES,
    seed: int = 42,
) -> DataFrame:
    """Positive rate among the rows scored highest, over the base rate, per share.

    The rows above each cut are counted by comparing with the row at the cut, so
    nothing is sorted. Equal scores are ordered by the hash of the key.
    """
    schema = "share double, n_top bigint, positives bigint, lift double"
    needed = df.where(col(y).isNotNull() & col(p).isNotNull()).select(
        col(p).cast("double").alias("p"),
        col(y).alias("y"),
        uniform(keys, seed, "lift").alias("u"),
        uniform(keys, seed, "lift tie").alias("tie"),
    )
    with kept(needed) as scored:
        labels = two_labels(scored, "y")
        if labels is None:
            return df.sparkSession.createDataFrame([], schema)
        n_pos, n = labels.n_pos, labels.n_pos + labels.n_neg
        hit = F.col("y") == F.lit(labels.positive)
        tops = {share: int(share * n) for share in shares if int(share * n) > 0}
        order = [-F.col("p"), F.col("u"), F.col("tie")]
        cuts = rank_cuts(scored, order, {"top": (F.lit(True), n, list(tops.values()))})
        found = scored.agg(
            F.count(F.lit(1)), *[F.count_if(hit & cuts[("top", k)]) for k in tops.values()]
        ).first()
    rows = [(share, k, hits, hits / k / (n_pos / n)) for (share, k), hits in zip(tops.items(), found[1:])]
    return df.sparkSession.createDataFrame(rows, schema)


def lift_summary(curve: DataFrame) -> DataFrame:
    """Largest lift, and the lift of the first share (1.0 without any)."""
    return curve.agg(
        F.coalesce(F.max("lift"), F.lit(1.0)).alias("max_lift"),
        F.coalesce(F.min_by("lift", "share"), F.lit(1.0)).alias("lift_at_10pct"),
    )


def bin_edges(n_bins: int = BINS) -> list[float]:
    """Equal steps from 0 to 1, each edge being its index times the step."""
    return [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]


def probability_bin(p: Column, closed: str = "right", n_bins: int = BINS) -> Column:
    """0-based bin of a probability, NULL outside all bins.

    ``closed='right'``: bins (low, high], so exactly 0 is in none. ``'left'``:
    bins [low, high), the last one closed.
    """
    edges = bin_edges(n_bins)
    out = F.lit(None).cast("int")
    for i in reversed(range(n_bins)):
        low, high = F.lit(edges[i]), F.lit(edges[i + 1])
        if closed == "right":
            inside = (p > low) & (p <= high)
        else:
            inside = (p >= low) & ((p <= high) if i == n_bins - 1 else (p < high))
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def calibration_curve(
    df: DataFrame,
    y: str = "y",
    p: str = "p",
    closed: str = "left",
    n_bins: int = BINS,
    by: Sequence[str] = (),
) -> DataFrame:
    """``bin, center, mean_p, accuracy, n_rows`` of each bin that holds rows (y is 0 or 1)."""
    return _bins(df, y, p, closed, n_bins, by).where(F.col("n_rows") > 0).drop("total")


def _bins(df, y, p, closed, n_bins, by) -> DataFrame:
    edges = bin_edges(n_bins)
    score, truth = col(p).cast("double"), col(y).cast("double")
    centers = F.array(*[F.lit((a + b) / 2) for a, b in zip(edges, edges[1:])])
    at = probability_bin(score, closed, n_bins).alias("bin")
    return (
        df.select(*by, at, score.alias("_p"), truth.alias("_y"))
        .groupBy(*by, "bin")
        .agg(
            F.avg("_p").alias("mean_p"),
            F.avg("_y").alias("accuracy"),
            F.count("bin").alias("n_rows"),  # 0 for the rows in no bin
            F.count(F.lit(1)).alias("total"),
        )
        .select(
            *by,
            "bin",
            F.get(centers, F.col("bin")).alias("center"),
            "mean_p",
            "accuracy",
            "n_rows",
            "total",
        )
    )


def ece(
    df: DataFrame,
    y: str = "y",
    p: str = "p",
    closed: str = "right",
    at: str = "mean_p",
    n_bins: int = BINS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Expected calibration error; the weight of a bin is its share of all rows.

    Two conventions: ``closed='right', at='mean_p'`` compares with the mean
    probability of a bin, ``closed='left', at='center'`` with its centre. Rows in
    no bin count as rows and add no error.
    """
    gap = F.abs(F.col(at) - F.col("accuracy")) * F.col("n_rows")
    rows = F.sum("total")
    return (
        _bins(df, y, p, closed, n_bins, by)
        .groupBy(*by)
        .agg(F.when(rows > 0, F.coalesce(F.sum(gap), F.lit(0.0)) / rows).alias("ece"))
    )


def brier(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Mean squared difference of probability and outcome."""
    gap = col(p).cast("double") - col(y).cast("double")
    return df.groupBy(*by).agg(F.avg(gap * gap).alias("brier"))


def bars(df: DataFrame, category: str, value: str | None = None, how: str = "sum") -> DataFrame:
    """``category, value``: one bar per category; counts rows without a value column."""
    if category not in df.columns:
        raise ValueError(f"Column '{category}' not found")
    if value is None:
        height = F.count(F.lit(1)).cast("double")
    else:
        choices = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
        if how not in choices:
            raise ValueError(f"Unknown aggregate: {how}")
        height = choices[how](col(value)).cast("double")
    return df.groupBy(col(category).alias("category")).agg(height.alias("value"))
