"""Bootstrap confidence intervals from sums instead of from resampled rows.

All seven metrics depend on the rows through sums only. Rows are first summed
into a bounded number of units by the hash of their key, then the units are
resampled with Poisson(1) weights. The cost after that first pass is units times
replicates, whatever the size of the table. The rule is the same for every size.

``method="exact"`` resamples rows instead: as many draws with replacement as there are
rows, per replicate. Its cost is rows times replicates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.hashing import key_text, poisson1, uniform
from ..functions.ordering import numbered
from ..functions.storage import stored
from .metrics import CLASSIFICATION, _labels, _r2, error_sums, metrics_of_cells

# Replicates, confidence and seed of an interval.
REPLICATES = 1000
CONFIDENCE = 0.95
SEED = 42
UNITS = 1000
METHODS = ("poisson", "exact")
# Weights up to which they are drawn once and broadcast.
BROADCAST_WEIGHTS = 4_000_000

METRICS = ("accuracy", "f1_score", "precision", "recall", "mae", "rmse", "r2")


def _units(
    df: DataFrame, keys: Sequence[Column | str], units: int, seed: int
) -> tuple[Column, DataFrame]:
    """The unit of a row, and the table of all units."""
    if units < 1:
        raise ValueError("units must be positive")
    unit = F.floor(uniform(keys, seed, "unit") * units).cast("int").cast("string")
    return unit.alias("unit"), df.sparkSession.range(units).select(F.col("id").cast("string").alias("unit"))


def _weighted(sums: DataFrame, units: DataFrame, n_units: int, replicates: int, seed: int) -> DataFrame:
    """Each row of a table of units once per replicate, with the weight of its unit there.

    Weights are drawn once per unit and replicate and broadcast, up to BROADCAST_WEIGHTS
    small integers; beyond that each row draws its own, by the same rule. Both tables
    are small enough to end up in one partition, so they are spread over the cores
    before they multiply.
    """
    cores = sums.sparkSession.sparkContext.defaultParallelism
    draw = lambda r: poisson1(uniform(["unit", r], seed, "weight"))
    if n_units * replicates > BROADCAST_WEIGHTS:
        each = sums.repartition(cores).select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
        return each.withColumn("weight", draw(F.col("replicate")))
    weights = units.repartition(cores).select(
        "unit", F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), draw).alias("weights")
    )
    drawn = sums.repartition(cores).join(F.broadcast(weights), "unit")
    return drawn.select("*", F.posexplode("weights").alias("replicate", "weight")).drop("weights")


def exact_weights(rows: DataFrame, keys: Sequence[Column | str], replicates: int, seed: int) -> DataFrame:
    """Each row once per replicate that draws it, with how often: as many draws as rows, with replacement.

    Rows are numbered by the hash of their key, a draw is the hash of replicate and
    draw number. Draws are made where they are counted, and meet the rows by their
    number: nothing but counts is shuffled twice.
    """
    return _drawn(rows, key_text(keys), replicates, seed)


def _drawn(rows: DataFrame, key: Column, replicates: int, seed: int) -> DataFrame:
    placed = numbered(rows, [uniform([key], seed, "place"), uniform([key], seed, "place tie"), key])
    n = placed.count()
    spark = rows.sparkSession
    spots = F.floor(uniform(["replicate", "draw"], seed, "draw") * n).cast("bigint")
    draws = (
        spark.range(n * replicates)
        .select((F.col("id") % replicates).alias("replicate"), F.floor(F.col("id") / replicates).alias("draw"))
        .select(F.col("replicate").cast("int").alias("replicate"), spots.alias("position"))
        .groupBy("replicate", "position")
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    return draws.join(placed, "position").drop("position")


def _error_units(df: DataFrame, unit: Column, truth: Column, guess: Column, around: bool) -> DataFrame:
    """Error sums per unit in one scan, with sums and squares of the truth ``around`` its mean if asked.

    Rows without truth or guess are left out by NULL terms and not by a filter, which
    would compute the guess of each row once more. Squares are summed around the mean of
    the unit and then moved to that of all: no digits are lost to a large offset.
    """
    both = F.col("_truth").isNotNull() & F.col("_guess").isNotNull()
    sums = [F.sum(F.when(both, t)).alias(name) for name, t in error_sums(F.col("_truth"), F.col("_guess")).items()]
    own = F.when(both, F.col("_truth"))
    moments = [F.avg(own).alias("_mean"), F.var_pop(own).alias("_variance")] if around else []
    rows = df.select(unit, truth.alias("_truth"), guess.alias("_guess"))
    # Stored, so that no condition of a later join is checked on the hash of every row.
    found = stored(rows.groupBy("unit").agg(*sums, *moments).where(F.col("n") > 0))  # one row per unit
    if not around:
        return found
    center = found.agg(F.try_divide(F.sum(F.col("n") * F.col("_mean")), F.sum("n"))).first()[0]
    off = F.col("_mean") - F.lit(center).cast("double")
    squares = F.col("n") * (F.col("_variance") + off * off)
    return found.withColumns({"y": F.col("n") * off, "yy": squares}).drop("_mean", "_variance")


def bootstrap_scores(
    df: DataFrame,
    keys: Sequence[Column | str],
    metric: str,
    y: str = "y",
    yhat: str = "yhat",
    replicates: int = REPLICATES,
    seed: int = SEED,
    units: int = UNITS,
    method: str = "poisson",
) -> DataFrame:
    """``replicate, score``: the metric of each resample, by either method."""
    if metric not in METRICS:
        raise ValueError(f"Unknown metric: {metric}")
    if method not in METHODS:
        raise ValueError(f"Resampling is one of {', '.join(METHODS)}, not {method!r}")
    unit, all_units = _units(df, keys, units, seed)
    if metric in CLASSIFICATION:
        truth, guess = _labels(df, y, yhat)
        pairs = lambda *by: df.select(*by, truth.alias("y"), guess.alias("yhat")).where(F.col("y").isNotNull())
        if method == "exact":
            named = pairs(key_text(keys).alias("key"))
            drawn = _drawn(named, F.col("key"), replicates, seed).drop("key").withColumn("n", F.lit(1))
        else:
            cells = pairs(unit).groupBy("unit", "y", "yhat").agg(F.count(F.lit(1)).alias("n"))
            drawn = _weighted(cells, all_units, units, replicates, seed)
        resampled = drawn.groupBy("replicate", "y", "yhat").agg(F.sum(F.col("weight") * F.col("n")).alias("n"))
        return metrics_of_cells(resampled, ["replicate"]).select(
            "replicate", F.col(metric).alias("score")
        )
    truth, guess = col(y).cast("double"), col(yhat).cast("double")
    if method == "exact":
        kept = df.where(truth.isNotNull() & guess.isNotNull())
        # Squares are summed around the mean: no digits are lost to a large offset.
        center = F.lit(kept.agg(F.avg(truth)).first()[0]).cast("double") if metric == "r2" else F.lit(0.0)
        terms = error_sums(truth, guess) | {"y": truth - center, "yy": (truth - center) * (truth - center)}
        named = kept.select(key_text(keys).alias("key"), *[t.alias(name) for name, t in terms.items()])
        drawn = _drawn(named, F.col("key"), replicates, seed).drop("key")
    else:
        drawn = _weighted(_error_units(df, unit, truth, guess, metric == "r2"), all_units, units, replicates, seed)
        terms = [c for c in drawn.columns if c not in ("unit", "replicate", "weight")]
    total = drawn.groupBy("replicate").agg(
        *[F.sum(F.col(name) * F.col("weight")).alias(name) for name in terms]
    )
    n = F.col("n")
    score = {
        "mae": F.try_divide("abs", n),
        "rmse": F.sqrt(F.try_divide("sq", n)),
        "r2": _r2(F.col("sq"), F.col("yy") - F.try_divide(F.col("y") * F.col("y"), n)),
    }[metric]
    return total.select("replicate", score.alias("score"))


def bootstrap_ci(
    df: DataFrame,
    keys: Sequence[Column | str],
    metric: str,
    y: str = "y",
    yhat: str = "yhat",
    replicates: int = REPLICATES,
    confidence: float = CONFIDENCE,
    seed: int = SEED,
    units: int = UNITS,
    method: str = "poisson",
) -> DataFrame:
    """One row: mean, lower, upper (interpolated percentiles), population std, n_bootstrap."""
    scores = bootstrap_scores(df, keys, metric, y, yhat, replicates, seed, units, method)
    alpha = 1 - confidence
    ends = F.percentile("score", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return scores.agg(  # as many scores as replicates
        F.avg("score").alias("mean"),
        ends.alias("ends"),
        F.stddev_pop("score").alias("std"),
        F.count("score").alias("n_bootstrap"),
    ).select(
        F.lit(metric).alias("metric"),
        "mean",
        F.col("ends")[0].alias("lower"),
        F.col("ends")[1].alias("upper"),
        "std",
        "n_bootstrap",
    )
