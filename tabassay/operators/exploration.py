"""Pairs of correlated features and columns with outliers."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import columns_of, number
from ..functions.ordering import quantiles

# Pairs above this size are listed, and the reach of the outlier rule.
PAIR_THRESHOLD = 0.7
IQR_REACH = 1.5
# Columns of a block; two blocks are compared in one scan.
BLOCK = 500


def pair_correlations(df: DataFrame, columns: Sequence[str], block: int = BLOCK) -> np.ndarray:
    """Pearson correlation of every pair of columns over the rows where both are present.

    Per column three numbers go into a vector: the value less the column's mean, its
    square, and whether it is present, all 0 where it is missing. The products of these
    with each other, summed over the rows, hold the sums over common rows of every pair
    at once. They are added up by MLlib in one scan, a block of columns against itself
    or another one. NaN where a pair has no spread.
    """
    names = list(columns)
    values = {c: number(df, c) for c in names}
    means = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values.values())]).first()
    out = np.full((len(names), len(names)), np.nan)
    blocks = [range(i, min(i + block, len(names))) for i in range(0, len(names), block)]
    # With several blocks, two at a time make up a scan.
    for rows in combinations(blocks, 2) if len(blocks) > 1 else [(blocks[0],)]:
        at = [i for part in rows for i in part]
        cells: list[Column] = []
        gaps = [values[names[i]] - F.lit(means[i] or 0.0) for i in at]
        cells += [F.coalesce(g, F.lit(0.0)) for g in gaps]
        cells += [F.coalesce(g * g, F.lit(0.0)) for g in gaps]
        cells += [g.isNotNull().cast("double") for g in gaps]
        vectors = MLUtils.convertVectorColumnsFromML(df.select(array_to_vector(F.array(*cells)).alias("v")), "v")
        gram = RowMatrix(vectors).computeGramianMatrix().toArray()
        d = len(at)
        value, square, mask = slice(0, d), slice(d, 2 * d), slice(2 * d, 3 * d)
        n = gram[mask, mask]
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = gram[value, mask] / n  # of the row's column where the other one is present
            variance = gram[square, mask] / n - mean * mean
            covariance = gram[value, value] / n - mean * mean.T
            spread = np.sqrt(np.maximum(variance, 0) * np.maximum(variance.T, 0))
            # What rounding leaves of a constant column is no spread.
            size = gram[square, mask] / n
            flat = (variance <= 1e-13 * size) | (variance.T <= 1e-13 * size.T)
            r = np.where(flat, np.nan, covariance / spread)
        out[np.ix_(at, at)] = r
    return out


def feature_correlations(
    df: DataFrame, columns: Sequence[str] | None = None, threshold: float = PAIR_THRESHOLD
) -> DataFrame:
    """``feature1, feature2, correlation`` of pairs with a Pearson size above the threshold."""
    columns = list(columns if columns is not None else columns_of(df, "numeric"))
    schema = "feature1 string, feature2 string, correlation double"
    if len(columns) < 2 or df.isEmpty():
        return df.sparkSession.createDataFrame([], schema)
    r = pair_correlations(df, columns)
    found = [
        (a, b, float(r[i, j]))
        for (i, a), (j, b) in combinations(enumerate(columns), 2)
        if abs(r[i, j]) > threshold
    ]
    return df.sparkSession.createDataFrame(found, schema)


def outliers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, low, high, n_outliers``: values beyond 1.5 quartile ranges, where there are any."""
    columns = list(columns if columns is not None else columns_of(df, "numeric"))
    schema = "column string, low double, high double, n_outliers bigint"
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    values = {c: number(df, c) for c in columns}
    fences = {}
    for c, (q1, q3) in quantiles(df, values, [0.25, 0.75]).items():
        if q1 is not None:
            reach = IQR_REACH * (q3 - q1)
            fences[c] = (q1 - reach, q3 + reach)
    if not fences:
        return df.sparkSession.createDataFrame([], schema)
    row = df.agg(
        *[F.count_if((values[c] < low) | (values[c] > high)) for c, (low, high) in fences.items()]
    ).first()
    rows = [(c, *fence, n) for (c, fence), n in zip(fences.items(), row) if n > 0]
    return df.sparkSession.createDataFrame(rows, schema)
