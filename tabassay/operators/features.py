"""Feature plan, and encoding, imputation and scaling fitted on the training rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import col, is_missing, kinds, melt, number
from ..functions.ordering import quantiles
from ..functions.storage import kept, stored
from .profile import distinct_counts

# Text that stands for a missing category, code of an unseen one,
# and the number of categories above which a column counts as high-cardinality.
MISSING_CATEGORY = "missing"
UNSEEN = -1
HIGH_CARDINALITY = 50

# A vocabulary of at most this many rows and bytes is sorted on the driver and
# broadcast; a larger one is ranked by range partitions and joined by shuffle.
SMALL_VOCABULARY = 100_000
SMALL_VOCABULARY_BYTES = 32 * 2**20
# A category of a large vocabulary with at least this share of the rows is coded by
# a literal, of which a column has at most a hundred; only the others are joined.
HOT_SHARE = 0.01


def feature_columns(df: DataFrame, target: str, deny: Sequence[str] = ()) -> list[str]:
    """All columns but the target and the denied ones, in table order."""
    return [c for c in df.columns if c != target and c not in set(deny)]


def plan(df: DataFrame, target: str, deny: Sequence[str] = ()) -> DataFrame:
    """Per feature: type, missing and distinct counts, and the transforms it needs."""
    features = feature_columns(df, target, deny)
    kind_of, type_of = kinds(df), {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = (
        "position int, column string, dtype string, missing_count bigint, "
        "unique_values bigint, transforms array<string>"
    )
    if not features:
        return df.sparkSession.createDataFrame([], schema)
    missing = df.agg(
        *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(features)]
    )
    rows = melt(
        missing,
        [
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column"),
                F.lit(type_of[c]).alias("dtype"),
                F.lit(kind_of[c]).alias("kind"),
                F.col(f"m{i}").alias("missing_count"),
            )
            for i, c in enumerate(features)
        ],
    )
    unique = distinct_counts(df, [c for c in features if kind_of[c] != "other"])
    numeric, text = F.col("kind") == "numeric", F.col("kind") == "categorical"
    has_missing = F.col("missing_count") > 0
    steps = F.array(
        F.when(has_missing & numeric, "impute_median").when(has_missing, "impute_mode"),
        F.when(text & (F.col("unique_values") > HIGH_CARDINALITY), "high_cardinality_encode")
        .when(text, "label_encode")
        .when(numeric, "standard_scale"),
    )
    return rows.join(F.broadcast(unique.drop("position")), "column", "left").select(  # one row per column
        "position",
        "column",
        "dtype",
        "missing_count",
        F.coalesce("unique_values", F.lit(0)).alias("unique_values"),
        F.array_compact(steps).alias("transforms"),
    )


def plan_summary(df: DataFrame, target: str, deny: Sequence[str] = ()) -> DataFrame:
    """One row: number of features, of excluded, numeric and text ones, and of those with gaps."""
    features = feature_columns(df, target, deny)
    kind_of = kinds(df)
    gaps = sum(
        (F.max(is_missing(df, c).cast("int")) for c in features), F.lit(0)
    )
    return df.agg(F.coalesce(gaps, F.lit(0)).alias("missing_data_columns")).select(
        F.lit(len(features)).alias("total_features"),
        F.lit(len(deny)).alias("excluded_features"),
        F.lit(sum(kind_of[c] == "numeric" for c in features)).alias("numeric_features"),
        F.lit(sum(kind_of[c] == "categorical" for c in features)).alias("categorical_features"),
        "missing_data_columns",
    )


@dataclass
class FeatureParams:
    """What ``fit`` learned: per numeric column median, mean and std, and the vocabulary."""

    numeric: dict[str, tuple[float | None, float | None, float | None]]
    vocabulary: DataFrame | None = None
    small_vocabulary: bool = True
    text: list[str] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, *stats) for c, stats in self.numeric.items()]
        return spark.createDataFrame(rows, "column string, median double, mean double, std double")


def fit(train: DataFrame, features: Sequence[str], small_rows: int | None = None) -> FeatureParams:
    """Learn imputation, scaling and encoding from the training rows alone."""
    kind_of = kinds(train)
    numeric = [c for c in features if kind_of[c] == "numeric"]
    text = [c for c in features if kind_of[c] == "categorical"]
    params = FeatureParams(fit_numeric(train, numeric), text=text)
    if text:
        params.vocabulary, params.small_vocabulary = fit_vocabulary(train, text, small_rows)
    return params


def fit_numeric(
    train: DataFrame, columns: Sequence[str]
) -> dict[str, tuple[float | None, float | None, float | None]]:
    """Median, then mean and population std of the imputed column."""
    if not columns:
        return {}
    values = {c: number(train, c) for c in columns}
    row = train.agg(
        F.count(F.lit(1)),
        *[F.struct(F.count(v), F.avg(v), F.var_pop(v)).alias(f"s{i}") for i, v in enumerate(values.values())],
    ).first()
    moments = {c: row[i + 1] for i, c in enumerate(columns)}
    medians = quantiles(train, values, [0.5], {c: m[0] for c, m in moments.items()})
    return {c: (medians[c][0], *_filled(*moments[c], row[0], medians[c][0])) for c in columns}


def _filled(present: int, mean: float, variance: float, rows: int, median: float):
    """Mean and population std once the missing cells hold the median, without another scan."""
    if not present:
        return None, None
    share = present / rows
    gap = median - mean
    return mean + (1 - share) * gap, math.sqrt(share * variance + share * (1 - share) * gap * gap)


def fit_vocabulary(
    train: DataFrame, columns: Sequence[str], small_rows: int | None = None
) -> tuple[DataFrame, bool]:
    """``column, value, idx``: position of each training category in sorted order.

    Also tells whether the vocabulary is small enough to broadcast: ``small_rows``
    entries, and 32 MB. A large one has ``share`` too, the part of the rows a
    category has.
    """
    small_rows = SMALL_VOCABULARY if small_rows is None else small_rows
    pairs = [
        F.struct(
            F.lit(c).alias("column"),
            F.coalesce(col(c), F.lit(MISSING_CATEGORY)).alias("value"),
        )
        for c in columns
    ]
    counted = melt(train, pairs).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    with kept(counted) as words_:
        rows, size = words_.agg(F.count(F.lit(1)), F.sum(F.octet_length("value"))).first()
        if rows > small_rows or (size or 0) > SMALL_VOCABULARY_BYTES:
            return _ranked_vocabulary(words_), False
        words = sorted((r["column"], r["value"]) for r in words_.select("column", "value").collect())
    firsts: dict[str, int] = {}
    table = [(c, v, i - firsts.setdefault(c, i)) for i, (c, v) in enumerate(words)]
    return train.sparkSession.createDataFrame(table, "column string, value string, idx bigint"), True


def _ranked_vocabulary(counted: DataFrame) -> DataFrame:
    """Sorted positions of a vocabulary of any size.

    Range partitions are sorted side by side and written once, so that their
    limits are fixed; the rows of earlier partitions then shift the positions.
    """
    bits = 33  # monotonically_increasing_id is partition << 33 plus row in partition
    parts = stored(
        counted.repartitionByRange("column", "value")
        .sortWithinPartitions("column", "value")
        .withColumn("id", F.monotonically_increasing_id())
        .select(
            "column",
            "value",
            F.shiftright("id", bits).alias("part"),
            F.col("id").bitwiseAND(F.lit((1 << bits) - 1)).alias("row"),
            "n",
        )
    )
    edges = parts.groupBy("column", "part").agg(
        F.min("row").alias("first"), F.count(F.lit(1)).alias("n")
    )  # one row per column and partition
    earlier = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = edges.select(
        "column",
        "part",
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
    )
    totals = parts.groupBy("column").agg(F.sum("n").alias("total"))  # one row per column
    return parts.join(F.broadcast(shifts), ["column", "part"]).join(F.broadcast(totals), "column").select(
        "column",
        "value",
        (F.col("row") + F.col("shift")).alias("idx"),
        (F.col("n") / F.col("total")).alias("share"),
    )


def encode(df: DataFrame, vocabulary: DataFrame, columns: Sequence[str], small: bool) -> DataFrame:
    """Replace each text column by the position of its value; -1 for an unseen value.

    A small vocabulary is broadcast. With a large one the frequent values are coded
    by literals, and their rows are dealt out by a key that matches nothing, so that
    no task of the join gets all rows of a value.
    """
    out = df
    for c in columns:
        words = vocabulary.where(F.col("column") == c).select(
            F.col("value").alias("_value"), F.col("idx").alias("_idx")
        )
        keyed = out.withColumn("_value", F.coalesce(col(c), F.lit(MISSING_CATEGORY)))
        if small:
            coded = keyed.join(F.broadcast(words), "_value", "left")
        else:
            hot = vocabulary.where((F.col("column") == c) & (F.col("share") >= HOT_SHARE)).collect()
            known = F.lit(None).cast("bigint")
            for r in hot:
                known = F.when(F.col("_value") == r["value"], F.lit(r["idx"])).otherwise(known)
            apart = F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))
            keyed = keyed.withColumn("_known", known).withColumn(
                "_value", F.when(F.col("_known").isNull(), F.col("_value")).otherwise(apart)
            )
            coded = keyed.join(words, "_value", "left").withColumn("_idx", F.coalesce("_known", "_idx"))
        code = F.coalesce(F.col("_idx"), F.lit(UNSEEN)).cast("bigint")
        out = coded.select(*[(code if x == c else col(x)).alias(x) for x in out.columns])
    return out


def scaled(value: Column, median, mean, std) -> Column:
    """Imputed and standardised; a constant column is only centred."""
    filled = F.coalesce(value, F.lit(median).cast("double"))
    spread = std if std else 1.0
    return (filled - F.lit(mean).cast("double")) / F.lit(spread)


def transform(df: DataFrame, params: FeatureParams) -> DataFrame:
    """Apply fitted parameters to any rows; other columns pass through."""
    out = df.select(
        *[
            (scaled(number(df, c), *params.numeric[c]) if c in params.numeric else col(c)).alias(c)
            for c in df.columns
        ]
    )
    if params.text:
        out = encode(out, params.vocabulary, params.text, params.small_vocabulary)
    return out


def fit_transform(
    df: DataFrame, target: str, keys: Sequence[str] = (), deny: Sequence[str] = ()
) -> tuple[DataFrame, FeatureParams]:
    """Fit on the rows with ``split = 'train'`` and transform all splits."""
    skip = {"split", *keys, *deny}
    features = [c for c in feature_columns(df, target) if c not in skip]
    params = fit(df.where(F.col("split") == "train"), features)
    return transform(df, params), params
