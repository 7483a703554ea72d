"""Column profile: shape, missing values, statistics, frequent values, candidate targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    columns_of,
    is_missing,
    kinds,
    melt,
    names_table,
    number,
    present,
    wide_to_long,
)
from ..functions.ordering import quantiles

# A column with 2 to 20 values may be a class label.
FEW_VALUES = 20


def column_types(df: DataFrame) -> DataFrame:
    """Position, name, Spark type and kind of each column (from the schema)."""
    rows = [
        (i, f.name, f.dataType.simpleString(), kinds(df)[f.name])
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string, kind string")


def shape(df: DataFrame) -> DataFrame:
    """One row: ``n_rows``, ``n_columns``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def missing_profile(df: DataFrame) -> DataFrame:
    """Per column: missing count, missing percent (2 digits, half to even), total over columns."""
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)],
    )
    total = sum((F.col(f"m{i}") for i in range(len(df.columns))), F.lit(0))
    percent = lambda m: F.bround(F.try_divide(F.lit(100.0) * m, F.col("rows").cast("double")), 2)
    return wide_to_long(
        row,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.col("rows").alias("n_rows"),
                F.col(f"m{i}").alias("missing_count"),
                percent(F.col(f"m{i}")).alias("missing_pct"),
                total.cast("bigint").alias("total_missing"),
            )
            for i, c in enumerate(df.columns)
        ],
        "column string, n_rows bigint, missing_count bigint, missing_pct double, total_missing bigint",
    )


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles and max of each numeric column.

    One aggregate gives the moments of all columns; the quartiles come from rank
    searches (see ``functions.ordering``), so no column is gathered in one task.
    """
    columns = list(columns if columns is not None else columns_of(df, "numeric"))
    schema = (
        "column string, count bigint, mean double, std double, min double, "
        "p25 double, p50 double, p75 double, max double"
    )
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    values = {c: number(df, c) for c in columns}
    moments = df.agg(
        *[
            F.struct(
                F.count(v), F.avg(v), F.stddev_samp(v), F.min(v), F.max(v)
            ).alias(f"s{i}")
            for i, v in enumerate(values.values())
        ]
    ).first()
    sizes = {c: moments[i][0] for i, c in enumerate(columns)}
    middle = quantiles(df, values, [0.25, 0.5, 0.75], sizes)
    rows = [
        (c, *moments[i][:4], *middle[c], moments[i][4]) for i, c in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(rows, schema)


def _carried(df: DataFrame, name: str) -> list[Column]:
    """The value in one typed field, NULL in the others: exact, and no number is printed."""
    dtype, value = df.schema[name].dataType, present(df, name)
    slot = {}
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        slot["whole"] = value.cast("bigint")
    elif isinstance(dtype, T.DateType):
        slot["whole"] = F.unix_date(value).cast("bigint")
    elif isinstance(dtype, T.TimestampType):
        slot["whole"] = F.unix_micros(value)
    elif isinstance(dtype, T.TimestampNTZType):
        slot["moment"] = value
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        slot["real"] = value.cast("double")
    else:
        slot["text"] = value.cast("string")
    fields = {"text": "string", "whole": "bigint", "real": "double", "moment": "timestamp_ntz"}
    return [
        slot.get(f, F.lit(None).cast(t)).cast(t).alias(f) for f, t in fields.items()
    ]


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, text, whole, real, moment, n``: copies of every non-missing value.

    One scan and one shuffle for any number of columns, combined on the map side,
    so a value that fills a third of the table is one row per task. Distinct
    counts, modes, frequent values and vocabularies all read this.
    """
    usable = [c for c in df.columns if kinds(df)[c] != "other"]
    columns = list(columns) if columns is not None else usable
    if not columns:
        return df.sparkSession.createDataFrame(
            [],
            "column string, text string, whole bigint, real double, moment timestamp_ntz, n bigint",
        )
    rows = [F.struct(F.lit(c).alias("column"), *_carried(df, c)) for c in columns]
    some = F.coalesce(
        F.col("text").isNotNull() | F.col("whole").isNotNull()
        | F.col("real").isNotNull() | F.col("moment").isNotNull(),
        F.lit(False),
    )
    return (
        melt(df, rows)
        .where(some)
        .groupBy("column", "text", "whole", "real", "moment")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact ``unique_values`` of every column, 0 for one without values."""
    usable = [c for c in df.columns if kinds(df)[c] != "other"]
    columns = list(columns) if columns is not None else usable
    found = value_counts(df, columns).groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_values")
    )
    return (
        names_table(df, columns)
        .join(F.broadcast(found), "column", "left")  # one row per column
        .select("position", "column", F.coalesce("unique_values", F.lit(0)).alias("unique_values"))
    )


def _ranked_values(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("text"))
    return (
        value_counts(df, columns)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """The k most frequent values of each string column; equal counts in value order.

    The rank filter is applied by each task before the shuffle, so k rows per
    column and task travel, whatever the number of distinct values.
    """
    columns = list(columns if columns is not None else columns_of(df, "categorical"))
    return _ranked_values(df, columns, k).select(
        "column", "rank", F.col("text").alias("value"), F.col("n").alias("n")
    )


def categorical_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct count, most frequent value and its count for each string column."""
    columns = list(columns if columns is not None else columns_of(df, "categorical"))
    best = F.min_by(F.col("text"), F.struct(-F.col("n"), F.col("text")))
    found = (
        value_counts(df, columns)
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("unique_values"),
            best.alias("most_frequent"),
            F.max("n").alias("most_frequent_count"),
        )
    )
    return (
        names_table(df, columns)
        .join(F.broadcast(found), "column", "left")  # one row per column
        .select(
            "column",
            F.coalesce("unique_values", F.lit(0)).alias("unique_values"),
            "most_frequent",
            F.coalesce("most_frequent_count", F.lit(0)).alias("most_frequent_count"),
        )
    )


def candidate_targets(df: DataFrame) -> DataFrame:
    """Columns that could be predicted: 2 to 20 values, or numeric with more."""
    numeric = F.col("column").isin(*columns_of(df, "numeric"))
    unique = F.col("unique_values")
    role = F.when(unique.between(2, FEW_VALUES), "classification_candidate").when(
        numeric & (unique > FEW_VALUES), "regression_candidate"
    )
    return (
        distinct_counts(df)
        .withColumn("type", role)
        .where(F.col("type").isNotNull())
        .select("column", "unique_values", "type")
    )


def insights(df: DataFrame) -> DataFrame:
    """Three sentences on the shape, the missing cells and the column kinds."""
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)],
    )
    missing = sum((F.col(f"m{i}") for i in range(len(df.columns))), F.lit(0))
    numeric, text = len(columns_of(df, "numeric")), len(columns_of(df, "categorical"))
    sentences = [
        F.format_string(
            f"Dataset has %d rows and {len(df.columns)} columns", F.col("rows")
        ),
        F.format_string("Missing data: %d total missing values", missing.cast("bigint")),
        F.lit(f"Data types: {numeric} numeric, {text} categorical"),
    ]
    return melt(
        row,
        [
            F.struct(F.lit(i).alias("position"), s.alias("insight"))
            for i, s in enumerate(sentences, 1)
        ],
    )


def mode(df: DataFrame, name: str) -> Column:
    """The most frequent value of a column as a literal (smallest on a tie)."""
    copies = df.groupBy(present(df, name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    row = copies.where(F.col("v").isNotNull()).agg(
        F.min_by("v", F.struct(-F.col("n"), F.col("v")))
    )
    return F.lit(row.first()[0]).cast(df.schema[name].dataType)
