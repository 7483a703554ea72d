"""Column helpers: names, kinds, missing values and long (unpivoted) form."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)


def col(name: str) -> Column:
    """Column by its literal name, whatever characters the name contains."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, T.StringType):
        return "categorical"
    if isinstance(dtype, _DATETIME):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "other"


def kinds(df: DataFrame) -> dict[str, str]:
    """Kind of every column, from the schema alone (no job)."""
    return {f.name: kind(f.dataType) for f in df.schema.fields}


def columns_of(df: DataFrame, *wanted: str) -> list[str]:
    return [name for name, k in kinds(df).items() if k in wanted]


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL, so that both count as missing."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col(name)), col(name))
    return col(name)


def is_missing(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return col(name).isNull() | F.isnan(col(name))
    return col(name).isNull()


def number(df: DataFrame, name: str) -> Column:
    """The column as a double, NaN as NULL."""
    return present(df, name).cast("double")


def melt(df: DataFrame, rows: Iterable[Column], keep: Sequence[Column | str] = ()) -> DataFrame:
    """One output row per struct in ``rows`` for every input row (a narrow map)."""
    return df.select(*keep, F.inline(F.array(*rows)))


def wide_to_long(one_row: DataFrame, rows: Sequence[Column], schema: str) -> DataFrame:
    """Turn the single row of a wide aggregate into one row per struct."""
    if not rows:
        return one_row.sparkSession.createDataFrame([], schema)
    return melt(one_row, rows)


def names_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Position and name of each column, as rows."""
    return df.sparkSession.createDataFrame(
        [(i, c) for i, c in enumerate(columns)], "position int, column string"
    )


def distinct_up_to(df: DataFrame, value: Column, limit: int) -> list | None:
    """Sorted distinct non-null values when there are at most ``limit``, else None.

    The sketch goes first. ``limit`` values can fill at most ``limit`` of its
    registers, which keeps its estimate far below ``2 * limit + 20``; a larger
    estimate therefore proves the column has more values, and a continuous
    column is never shuffled just to learn that it is one.
    """
    values = df.select(value.alias("v")).where(F.col("v").isNotNull())
    estimate = values.agg(F.approx_count_distinct("v", 0.02)).first()[0]
    if estimate > 2 * limit + 20:
        return None
    rows = values.distinct().limit(limit + 1).collect()
    return sorted(r["v"] for r in rows) if len(rows) <= limit else None
