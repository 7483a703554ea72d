"""Joining a table of values to rows, whatever the size of the table and however frequent a value is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def lookup(
    df: DataFrame,
    key: Column,
    table: DataFrame,
    columns: Sequence[str],
    small: bool,
    hot: Sequence[Row] = (),
) -> DataFrame:
    """Add ``columns`` of the row of ``table`` whose ``value`` equals the key; NULL where there is none.

    A small table is broadcast. A large one is joined by shuffle, where the rows of a
    frequent value would meet in one task: ``hot`` has the table's rows of these values
    (a bounded number), their cells are written as literals, and the rows are dealt out
    by a key that matches nothing.
    """
    keyed = df.withColumn("_value", key)
    right = table.select(F.col("value").alias("_value"), *columns)
    if small:
        return keyed.join(F.broadcast(right), "_value", "left").drop("_value")
    types = {c: table.schema[c].dataType for c in columns}
    known = {c: F.lit(None).cast(types[c]) for c in columns}
    is_hot = F.lit(False)
    for row in hot:
        here = F.col("_value") == row["value"]
        is_hot = is_hot | here
        for c in columns:
            known[c] = F.when(here, _literal(row[c], types[c])).otherwise(known[c])
    apart = F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))
    ready = keyed.withColumns({f"_hot_{c}": known[c] for c in columns}).withColumn(
        "_value", F.when(F.coalesce(is_hot, F.lit(False)), apart).otherwise(F.col("_value"))
    )
    joined = ready.join(right, "_value", "left")
    return joined.withColumns({c: F.coalesce(f"_hot_{c}", c) for c in columns}).drop(
        "_value", *[f"_hot_{c}" for c in columns]
    )


def _literal(value, dtype) -> Column:
    cells = F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)
    return cells.cast(dtype)
