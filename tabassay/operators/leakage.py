"""Signs that a column gives the target away, and the verdict on the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, columns_of, kind, names_table, number, wide_to_long

# Fixed values: |r| above the first blocks, above the second warns.
BLOCK_CORRELATION = 0.99
WARN_CORRELATION = 0.95

# Parts of column names that suggest leakage, first hit wins.
LEAKY_NAMES = (
    "id", "index", "key", "uuid", "guid", "created", "updated", "modified", "timestamp",
    "result", "outcome", "prediction", "score", "label", "class", "category",
)

_FINDING = "column string, issue string, pattern string, correlation double, severity string"


def correlations(df: DataFrame, target: str) -> DataFrame:
    """Pearson ``r`` of each numeric column with the target, over rows where both are present.

    A constant column has no correlation and gives NULL. All columns share one
    aggregate of three partial moments each.
    """
    columns = [c for c in columns_of(df, "numeric") if c != target]
    if kind(df.schema[target].dataType) != "numeric":
        columns = []
    t = number(df, target) if columns else F.lit(None)
    moments: list[Column] = []
    for i, c in enumerate(columns):
        x = F.when(t.isNotNull(), number(df, c))
        y = F.when(number(df, c).isNotNull(), t)
        moments += [
            F.covar_pop(x, y).alias(f"c{i}"),
            F.stddev_pop(x).alias(f"x{i}"),
            F.stddev_pop(y).alias(f"y{i}"),
        ]
    schema = "column string, correlation double"
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    return wide_to_long(
        df.agg(*moments),
        [
            F.struct(
                F.lit(c).alias("column"),
                F.try_divide(F.col(f"c{i}"), F.col(f"x{i}") * F.col(f"y{i}")).alias("correlation"),
            )
            for i, c in enumerate(columns)
        ],
        schema,
    )


def correlation_findings(df: DataFrame, target: str) -> DataFrame:
    size = F.abs("correlation")
    severity = F.when(size > BLOCK_CORRELATION, "block").when(size > WARN_CORRELATION, "warn")
    issue = F.when(size > BLOCK_CORRELATION, "perfect_correlation").otherwise("high_correlation")
    return (
        correlations(df, target)
        .withColumn("severity", severity)
        .where(F.col("severity").isNotNull())
        .select(
            "column",
            issue.alias("issue"),
            F.lit(None).cast("string").alias("pattern"),
            "correlation",
            "severity",
        )
    )


def first_name_hit(column: Column, patterns: tuple[str, ...]) -> Column:
    """The first pattern, in list order, contained in the lower-cased name."""
    listed = F.array(*[F.lit(p) for p in patterns])
    return F.get(F.filter(listed, lambda p: F.contains(F.lower(column), p)), 0)


def name_findings(df: DataFrame, target: str) -> DataFrame:
    """Columns whose name contains a leaky part (``width`` contains ``id``)."""
    names = names_table(df, [c for c in df.columns if c != target])
    return (
        names.withColumn("pattern", first_name_hit(F.col("column"), LEAKY_NAMES))
        .where(F.col("pattern").isNotNull())
        .select(
            "column",
            F.lit("suspicious_name").alias("issue"),
            "pattern",
            F.lit(None).cast("double").alias("correlation"),
            F.lit("warn").alias("severity"),
        )
    )


def time_findings(df: DataFrame, time_col: str) -> DataFrame:
    """Block when the time column is absent, warn when any text in it is no timestamp."""
    spark = df.sparkSession
    if time_col not in df.columns:
        return spark.createDataFrame(
            [(time_col, "missing_time_column", None, None, "block")], _FINDING
        )
    if not isinstance(df.schema[time_col].dataType, T.StringType):
        return spark.createDataFrame([], _FINDING)
    bad = col(time_col).isNotNull() & F.try_to_timestamp(col(time_col)).isNull()
    return (
        df.agg(F.count_if(bad).alias("bad"))
        .where(F.col("bad") > 0)
        .select(
            F.lit(time_col).alias("column"),
            F.lit("invalid_datetime_format").alias("issue"),
            F.lit(None).cast("string").alias("pattern"),
            F.lit(None).cast("double").alias("correlation"),
            F.lit("warn").alias("severity"),
        )
    )


def leakage_findings(
    df: DataFrame, target: str, policy: str = "iid", time_col: str | None = None
) -> DataFrame:
    """All findings: ``column, issue, pattern, correlation, severity``. None without the target."""
    if target not in df.columns:
        return df.sparkSession.createDataFrame([], _FINDING)
    found = correlation_findings(df, target).unionByName(name_findings(df, target))
    if policy == "time" and time_col:
        found = found.unionByName(time_findings(df, time_col))
    return found


def leakage_verdict(
    findings: DataFrame, columns_checked: int, target_present: bool = True
) -> DataFrame:
    """One row: ``status`` (block, warn or pass) and the number of findings of each kind.

    A table without its target is blocked, although nothing was found in it.
    """
    block, warn = F.col("blocking_issues"), F.col("warnings")
    status = F.when(F.lit(not target_present) | (block > 0), "block").when(warn > 0, "warn").otherwise("pass")
    return findings.agg(
        F.count_if(F.col("severity") == "block").alias("blocking_issues"),
        F.count_if(F.col("severity") == "warn").alias("warnings"),
    ).select(
        status.alias("status"),
        "blocking_issues",
        "warnings",
        F.lit(columns_checked).alias("columns_checked"),
    )


def deny_list(findings: DataFrame) -> list[str]:
    """Columns with a blocking finding, to be left out of the features."""
    rows = findings.where(F.col("severity") == "block").select("column").distinct().collect()
    return sorted(r["column"] for r in rows)
