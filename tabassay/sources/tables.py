"""Table sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.hashing import cell_text


@dataclass(frozen=True)
class TableInfo:
    """What to predict in a named table, and which columns identify a row."""

    target: str | None
    task: str | None
    keys: tuple[str, ...]


CATALOG: dict[str, TableInfo] = {
    "region": TableInfo(None, None, ("r_regionkey",)),
    "nation": TableInfo("n_regionkey", "classification", ("n_nationkey",)),
    "customer": TableInfo("c_mktsegment", "classification", ("c_custkey",)),
    "supplier": TableInfo("s_acctbal", "regression", ("s_suppkey",)),
    "part": TableInfo("p_retailprice", "regression", ("p_partkey",)),
    "orders": TableInfo("o_orderstatus", "classification", ("o_orderkey",)),
    "lineitem": TableInfo(
        "l_returnflag",
        "classification",
        ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"),
    ),
    "events": TableInfo("event_type", "classification", ("event_id",)),
    "documents": TableInfo("lang", "classification", ("doc_id",)),
    "labels": TableInfo("quality", "classification", ("doc_id",)),
    "pages": TableInfo(None, None, ("page_id",)),
    "benchmark": TableInfo(None, None, ("item_id",)),
    "conversations": TableInfo("role", "classification", ("conv_id", "turn")),
    "embeddings": TableInfo("label", "classification", ("vec_id",)),
}

# The texts a CSV cell may hold for "missing".
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def table_info(name: str) -> TableInfo:
    if name not in CATALOG:
        raise ValueError(f"Unknown table: {name}")
    return CATALOG[name]


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table of the catalog. An unknown name raises ``ValueError``."""
    table_info(name)
    return load_table(spark, f"{directory}/{name}.parquet")


def spread_table(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A scan with fewer partitions than cores, split further for costly expressions.

    One row group is read by one task, however many cores there are. A scan with
    partitions enough is left alone, so a large table is never shuffled; a small
    one gets at most eight times its partitions. ``keys`` must identify a row.
    """
    partitions = df.rdd.getNumPartitions()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if partitions >= cores:
        return df
    return df.repartition(min(cores, 8 * partitions), *[col(k) for k in keys])


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, paths: Sequence[str], multi_line: bool = False) -> DataFrame:
    """CSV files with a header, missing-value tokens nulled, types found, rows concatenated.

    Files are matched by column name; a column one file lacks is NULL for it. Cells
    that span lines need ``multi_line``, with which one task reads a whole file.
    """
    if not paths:
        raise ValueError("read_csv needs at least one path")
    return typed_csv(concat_tables([_raw_csv(spark, path, multi_line) for path in paths]))


def _raw_csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    reader = spark.read.option("header", True).option("escape", '"')
    return reader.option("multiLine", multi_line).csv(path)


def typed_csv(raw: DataFrame) -> DataFrame:
    """Null the missing tokens of an all-string table and give each column the narrowest type.

    Whole column fits bigint, else double, else boolean, else string; a bigint
    column with missing cells stays bigint. One aggregate over the table decides
    for all columns. Dates stay strings.
    """
    texts = {c: F.when(~col(c).isin(*MISSING_TOKENS), col(c)) for c in raw.columns}
    checks: list[Column] = []
    for i, c in enumerate(raw.columns):
        cell = F.trim(texts[c])
        checks += [
            F.count(cell).alias(f"n{i}"),
            F.count(cell.try_cast("bigint")).alias(f"w{i}"),
            F.count(_plain_double(cell)).alias(f"r{i}"),
            F.count_if(cell.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"b{i}"),
        ]
    seen = raw.agg(*checks).first()
    typed = []
    for i, c in enumerate(raw.columns):
        cell, n = F.trim(texts[c]), seen[f"n{i}"]
        if n and seen[f"w{i}"] == n:
            value = cell.try_cast("bigint")
        elif seen[f"r{i}"] == n:
            value = _plain_double(cell)
        elif seen[f"b{i}"] == n:
            value = cell.try_cast("boolean")
        else:
            value = texts[c]
        typed.append(value.alias(c))
    return raw.select(*typed)


def _plain_double(cell: Column) -> Column:
    # Spark also reads "1d" and "1f" as numbers; a CSV reader should not.
    return F.when(~cell.rlike("[dDfF]$") | cell.rlike("(?i)^[+-]?inf$"), cell.try_cast("double"))


def concat_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables, columns matched by name and filled with NULL where absent."""
    if not tables:
        raise ValueError("No tables to concatenate")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def fingerprint(df: DataFrame, name: str = "") -> DataFrame:
    """One row: ``n_rows``, ``content_sum`` and ``fingerprint`` over every cell of the table.

    Both halves of each row's md5 are summed, so neither row order nor partitioning
    matters, while repeated rows and every changed cell do. Cells are written with
    their length, NULL apart from any text. Partial sums are the only thing shuffled.
    """
    digest = F.md5(F.concat(F.lit(""), *[cell_text(col(c)) for c in df.columns]))
    halves = [
        F.sum(F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
        for at in (1, 17)
    ]
    shape = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    parts = [F.lit(name), F.lit(shape), F.col("n_rows"), F.col("content_sum")]
    sums = [F.coalesce(h, F.lit(0)).cast("decimal(38,0)").cast("string") for h in halves]
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.concat_ws(",", *sums).alias("content_sum")
    ).withColumn("fingerprint", F.sha2(F.concat(*[cell_text(p) for p in parts]), 256))


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write a result table as ``parquet``, ``json``, ``csv`` or ``orc``; returns the path."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def write_splits(df: DataFrame, path: str, split: str = "split") -> str:
    """Write one directory per split, so that reading one split skips the others."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)
    return path
