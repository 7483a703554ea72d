"""Personal data: finding it in text columns, replacing it, and telltale column names."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, columns_of, melt, names_table, wide_to_long
from .leakage import first_name_hit

# The patterns, in the order in which redaction applies them. The
# order matters: a phone number is taken out before a card number is looked for.
PATTERNS: dict[str, str] = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"(\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})",
    "ssn": r"\b\d{3}-?\d{2}-?\d{4}\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "ip_address": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "url": r"https?://(?:[-\w.])+(?:[:\d]+)?(?:/(?:[\w/_.])*(?:\?(?:[\w&=%.])*)?(?:#(?:\w*))?)?",
}

# Parts of column names that suggest personal data, first hit wins.
PERSONAL_NAMES = (
    "email", "mail", "phone", "tel", "ssn", "social", "security", "credit", "card",
    "account", "password", "pass", "secret", "name", "first", "last", "fname", "lname",
    "address", "addr", "street", "city", "zip", "postal", "dob", "birth", "age",
)
HIGH_RISK_NAMES = ("ssn", "social", "password", "secret")

# Text every match must contain, checked first because it is far cheaper.
_NEEDS = {"email": "@", "url": "://"}
CONTEXT_LENGTH = 50
SAMPLES = 5


def _chosen(patterns: Sequence[str] | None) -> dict[str, str]:
    """The named built-in patterns in the order asked for; unknown names are skipped."""
    names = list(PATTERNS) if patterns is None else [p for p in patterns if p in PATTERNS]
    return {p: PATTERNS[p] for p in names}


def _regex(name: str) -> Column:
    return F.lit("(?i)" + PATTERNS[name])


def _matches(text: Column, name: str) -> Column:
    n = F.regexp_count(text, _regex(name))
    if name in _NEEDS:
        n = F.when(F.contains(text, F.lit(_NEEDS[name])), n).otherwise(0)
    return F.coalesce(n, F.lit(0))


def scan(
    df: DataFrame, patterns: Sequence[str] | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """``pattern, column, n_matches, n_rows`` for each pattern found in each text column.

    One scan whatever the number of patterns; only one partial row per task is
    shuffled.
    """
    chosen = _chosen(patterns)
    columns = list(columns if columns is not None else columns_of(df, "categorical"))
    pairs = [(p, c) for p in chosen for c in columns]
    schema = "pattern string, column string, n_matches bigint, n_rows bigint"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    counted = df.select(*[_matches(col(c), p).alias(f"n{i}") for i, (p, c) in enumerate(pairs)])
    totals = counted.agg(
        *[F.sum(f"n{i}").alias(f"m{i}") for i in range(len(pairs))],
        *[F.count_if(F.col(f"n{i}") > 0).alias(f"r{i}") for i in range(len(pairs))],
    )
    rows = [
        F.struct(
            F.lit(p).alias("pattern"),
            F.lit(c).alias("column"),
            F.col(f"m{i}").cast("bigint").alias("n_matches"),
            F.col(f"r{i}").alias("n_rows"),
        )
        for i, (p, c) in enumerate(pairs)
    ]
    return wide_to_long(totals, rows, schema).where(F.col("n_matches") > 0)


def risk_level(total: Column) -> Column:
    # Fewer than 10 matches are low, fewer than 100 medium.
    return (
        F.when(total == 0, "none").when(total < 10, "low").when(total < 100, "medium").otherwise("high")
    )


def summarize(
    df: DataFrame, patterns: Sequence[str] | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """One row: total matches, patterns and columns and rows affected, risk level."""
    chosen = _chosen(patterns)
    columns = list(columns if columns is not None else columns_of(df, "categorical"))
    pairs = [(p, c) for p in chosen for c in columns]
    if not pairs:
        return df.sparkSession.createDataFrame(
            [("none", 0, 0, 0, 0)],
            "risk_level string, total_matches bigint, patterns_found int, columns_affected int, "
            "rows_affected bigint",
        )
    counted = df.select(*[_matches(col(c), p).alias(f"n{i}") for i, (p, c) in enumerate(pairs)])
    hit_row = reduce(lambda a, b: a | b, [F.col(f"n{i}") > 0 for i in range(len(pairs))])
    totals = counted.agg(
        F.count_if(hit_row).alias("rows_affected"),
        *[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"m{i}") for i in range(len(pairs))],
    )
    any_of = lambda members: reduce(F.greatest, members) if len(members) > 1 else members[0]
    hit = {pair: (F.col(f"m{i}") > 0).cast("int") for i, pair in enumerate(pairs)}
    total = sum((F.col(f"m{i}") for i in range(len(pairs))), F.lit(0)).cast("bigint")
    found = sum((any_of([hit[(p, c)] for c in columns]) for p in chosen), F.lit(0))
    affected = sum((any_of([hit[(p, c)] for p in chosen]) for c in columns), F.lit(0))
    return totals.select(
        risk_level(total).alias("risk_level"),
        total.alias("total_matches"),
        found.alias("patterns_found"),
        affected.alias("columns_affected"),
        "rows_affected",
    )


def ellipsis(text: Column, length: int = CONTEXT_LENGTH) -> Column:
    return F.when(
        F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))
    ).otherwise(text)


def samples(
    df: DataFrame,
    key: str,
    patterns: Sequence[str] | None = None,
    columns: Sequence[str] | None = None,
    k: int = SAMPLES,
) -> DataFrame:
    """The first k matches per pattern and column, by key and position in the text.

    A row passes on at most its first k matches, which loses none of the first k
    overall; each task then keeps k per group before the shuffle.
    """
    chosen = _chosen(patterns)
    columns = list(columns if columns is not None else columns_of(df, "categorical"))
    schema = "key string, pattern string, column string, position int, value string, context string"
    pairs = [(p, c) for p in chosen for c in columns]
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    rows = [
        F.struct(
            F.lit(p).alias("pattern"),
            F.lit(c).alias("column"),
            F.when(
                F.contains(col(c), F.lit(_NEEDS.get(p, ""))),
                F.slice(F.regexp_extract_all(col(c), _regex(p), F.lit(0)), 1, k),
            ).alias("found"),
            ellipsis(col(c)).alias("context"),
        )
        for p, c in pairs
    ]
    hits = melt(df, rows, [col(key).alias("key")]).where(F.size("found") > 0)
    single = hits.select("key", "pattern", "column", "context", F.posexplode("found").alias("position", "value"))
    first = Window.partitionBy("pattern", "column").orderBy("key", "position")
    return (
        single.withColumn("sample", F.row_number().over(first))
        .where(F.col("sample") <= k)
        .select("pattern", "column", "sample", "key", "position", "value", "context")
    )


def _literal_replacement(text: str) -> str:
    return re.sub(r"([\\$])", r"\\\1", text)


def _steps(
    df: DataFrame, chosen: Mapping[str, str], columns: Sequence[str], replacement: str, tally: bool
) -> DataFrame:
    """Apply the patterns in order; with ``tally``, also count what each one replaces."""
    out = df
    new = F.lit(_literal_replacement(replacement))
    for p in chosen:
        changed = {}
        for c in columns:
            text = col(c)
            replaced = F.regexp_replace(text, _regex(p), new)
            if p in _NEEDS:
                replaced = F.when(F.contains(text, F.lit(_NEEDS[p])), replaced).otherwise(text)
            changed[c] = replaced
        counted = (
            [_matches(col(c), p).alias(f"_{p}_{i}") for i, c in enumerate(columns)] if tally else []
        )
        out = out.select(
            *[(changed[c] if c in changed else col(c)).alias(c) for c in out.columns], *counted
        )
    return out


def redact(
    df: DataFrame,
    patterns: Sequence[str] | None = None,
    replacement: str = "[REDACTED]",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The table with every match replaced in every text column; NULL stays NULL.

    A narrow map of built-in expressions, so it also runs on a streaming table.
    """
    columns = list(columns if columns is not None else columns_of(df, "categorical"))
    return _steps(df, _chosen(patterns), columns, replacement, tally=False)


def redaction_log(
    df: DataFrame,
    patterns: Sequence[str] | None = None,
    replacement: str = "[REDACTED]",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """``pattern, column, n_redactions``: how much each step of ``redact`` replaces."""
    chosen = _chosen(patterns)
    columns = list(columns if columns is not None else columns_of(df, "categorical"))
    schema = "pattern string, column string, n_redactions bigint"
    if not (chosen and columns):
        return df.sparkSession.createDataFrame([], schema)
    texts = df.select(*[col(c) for c in columns])
    stepped = _steps(texts, chosen, columns, replacement, tally=True)
    pairs = [(p, c, f"_{p}_{i}") for p in chosen for i, c in enumerate(columns)]
    totals = stepped.agg(*[F.sum(n).cast("bigint").alias(n) for _, _, n in pairs])
    rows = [
        F.struct(
            F.lit(p).alias("pattern"), F.lit(c).alias("column"), F.col(n).alias("n_redactions")
        )
        for p, c, n in pairs
    ]
    return wide_to_long(totals, rows, schema).where(F.col("n_redactions") > 0)


def personal_names(df: DataFrame) -> DataFrame:
    """``column, keyword, risk_level`` for column names that suggest personal data."""
    risk = F.when(F.col("keyword").isin(*HIGH_RISK_NAMES), "high").otherwise("medium")
    return (
        names_table(df, df.columns)
        .withColumn("keyword", first_name_hit(F.col("column"), PERSONAL_NAMES))
        .where(F.col("keyword").isNotNull())
        .select("column", "keyword", risk.alias("risk_level"))
    )


def gate(df: DataFrame, action: str = "redact", patterns: Sequence[str] | None = None) -> DataFrame:
    """What intake does with a table: redact it when the risk is medium or high.

    ``action`` ``block`` raises on such a table instead, ``none`` lets it pass.
    """
    if action not in ("redact", "block", "none"):
        raise ValueError(f"Unknown action: {action}")
    if action == "none" or summarize(df, patterns).first()["risk_level"] not in ("medium", "high"):
        return df
    if action == "block":
        raise ValueError("Personal data found and the action is block")
    return redact(df, patterns)
