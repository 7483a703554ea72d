"""Deterministic train / validation / test splits and cross-validation folds.

Exact sizes do not need a ranked table. A split is a comparison with the row at
a cut, so only the cut values are searched for (``functions.ordering.rank_cuts``)
and every row is labelled in place, without a shuffle. The same key gets the
same split on every run, whatever the partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, distinct_up_to, kind, present
from ..functions.hashing import uniform
from ..functions.ordering import rank_cuts

# A target with at most 20 values is stratified.
STRATA_LIMIT = 20
DEFAULT_TEST = 0.2
DEFAULT_VAL = 0.2
DEFAULT_SEED = 42

_REST = "rest"


def infer_task(df: DataFrame, target: str) -> str:
    """``classification`` for at most 20 values of integer or string type, else ``regression``."""
    dtype = df.schema[target].dataType
    labels = isinstance(dtype, (T.StringType, T.BooleanType, *_INTEGERS))
    few = labels and distinct_up_to(df, col(target), STRATA_LIMIT) is not None
    return "classification" if few else "regression"


_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def allocate(counts: Mapping, total: int) -> dict:
    """Share ``total`` draws among strata in proportion, largest remainders first.

    Equal remainders go to the stratum listed first.
    """
    rows = sum(counts.values())
    exact = {s: n * total / rows for s, n in counts.items()}
    share = {s: math.floor(x) for s, x in exact.items()}
    left = total - sum(share.values())
    by_remainder = sorted(counts, key=lambda s: -(exact[s] - share[s]))
    for s in by_remainder[:left]:
        share[s] += 1
    return share


def _strata(df: DataFrame, target: str) -> dict[object, tuple[Column, int]]:
    """Condition and row count of each stratum; one stratum when the target has many values."""
    value = present(df, target)
    values = distinct_up_to(df, value, STRATA_LIMIT)
    if values is None:
        return {_REST: (F.lit(True), df.count())}
    found = {
        r["v"]: r["n"]
        for r in df.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()
    }  # at most 21 rows
    strata = {v: (value == F.lit(v), found[v]) for v in values}
    if None in found:
        strata[None] = (value.isNull(), found[None])
    return strata


def _label(parts: Sequence[tuple[Column, str]], last: str) -> Column:
    out = F.lit(last)
    for condition, name in reversed(parts):
        out = F.when(condition, name).otherwise(out)
    return out


def random_split(
    df: DataFrame,
    target: str,
    keys: Sequence[Column | str],
    test_size: float = DEFAULT_TEST,
    val_size: float = DEFAULT_VAL,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Add ``split``: a random, stratified split of exact size.

    ``test_size`` and ``val_size`` are shares of the whole table, both rounded
    up. Strata share the training rows by largest remainder. Within a stratum
    the rows with the smallest hash are test rows, the next ones validation.
    ``keys`` must identify a row.
    """
    if target not in df.columns:
        raise ValueError(f"The table has no target column {target!r}")
    strata = _strata(df, target)
    sizes = {s: n for s, (_, n) in strata.items()}
    total = sum(sizes.values())
    if total == 0:
        return df.withColumn("split", F.lit("train"))
    n_test = math.ceil(test_size * total)
    rest = allocate(sizes, total - n_test)
    n_val = math.ceil(val_size / (1 - test_size) * (total - n_test))
    train = allocate(rest, total - n_test - n_val)
    hashed = df.withColumn("_u", uniform(keys, seed))
    order = [F.col("_u"), uniform(keys, seed, "tie")]
    wanted = {
        s: (where, n, (n - rest[s], n - train[s])) for s, (where, n) in strata.items()
    }
    cuts = rank_cuts(hashed, order, wanted)
    parts = []
    for s, (_, _, (test, val)) in wanted.items():
        parts.append((cuts[(s, test)], "test"))
        parts.append((cuts[(s, val)], "val"))
    return hashed.withColumn("split", _label(parts, "train")).drop("_u")


def hashed_split(
    df: DataFrame,
    keys: Sequence[Column | str],
    test_size: float = DEFAULT_TEST,
    val_size: float = DEFAULT_VAL,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Add ``split`` by comparing the hash with the shares: no job at all, sizes vary slightly."""
    u = uniform(keys, seed)
    split = F.when(u < test_size, "test").when(u < test_size + val_size, "val").otherwise("train")
    return df.withColumn("split", split)


def instant(df: DataFrame, name: str) -> Column:
    """A date, timestamp or number as a double that keeps its order.

    A double holds microseconds exactly until the year 2255.
    """
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.DateType):
        return F.unix_date(col(name)).cast("double")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col(name)).cast("double")
    if isinstance(dtype, T.TimestampNTZType):
        at = col(name)
        seconds = F.hour(at).cast("bigint") * 3600 + F.minute(at).cast("bigint") * 60
        micros = (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("bigint")
        days = F.unix_date(F.to_date(at)).cast("bigint")
        return (days * F.lit(86_400_000_000) + seconds * 1_000_000 + micros).cast("double")
    if kind(dtype) == "numeric":
        return present(df, name).cast("double")
    raise ValueError(f"Column '{name}' has no time order")


def time_split(
    df: DataFrame,
    time_col: str,
    keys: Sequence[Column | str],
    test_size: float = DEFAULT_TEST,
    val_size: float = DEFAULT_VAL,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Add ``split``: oldest rows train, newest test.

    Test is the last share of all rows, validation the last share of what is
    left. Rows of one instant are ordered by the hash of their key; rows without
    a time count as newest.
    """
    if time_col not in df.columns:
        raise ValueError(f"Time column '{time_col}' not found")
    total = df.count()
    test_start = int(total * (1 - test_size))
    val_start = int(test_start * (1 - val_size))
    at = F.coalesce(instant(df, time_col), F.lit(float("inf")))
    order = [at, uniform(keys, seed), uniform(keys, seed, "tie")]
    cuts = rank_cuts(df, order, {_REST: (F.lit(True), total, (val_start, test_start))})
    parts = [(cuts[(_REST, val_start)], "train"), (cuts[(_REST, test_start)], "val")]
    return df.withColumn("split", _label(parts, "test"))


def make_splits(
    df: DataFrame,
    target: str,
    policy: str,
    keys: Sequence[Column | str],
    time_col: str | None = None,
    test_size: float = DEFAULT_TEST,
    val_size: float = DEFAULT_VAL,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """``iid`` or ``time`` split. An unknown policy raises ``ValueError``."""
    if target not in df.columns:
        raise ValueError(f"The table has no target column {target!r}")
    if policy == "iid":
        return random_split(df, target, keys, test_size, val_size, seed)
    if policy == "time":
        if time_col is None:
            raise ValueError("A time split needs time_col")
        return time_split(df, time_col, keys, test_size, val_size, seed)
    raise ValueError(f"No split is made by {policy!r}: choose 'iid' or 'time'")


def split_rows(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("split") == name).drop("split")


def split_summary(df: DataFrame) -> DataFrame:
    """``split, n_rows, proportion``; always the three splits, also an empty one."""
    tally = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")],
    )
    return tally.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(s).alias("split"),
                        F.col(s).alias("n_rows"),
                        F.try_divide(F.col(s), F.col("rows")).cast("double").alias("proportion"),
                    )
                    for s in ("train", "val", "test")
                ]
            )
        )
    )


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """``split, value, n_rows``; no rows when the target has more than 20 values."""
    counts = (
        df.where(~present(df, target).isNull())
        .groupBy("split", col(target).alias("value"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    if distinct_up_to(df, present(df, target), STRATA_LIMIT) is None:
        return counts.limit(0)
    return counts


def time_ranges(df: DataFrame, time_col: str) -> DataFrame:
    """First and last instant of each split."""
    return df.groupBy("split").agg(
        F.min(col(time_col)).alias("first"), F.max(col(time_col)).alias("last")
    )


def assign_folds(
    df: DataFrame,
    keys: Sequence[Column | str],
    n_folds: int = 3,
    target: str | None = None,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Add ``fold``: folds whose sizes differ by at most one, per class when ``target`` is given."""
    if target is None:
        strata = {_REST: (F.lit(True), df.count())}
    else:
        strata = _strata(df, target)
    hashed = df.withColumn("_u", uniform(keys, seed, "fold"))
    order = [F.col("_u"), uniform(keys, seed, "fold tie")]
    ends = {s: [n * i // n_folds for i in range(1, n_folds)] for s, (_, n) in strata.items()}
    cuts = rank_cuts(hashed, order, {s: (where, n, ends[s]) for s, (where, n) in strata.items()})
    fold = F.lit(n_folds - 1)
    for i in reversed(range(n_folds - 1)):
        here = F.lit(False)
        for s in strata:
            here = here | cuts[(s, ends[s][i])]
        fold = F.when(here, F.lit(i)).otherwise(fold)
    return hashed.withColumn("fold", fold).drop("_u")


def time_folds(
    df: DataFrame, time_col: str, keys: Sequence[Column | str], n_folds: int = 3, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Add ``fold``: equal stretches of time, 0 the oldest.

    Fold k is tested with a model trained on the folds before it, so there are
    ``n_folds`` tests and ``n_folds + 1`` stretches.
    """
    total = df.count()
    at = F.coalesce(instant(df, time_col), F.lit(float("inf")))
    order = [at, uniform(keys, seed), uniform(keys, seed, "tie")]
    ends = [total * i // (n_folds + 1) for i in range(1, n_folds + 1)]
    cuts = rank_cuts(df, order, {_REST: (F.lit(True), total, ends)})
    fold = F.lit(n_folds)
    for i in reversed(range(n_folds)):
        fold = F.when(cuts[(_REST, ends[i])], F.lit(i)).otherwise(fold)
    return df.withColumn("fold", fold)


def stretches(
    df: DataFrame, time_col: str, keys: Sequence[Column | str], count: int, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Add ``stretch``: ``count`` parts of equal size along time, 0 the oldest."""
    if count < 2:
        raise ValueError("a rolling split needs two stretches or more")
    return time_folds(df, time_col, keys, count - 1, seed).withColumnRenamed("fold", "stretch")


def rolling_roles(
    df: DataFrame, folds: int = 3, window: int | None = None, gap: int = 0, test: int = 1, val: int = 0, first: int = 1
) -> DataFrame:
    """``fold, role, first, last``: which stretches each fold trains, validates and tests on.

    Fold k trains on the stretches up to ``first + k - 1``, all of them or the last
    ``window``; after ``gap`` stretches that are left out come ``val`` stretches of
    validation and ``test`` of test. A row belongs to several folds, so roles are
    intervals of stretches and rows are never copied.
    """
    if min(folds, first, test) < 1 or min(gap, val) < 0 or (window is not None and window < 1):
        raise ValueError("folds, first, test and window must be positive, gap and val not negative")
    rows = []
    for k in range(folds):
        end = first + k
        rows.append((k, "train", 0 if window is None else max(end - window, 0), end - 1))
        if val:
            rows.append((k, "val", end + gap, end + gap + val - 1))
        rows.append((k, "test", end + gap + val, end + gap + val + test - 1))
    return df.sparkSession.createDataFrame(rows, "fold int, role string, first int, last int")


def stretch_count(folds: int = 3, gap: int = 0, test: int = 1, val: int = 0, first: int = 1) -> int:
    """How many stretches ``rolling_roles`` speaks of."""
    return first + folds - 1 + gap + val + test


def rolling_split(
    df: DataFrame, time_col: str, keys: Sequence[Column | str], folds: int = 3, window: int | None = None,
    gap: int = 0, test: int = 1, val: int = 0, first: int = 1, seed: int = DEFAULT_SEED,
) -> tuple[DataFrame, DataFrame]:
    """The rows with their stretch, and the roles of the stretches in each fold."""
    count = stretch_count(folds, gap, test, val, first)
    return stretches(df, time_col, keys, count, seed), rolling_roles(df, folds, window, gap, test, val, first)


def fold_sides(roles: DataFrame, held: str = "test") -> dict[int, tuple[Column, Column]]:
    """Per fold the condition of training rows and of held-out rows; one row of roles per fold and role."""
    found = {(r["fold"], r["role"]): F.col("stretch").between(r["first"], r["last"]) for r in roles.collect()}
    return {fold: (found[fold, "train"], found[fold, held]) for fold, role in found if role == "train"}


def rolling_rows(df: DataFrame, roles: DataFrame, fold: int, role: str) -> DataFrame:
    """The rows of one role in one fold."""
    train, held = fold_sides(roles, role)[fold] if role != "train" else fold_sides(roles)[fold]
    return df.where(train if role == "train" else held)


def rolling_summary(df: DataFrame, roles: DataFrame, time_col: str) -> DataFrame:
    """``fold, role, n_rows, start, end``: sizes and time ranges, from one row per stretch."""
    per = df.groupBy("stretch").agg(
        F.count(F.lit(1)).alias("n"), F.min(col(time_col)).alias("start"), F.max(col(time_col)).alias("end")
    )  # one row per stretch
    within = (F.col("stretch") >= F.col("first")) & (F.col("stretch") <= F.col("last"))
    return (
        F.broadcast(roles).join(per, within, "left")
        .groupBy("fold", "role")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.min("start").alias("start"), F.max("end").alias("end"))
    )


def stratified_sample(
    df: DataFrame, target: str, keys: Sequence[Column | str], n: int, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Exactly n rows (all rows of a smaller table), strata of the target in proportion."""
    strata = _strata(df, target)
    sizes = {s: size for s, (_, size) in strata.items()}
    if sum(sizes.values()) <= n:
        return df
    share = allocate(sizes, n)
    hashed = df.withColumn("_u", uniform(keys, seed, "sample"))
    order = [F.col("_u"), uniform(keys, seed, "sample tie")]
    cuts = rank_cuts(hashed, order, {s: (w, size, (share[s],)) for s, (w, size) in strata.items()})
    chosen = F.lit(False)
    for s in strata:
        chosen = chosen | cuts[(s, share[s])]
    return hashed.where(chosen).drop("_u")
