"""A feature plan carried out: imputation, powers, scaling, encodings and products fitted on the training rows.

Each column goes through its transforms in a fixed order, whatever the order of the
list: imputation, powers, scaling, then encoding or products. What a transform learns
depends on the ones before it, yet the table is not scanned once per transform:
moments, smallest and largest values of all columns come from one scan of the present
cells, and the cells that imputation fills are added by their share.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, kinds, melt, number
from ..functions.ordering import quantiles
from ..functions.storage import kept
from .encoders import (
    HASH_WIDTH,
    SMOOTHING,
    TARGET_FOLDS,
    TargetMeans,
    fit_target_means,
    hash_encode,
    one_hot,
    target_encode,
)
from .features import UNSEEN, encode, fit_vocabulary

# The names of transforms, by the stage they belong to.
IMPUTE = ("impute_median", "impute_mean", "impute_mode")
POWER = ("log_transform", "sqrt_transform", "box_cox_transform")
SCALE = ("standard_scale", "min_max_scale", "robust_scale")
ENCODE = ("label_encode", "ordinal_encode", "one_hot_encode", "target_encode", "high_cardinality_encode")
PRODUCT = ("polynomial_features", "interaction_features")

# The exponent is searched for between these ends, by so many candidates per scan.
EXPONENTS = (-5.0, 5.0)
CANDIDATES = 33
# Candidates that one row is added to at once; more aggregates than Spark compiles together are slower.
TOGETHER = 11
EXPONENT_STEP = 1e-4
# The grid of exponents meets 0 up to rounding.
ZERO = 1e-9
# Columns that products may add.
MOST_PRODUCTS = 1000


@dataclass(frozen=True)
class Options:
    """What the names of the transforms leave open."""

    degree: int = 2
    hash_width: int = HASH_WIDTH
    drop_last: bool = False
    target_folds: int = TARGET_FOLDS
    smoothing: float = SMOOTHING
    seed: int = 42
    orders: Mapping[str, Sequence[str]] = field(default_factory=dict)
    small_rows: int | None = None


@dataclass
class PlanParams:
    """What ``fit_plan`` learned, per column and transform."""

    steps: dict[str, list[str]]
    options: Options
    fills: dict[str, object] = field(default_factory=dict)
    exponents: dict[str, float] = field(default_factory=dict)
    scales: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    vocabulary: DataFrame | None = None
    small_vocabulary: bool = True
    means: TargetMeans | None = None

    def having(self, step: str) -> list[str]:
        return [c for c, steps in self.steps.items() if step in steps]

    def table(self, df: DataFrame) -> DataFrame:
        """``column, fill, exponent, shift, spread``, one row per column of the plan."""
        rows = [
            (c, None if self.fills.get(c) is None else str(self.fills[c]), self.exponents.get(c),
             *self.scales.get(c, (None, None)))
            for c in self.steps
        ]
        return df.sparkSession.createDataFrame(
            rows, "column string, fill string, exponent double, shift double, spread double"
        )


def steps_of(plan: DataFrame) -> dict[str, list[str]]:
    """The transforms of each column of a plan, which has one row per column."""
    rows = sorted(plan.select("position", "column", "transforms").collect(), key=lambda r: r["position"])
    return {r["column"]: list(r["transforms"]) for r in rows}


def check_steps(df: DataFrame, steps: Mapping[str, Sequence[str]]) -> None:
    """An error for a transform that is unknown, doubled or not for the column's type."""
    kind_of = kinds(df)
    for c, names in steps.items():
        if c not in kind_of:
            raise ValueError(f"The plan names a column {c!r} that the table lacks")
        for name in names:
            if name not in IMPUTE + POWER + SCALE + ENCODE + PRODUCT:
                raise ValueError(f"No transform is called {name!r}")
            text = name in ENCODE
            fits = name == "impute_mode" or kind_of[c] == ("categorical" if text else "numeric")
            if not fits:
                raise ValueError(f"{name} does not fit column {c!r} of kind {kind_of[c]}")
        for stage in (IMPUTE, SCALE, ENCODE):
            if len([n for n in names if n in stage]) > 1:
                raise ValueError(f"Column {c!r} has two of {', '.join(stage)}")


# --- powers ------------------------------------------------------------------


def power(value: Column, steps: Iterable[str], exponent: float | None) -> Column:
    """Logarithm of 1 + x, square root and Box-Cox, in the order listed; NULL where undefined."""
    for name in steps:
        if name == "log_transform":
            value = F.when(value > -1, F.log1p(value))
        elif name == "sqrt_transform":
            value = F.when(value >= 0, F.sqrt(value))
        elif name == "box_cox_transform":
            value = box_cox(value, exponent)
    return value


def box_cox(value: Column, exponent: float | None) -> Column:
    """(x ** e - 1) / e, the logarithm for e = 0; NULL where x is not positive."""
    if exponent is None:
        return F.lit(None).cast("double")
    curve = F.ln(value) if abs(exponent) < ZERO else (F.pow(value, F.lit(exponent)) - 1) / F.lit(exponent)
    return F.when(value > 0, curve)


def box_cox_exponents(
    df: DataFrame, values: Mapping[str, Column], step: float = EXPONENT_STEP
) -> dict[str, tuple[float, float, float]]:
    """Per column the exponent of the largest likelihood, and the mean and variance of the transformed values.

    Values are divided by their geometric mean, which makes the likelihood
    -n/2 ln(variance). A scan takes the variance for all candidates of an interval at
    once; the neighbours of the best one are the next interval, until candidates are
    closer than ``step``. A column with a value that is not positive is an error, one
    without values or with a single one gets exponent 1.
    """
    if not values:
        return {}
    names = list(values)
    cells = {c: F.col(f"v{i}") for i, c in enumerate(names)}
    with kept(df.select(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(values.values())])) as narrow:
        return _exponents(narrow, cells, step)


def _exponents(
    df: DataFrame, values: Mapping[str, Column], step: float
) -> dict[str, tuple[float, float, float]]:
    row = df.agg(*[
        F.struct(F.count(v), F.min(v), F.max(v), F.avg(F.ln(v))).alias(f"s{i}")
        for i, v in enumerate(values.values())
    ]).first()
    found: dict[str, tuple[float, float, float]] = {}
    logs: dict[str, float] = {}
    for i, c in enumerate(values):
        n, low, high, log = row[i]
        if n and low <= 0:
            raise ValueError(f"Box-Cox needs positive values, column {c!r} has {low}")
        if not n or low == high:
            found[c] = (1.0, (low or 1.0) - 1, 0.0)
        else:
            logs[c] = log
    spans = {c: EXPONENTS for c in logs}
    while spans:
        tried = {
            c: [low + (high - low) * k / (CANDIDATES - 1) for k in range(CANDIDATES)] for c, (low, high) in spans.items()
        }
        unit = [
            F.struct(
                F.lit(c).alias("column"),
                F.lit(first).alias("first"),
                (F.ln(values[c]) - F.lit(logs[c])).alias("log"),
                F.array(*[F.lit(e) for e in grid[first : first + TOGETHER]]).alias("grid"),
            )
            for c, grid in tried.items()
            for first in range(0, CANDIDATES, TOGETHER)
        ]
        # A row per value and so many candidates: each is added to all of them at once.
        curves = [_curve(F.col("log"), F.get("grid", F.lit(k))) for k in range(TOGETHER)]
        pairs = F.array(*[F.struct(F.avg(v).alias("mean"), F.var_pop(v).alias("variance")) for v in curves])
        moments = {
            (r["column"], r["first"] + k): pair
            for r in melt(df, unit).groupBy("column", "first").agg(pairs.alias("pairs")).collect()
            for k, pair in enumerate(r["pairs"])
        }
        for c, grid in tried.items():
            here = [moments[c, k] for k in range(CANDIDATES)]
            best = min(range(CANDIDATES), key=lambda k: here[k]["variance"])
            e = grid[best]
            low, high = grid[max(best - 1, 0)], grid[min(best + 1, CANDIDATES - 1)]
            if grid[1] - grid[0] <= step:
                grown = math.exp(logs[c] * e)
                base = logs[c] if abs(e) < ZERO else (grown - 1) / e
                found[c] = (e, grown * here[best]["mean"] + base, grown * grown * here[best]["variance"])
                del spans[c]
            else:
                spans[c] = (low, high)
    return found


def _curve(log: Column, exponent: Column) -> Column:
    """Box-Cox of the value whose logarithm is given."""
    return F.when(F.abs(exponent) < ZERO, log).otherwise((F.exp(exponent * log) - 1) / exponent)


# --- fitting -----------------------------------------------------------------


def modes(train: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """The most frequent present value of each column, the smallest one on a tie, in one pass."""
    if not columns:
        return {}
    types = {f.name: f.dataType.simpleString() for f in train.schema.fields}
    found: dict[str, object] = {}
    # Values of one type can share a column; there are few types.
    for dtype in dict.fromkeys(types[c] for c in columns):
        own = [c for c in columns if types[c] == dtype]
        pairs = [F.struct(F.lit(c).alias("column"), col(c).alias("value")) for c in own]
        cells = melt(train, pairs).where(F.col("value").isNotNull())
        if dtype in ("float", "double"):
            cells = cells.where(~F.isnan("value"))
        counted = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        best = counted.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
        found |= {r["column"]: r["value"] for r in best.collect()}
    return found


def _with_fill(present: int, rows: int, mean: float, variance: float, fill: float | None) -> tuple[float, float]:
    """Mean and population variance once the missing cells hold the fill."""
    if fill is None or present == rows:
        return mean, variance
    share, gap = present / rows, fill - mean
    return mean + (1 - share) * gap, share * variance + share * (1 - share) * gap * gap


def _power_of(value: float | None, steps: Iterable[str], exponent: float | None) -> float | None:
    """``power`` of one number, as the driver needs it for a fill."""
    for name in steps:
        if value is None:
            return None
        if name == "log_transform":
            value = math.log1p(value) if value > -1 else None
        elif name == "sqrt_transform":
            value = math.sqrt(value) if value >= 0 else None
        elif exponent is None or value <= 0:
            value = None
        else:
            value = math.log(value) if abs(exponent) < ZERO else (value**exponent - 1) / exponent
    return value


def fit_plan(
    train: DataFrame,
    steps: Mapping[str, Sequence[str]],
    target: str | None = None,
    keys: Sequence[str] = (),
    options: Options | None = None,
) -> PlanParams:
    """Learn what the transforms of a plan need from the training rows alone.

    ``target`` and ``keys`` are needed for target means. A column of which no cell is
    present stays without values.
    """
    options = options or Options()
    check_steps(train, steps)
    params = PlanParams({c: list(names) for c, names in steps.items()}, options)
    kind_of = kinds(train)
    numeric = [c for c in steps if kind_of[c] == "numeric"]
    text = [c for c in steps if kind_of[c] == "categorical"]
    powers = {c: [n for n in steps[c] if n in POWER] for c in numeric}
    plain = {c: power(number(train, c), [n for n in powers[c] if n != "box_cox_transform"], None) for c in numeric}
    row = train.agg(
        F.count(F.lit(1)),
        *[F.struct(F.count(v), F.avg(v)).alias(f"r{i}") for i, v in enumerate(number(train, c) for c in numeric)],
        *[
            F.struct(F.count(v), F.avg(v), F.var_pop(v), F.min(v), F.max(v)).alias(f"s{i}")
            for i, v in enumerate(plain.values())
        ],
    ).first()
    rows = row[0]
    raw = dict(zip(numeric, row[1 : 1 + len(numeric)]))
    seen = dict(zip(numeric, row[1 + len(numeric) :]))

    medians = params.having("impute_median")
    if medians:
        found = quantiles(train, {c: number(train, c) for c in medians}, [0.5], {c: raw[c][0] for c in medians})
        params.fills |= {c: found[c][0] for c in medians}
    params.fills |= {c: raw[c][1] for c in params.having("impute_mean")}
    params.fills |= modes(train, params.having("impute_mode"))

    full = {c: _filled(train, c, params) for c in numeric}
    # What stands before Box-Cox in the list is applied before it.
    before = {c: powers[c][: powers[c].index("box_cox_transform")] for c in params.having("box_cox_transform")}
    curves = box_cox_exponents(train, {c: power(full[c], before[c], None) for c in before})
    params.exponents |= {c: found[0] for c, found in curves.items()}

    ranked = params.having("robust_scale")
    if ranked:
        of = {c: power(full[c], powers[c], params.exponents.get(c)) for c in ranked}
        for c, (q1, mid, q3) in quantiles(train, of, [0.25, 0.5, 0.75]).items():
            params.scales[c] = (mid, (q3 - q1) or 1.0) if mid is not None else (None, None)
    later = {c: powers[c][powers[c].index("box_cox_transform") + 1 :] for c in before}
    again = [c for c in before if later[c] or "min_max_scale" in steps[c]]
    if again:  # what follows Box-Cox has moments of its own
        of = {c: power(full[c], powers[c], params.exponents[c]) for c in again}
        row = train.agg(*[
            F.struct(F.count(v), F.avg(v), F.var_pop(v), F.min(v), F.max(v)).alias(f"s{i}")
            for i, v in enumerate(of.values())
        ]).first()
        seen |= dict(zip(again, row))
    for c in [*params.having("standard_scale"), *params.having("min_max_scale")]:
        params.scales[c] = _scale(c, params, seen[c], rows, curves.get(c) if c not in again else None, c in again, powers[c])

    filled = train.withColumns({c: _filled(train, c, params) for c in text})
    coded = [c for c in text if set(steps[c]) & {"label_encode", "ordinal_encode", "one_hot_encode"}]
    coded = [c for c in coded if not ("ordinal_encode" in steps[c] and c in options.orders)]
    if coded:
        params.vocabulary, params.small_vocabulary = fit_vocabulary(filled, coded, options.small_rows)
    means = params.having("target_encode")
    if means:
        if target is None or not keys:
            raise ValueError("target means need a target and keys")
        params.means = fit_target_means(
            filled, means, target, keys, options.target_folds, options.smoothing, options.seed, options.small_rows
        )
    return params


def _filled(df: DataFrame, name: str, params: PlanParams) -> Column:
    value = number(df, name) if kinds(df)[name] == "numeric" else col(name)
    fill = params.fills.get(name)
    return value if fill is None else F.coalesce(value, F.lit(fill).cast(value_type(df, name)))


def value_type(df: DataFrame, name: str) -> str:
    return "double" if kinds(df)[name] == "numeric" else df.schema[name].dataType.simpleString()


def _scale(
    name: str, params: PlanParams, seen: Sequence, rows: int, curve, whole: bool, powers: Sequence[str]
) -> tuple[float | None, float | None]:
    """Shift and spread of standard and min-max scaling from moments of the present cells."""
    present, mean, variance, low, high = seen
    if curve is not None:
        mean, variance = curve[1], curve[2]
    elif not present:
        return None, None
    elif not whole:
        fill = params.fills.get(name)
        fill = _power_of(None if fill is None else float(fill), powers, None)
        if fill is not None and present < rows:
            low, high = min(low, fill), max(high, fill)
        mean, variance = _with_fill(present, rows, mean, variance, fill)
    if "min_max_scale" in params.steps[name]:
        return low, (high - low) or 1.0
    return mean, math.sqrt(variance) or 1.0


# --- applying ----------------------------------------------------------------


def monomials(names: Sequence[str], degree: int, repeated: bool = True) -> list[tuple[str, ...]]:
    """Products of two to ``degree`` of the columns, each as a sorted tuple; with powers if ``repeated``."""
    out = [
        combo
        for size in range(2, degree + 1)
        for combo in combinations_with_replacement(names, size)
        if repeated or len(set(combo)) == size
    ]
    if len(out) > MOST_PRODUCTS:
        raise ValueError(f"{len(out)} products, {MOST_PRODUCTS} are the most")
    return out


def product_name(combo: Sequence[str]) -> str:
    """``a^2*b`` for a, a, b."""
    return "*".join(c if combo.count(c) == 1 else f"{c}^{combo.count(c)}" for c in dict.fromkeys(combo))


def add_products(df: DataFrame, combos: Iterable[Sequence[str]]) -> DataFrame:
    """The products as new columns, named by ``product_name``."""
    cells = {}
    for combo in combos:
        value = col(combo[0]).cast("double")
        for c in combo[1:]:
            value = value * col(c).cast("double")
        cells[product_name(list(combo))] = value
    return df.select("*", *[v.alias(n) for n, v in cells.items()])


def products_of(params: PlanParams) -> list[tuple[str, ...]]:
    """Powers of the columns with polynomial features, then products of those with interactions."""
    degree = params.options.degree
    powers = [(c,) * d for c in params.having("polynomial_features") for d in range(2, degree + 1)]
    return [*powers, *monomials(params.having("interaction_features"), degree, repeated=False)]


def apply_plan(df: DataFrame, params: PlanParams, learned: Column | None = None) -> DataFrame:
    """Apply a fitted plan to any rows; columns it does not name pass through.

    All number columns are one projection. ``learned`` marks rows that the target means
    were learned from, as in ``encoders.target_encode``.
    """
    kind_of = kinds(df)
    cells = {}
    for c, steps in params.steps.items():
        if not set(steps) - {*PRODUCT}:
            continue
        value = _filled(df, c, params)
        if kind_of[c] == "numeric" and set(steps) & {*IMPUTE, *POWER, *SCALE}:
            value = power(value, [n for n in steps if n in POWER], params.exponents.get(c))
            if c in params.scales:
                shift, spread = params.scales[c]
                value = (value - F.lit(shift).cast("double")) / F.lit(spread).cast("double")
        elif "ordinal_encode" in steps and c in params.options.orders:
            order = F.array(*[F.lit(v) for v in params.options.orders[c]])
            place = F.array_position(order, value).cast("bigint") - 1
            value = F.coalesce(place, F.lit(UNSEEN).cast("bigint"))
        cells[c] = value
    out = df.select(*[(cells[c] if c in cells else col(c)).alias(c) for c in df.columns])
    codes = [
        c for c in [*params.having("label_encode"), *params.having("ordinal_encode")]
        if not ("ordinal_encode" in params.steps[c] and c in params.options.orders)
    ]
    if codes:
        out = encode(out, params.vocabulary, codes, params.small_vocabulary)
    if params.means is not None:
        out = target_encode(out, params.means, learned)
    if vectors := params.having("one_hot_encode"):
        out = one_hot(out, params.vocabulary, vectors, params.small_vocabulary, params.options.drop_last)
    if hashed := params.having("high_cardinality_encode"):
        out = hash_encode(out, hashed, params.options.hash_width)
    combos = products_of(params)
    return add_products(out, combos) if combos else out


def run_plan(
    df: DataFrame, plan: DataFrame, target: str, keys: Sequence[str] = (), options: Options | None = None
) -> tuple[DataFrame, PlanParams]:
    """Carry out the plan's own transforms: fitted on ``split = 'train'``, applied to all rows."""
    params = fit_plan(df.where(F.col("split") == "train"), steps_of(plan), target, keys, options)
    return apply_plan(df, params), params
