"""Exact order statistics, rank cuts and running totals without a global sort.

A window without PARTITION BY, and the percentile aggregates, pull a whole column
or all its sketches into one task. Here quantile sketches, merged by groups of
partitions, tell about where a rank lies; the rows below that interval are counted
and those inside are counted in its cells: plain sums, of which each task keeps a few
thousand rows. The cell with the wanted rank is the next interval, until it holds one
value. A sketch that was wrong costs a search by powers of two, never a wrong result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import kept, stored

# Cells of one interval in one round.
CELLS = 4096
# Intervals counted in one scan.
INTERVALS_PER_SCAN = 32
# Size of a quantile sketch, the share of the rows it may be off, and how many are merged first.
SKETCH = 4000
SKETCH_ERROR = 0.001
SKETCH_GROUPS = 64
# Columns sketched in one scan.
SKETCHES_PER_SCAN = 64
# Octaves of a double lie well inside these bounds; infinities and NaN get cells outside.
OCTAVES = 3000


@dataclass(frozen=True)
class Ranked:
    """The value at a rank, and how many values lie below it and up to it."""

    value: float
    below: int
    upto: int


@dataclass
class _Search:
    """Closed interval [low, high] of values that holds the one at ``rank``, or is likely to if ``guessed``."""

    name: str
    rank: int
    below: int
    low: float | None = None
    high: float | None = None
    guessed: bool = False


def counts(df: DataFrame, values: Mapping[str, Column]) -> dict[str, int]:
    """Non-null count of every column expression, in one pass."""
    names = list(values)
    row = df.agg(*[F.count(values[n]).alias(f"c{i}") for i, n in enumerate(names)]).first()
    return {n: row[i] for i, n in enumerate(names)}


def _octave(value: Column) -> Column:
    """Sign and power of two as one integer that grows with the value."""
    size = F.floor(F.log2(F.abs(value))) + OCTAVES / 2
    return (
        F.when(F.isnan(value), F.lit(2 * OCTAVES))
        .when(F.abs(value) == float("inf"), F.signum(value) * OCTAVES)
        .when(value == 0, F.lit(0))
        .otherwise(F.signum(value) * size)
        .cast("int")
    )


def _cell(value: Column, low: float | None, high: float | None) -> Column:
    """The cell of a value in an interval, NULL outside. Never falls as the value grows."""
    if low is None:
        return F.when(value.isNotNull(), _octave(value))
    if low == high:
        return F.when(value == F.lit(low), F.lit(0))
    inside = (value >= F.lit(low)) & (value <= F.lit(high))
    return F.when(inside, F.floor((value - F.lit(low)) / F.lit(high - low) * CELLS).cast("int"))


def order_statistics(
    df: DataFrame,
    values: Mapping[str, Column],
    ranks: Mapping[str, Sequence[int]],
    sizes: Mapping[str, int] | None = None,
) -> dict[tuple[str, int], Ranked]:
    """The value at each 0-based rank of each double column expression. Exact.

    ``values`` names the expressions, ``ranks`` the ranks wanted of each; nulls
    are left out. ``sizes`` may pass non-null counts already known. The expressions
    are computed once and kept while the search lasts. Sketches bracket the ranks, then
    each round counts 4,096 equal cells between the smallest and the largest value of
    the interval before. The search of a rank ends at a cell with one value, which a
    value with very many copies soon has to itself.
    """
    names = [n for n in values if ranks.get(n)]
    if not names:
        return {}
    narrow = df.select(*[values[n].cast("double").alias(f"v{i}") for i, n in enumerate(names)])
    with kept(narrow) as rows:
        cells = {n: F.col(f"v{i}") for i, n in enumerate(names)}
        sizes = dict(sizes) if sizes is not None else counts(rows, cells)
        searches = [
            _Search(name, rank, 0) for name in names for rank in sorted(set(ranks[name])) if 0 <= rank < sizes[name]
        ]
        found: dict[tuple[str, int], Ranked] = {}
        _bracket(rows, cells, searches, sizes)
        while searches:
            groups = _by_interval(searches)
            for start in range(0, len(groups), INTERVALS_PER_SCAN):
                _narrow(rows, cells, groups[start : start + INTERVALS_PER_SCAN], found)
            searches = [s for s in searches if (s.name, s.rank) not in found]
    return found


def _bracket(
    rows: DataFrame, cells: Mapping[str, Column], searches: Sequence[_Search], sizes: Mapping[str, int]
) -> None:
    """Likely intervals of the ranks from sketches, and how many values lie below them.

    A sketch per task, merged by groups of partitions and then once more: no task gets
    more than so many sketches. Columns of few rows need none.
    """
    near: list[list[_Search]] = []
    for s in searches:
        slack = SKETCH_ERROR * sizes[s.name]
        if sizes[s.name] <= CELLS:
            continue
        if near and near[-1][0].name == s.name and s.rank - near[-1][-1].rank <= 2 * slack:
            near[-1].append(s)
        else:
            near.append([s])
    columns = list(dict.fromkeys(g[0].name for g in near))
    for start in range(0, len(columns), SKETCHES_PER_SCAN):
        some = columns[start : start + SKETCHES_PER_SCAN]
        spans = [g for g in near if g[0].name in set(some)]
        size = F.lit(SKETCH)
        first = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g")).agg(
            *[F.kll_sketch_agg_double(cells[c], size).alias(f"k{i}") for i, c in enumerate(some)]
        )
        merged = first.groupBy(F.pmod("g", F.lit(1)).alias("g")).agg(
            *[F.kll_merge_agg_double(f"k{i}", size).alias(f"k{i}") for i in range(len(some))]
        )
        ends = []
        for g in spans:
            n, sketch = sizes[g[0].name], f"k{some.index(g[0].name)}"
            shares = [max(g[0].rank / n - SKETCH_ERROR, 0.0), min((g[-1].rank + 1) / n + SKETCH_ERROR, 1.0)]
            values = F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(x) for x in shares]))
            ends.append(F.when(F.kll_sketch_get_n_double(sketch) > 0, values))
        guesses = merged.select(*[e.alias(f"e{i}") for i, e in enumerate(ends)]).first()
        good = [(g, e) for g, e in zip(spans, guesses) if e is not None and all(map(math.isfinite, e)) and e[0] <= e[1]]
        if not good:
            continue
        below = rows.agg(*[F.count_if(cells[g[0].name] < F.lit(low)) for g, (low, _) in good]).first()
        for (g, (low, high)), n in zip(good, below):
            for s in g:
                s.low, s.high, s.below, s.guessed = low, high, n, True


def _by_interval(searches: Sequence[_Search]) -> list[list[_Search]]:
    """Searches of one column that are down to the same interval share their work."""
    groups: dict[tuple, list[_Search]] = {}
    for s in searches:
        groups.setdefault((s.name, s.low, s.high), []).append(s)
    return list(groups.values())


def _layers(values: Mapping[str, Column], groups: Sequence[list[_Search]]) -> list[list[tuple[int, Column]]]:
    """The cells of intervals of one column that do not overlap, together: a value is in one of them at most."""
    layers: list[tuple[str, float, list]] = []
    order = sorted(range(len(groups)), key=lambda i: (groups[i][0].name, groups[i][0].low or 0.0))
    for i in order:
        s = groups[i][0]
        cell = (i, _cell(values[s.name], s.low, s.high))
        free = [k for k, (name, high, _) in enumerate(layers) if name == s.name and s.low is not None and high < s.low]
        if free:
            layers[free[0]] = (s.name, s.high, [*layers[free[0]][2], cell])
        else:
            layers.append((s.name, math.inf if s.low is None else s.high, [cell]))
    return [cells for _, _, cells in layers]


def _narrow(
    df: DataFrame,
    values: Mapping[str, Column],
    groups: Sequence[list[_Search]],
    found: dict[tuple[str, int], Ranked],
) -> None:
    """One scan counts the cells of all the intervals; each search moves into its cell."""
    pairs = [
        F.struct(
            reduce(F.coalesce, [F.when(c.isNotNull(), F.lit(i)) for i, c in layer]).alias("span"),
            reduce(F.coalesce, [c for _, c in layer]).alias("cell"),
            values[groups[layer[0][0]][0].name].alias("value"),
        )
        for layer in _layers(values, groups)
    ]
    if all(g[0].low is not None for g in groups):  # most rows are in no interval
        inside = [values[g[0].name].between(F.lit(g[0].low), F.lit(g[0].high)) for g in groups]
        df = df.where(reduce(Column.__or__, inside))
    cells = (
        df.select(F.inline(F.filter(F.array(*pairs), lambda x: x["cell"].isNotNull())))
        .groupBy("span", "cell")
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        .toArrow()  # at most CELLS rows per interval
    )
    span, cell, n, lows, highs = (c.to_numpy() for c in cells.columns)
    order = np.lexsort((cell, span))
    span, n, lows, highs = span[order], n[order], lows[order], highs[order]
    for i, g in enumerate(groups):
        first, last = np.searchsorted(span, [i, i + 1])
        upto = np.cumsum(n[first:last])
        for s in g:
            at = int(np.searchsorted(upto, s.rank - s.below, "right"))
            if s.rank < s.below or at == last - first:  # the sketch was off: begin with all values
                if not s.guessed:
                    raise ValueError(f"{s.name} has fewer values than its size tells")
                s.below, s.low, s.high, s.guessed = 0, None, None, False
                continue
            end = s.below + int(upto[at])
            below, low, high = end - int(n[first + at]), float(lows[first + at]), float(highs[first + at])
            if low == high or math.isnan(low):
                found[(s.name, s.rank)] = Ranked(low, below, end)
            else:
                s.below, s.low, s.high, s.guessed = below, low, high, False


def quantiles(
    df: DataFrame,
    values: Mapping[str, Column],
    probabilities: Sequence[float],
    sizes: Mapping[str, int] | None = None,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of double expressions. Exact."""
    sizes = dict(sizes) if sizes is not None else counts(df, values)
    places = {n: [(sizes[n] - 1) * q for q in probabilities] for n in values}
    ranks = {
        n: [r for at in spots for r in (int(at), min(int(at) + 1, sizes[n] - 1))]
        for n, spots in places.items()
        if sizes[n] > 0
    }
    found = order_statistics(df, values, ranks, sizes) if ranks else {}
    result: dict[str, list[float | None]] = {}
    for n, spots in places.items():
        if sizes[n] == 0:
            result[n] = [None] * len(spots)
            continue
        line = []
        for at in spots:
            low = found[(n, int(at))].value
            high = found[(n, min(int(at) + 1, sizes[n] - 1))].value
            line.append(low + (high - low) * (at - int(at)))
        result[n] = line
    return result


def rank_cuts(
    df: DataFrame,
    order: Sequence[Column],
    cuts: Mapping[str, tuple[Column, int, Sequence[int]]],
) -> dict[tuple[str, int], Column]:
    """Predicates that hold for the first k rows of a group in a given order.

    ``order`` lists double expressions without nulls, compared one after the
    other. ``cuts`` maps a group name to its row condition, its row count and the
    sizes k wanted. Only the boundary values come to the driver, so the caller
    labels rows with a plain column expression: no sort, no rank column and no
    shuffle of the table. Rows whose whole order key is equal fall on the same
    side.
    """
    predicates: dict[tuple[str, int], Column] = {}
    # group, k -> rows still tied: condition and count; rows still to take; predicate so far
    open_cuts = {}
    for g, (where, size, ks) in cuts.items():
        for k in set(ks):
            if k <= 0:
                predicates[(g, k)] = F.lit(False)
            elif k >= size:
                predicates[(g, k)] = where
            else:
                open_cuts[(g, k)] = (where, size, k, F.lit(False))
    for depth, key in enumerate(order):
        if not open_cuts:
            break
        names = {cut: str(i) for i, cut in enumerate(open_cuts)}
        exprs = {names[c]: F.when(tied[0], key) for c, tied in open_cuts.items()}
        if depth == 0:  # the cuts of one group share their rows, so search them together
            first = {}
            for (g, k), name in names.items():
                names[(g, k)] = first.setdefault(g, name)
            exprs = {n: exprs[n] for n in first.values()}
        ranks: dict[str, list[int]] = {n: [] for n in exprs}
        sizes: dict[str, int] = {}
        for cut, (_, size, take, _) in open_cuts.items():
            ranks[names[cut]].append(take - 1)
            sizes[names[cut]] = size
        found = order_statistics(df, exprs, ranks, sizes)
        still = {}
        for cut, (where, _, take, before) in open_cuts.items():
            at = found[(names[cut], take - 1)]
            edge = F.lit(at.value)
            if at.upto == take or depth == len(order) - 1:
                predicates[cut] = before | (where & (key <= edge))
            else:
                tied = where & (key == edge)
                below = before | (where & (key < edge))
                still[cut] = (tied, at.upto - at.below, take - at.below, below)
        open_cuts = still
    return predicates


def numbered(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Add the 0-based place of each row in a total order, without bringing the rows together.

    Range partitions are sorted side by side and stored, so that their limits are
    fixed; the sizes of the earlier partitions, one row each, then shift the places.
    """
    bits = 33  # monotonically_increasing_id is partition << 33 plus row in partition
    keys = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(keys, order)))
    parts = stored(
        keyed.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop(*keys)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumns({"_part": F.shiftright("_id", bits), "_row": F.col("_id").bitwiseAND(F.lit((1 << bits) - 1))})
        .drop("_id")
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift")
    )  # one row per partition
    return parts.join(F.broadcast(shifts), "_part").withColumn(name, F.col("_row") + F.col("_shift")).drop(
        "_part", "_row", "_shift"
    )


def running_totals(
    points: DataFrame,
    order: str,
    totals: Mapping[str, str],
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Running sums along a column, on two levels.

    Range partitions of the column are stored, so that their limits are fixed, and
    summed each for itself; the sums of whole partitions, one row each, then give every
    partition its start. There are ``buckets`` of them, or as many as the session
    shuffles into. ``points`` must hold one row per value of ``order`` (aggregate
    first, so that a value with many copies is one row). ``totals`` maps new column to
    summed column.
    """
    dealt = points.repartitionByRange(order) if buckets is None else points.repartitionByRange(buckets, order)
    parts = stored(dealt.withColumn("_part", F.spark_partition_id()))
    direction = F.desc if descending else F.asc
    within = Window.partitionBy("_part").orderBy(direction(order))
    running = parts.select("*", *[F.sum(source).over(within).alias(name) for name, source in totals.items()])
    earlier = Window.orderBy(direction("_part")).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part").agg(*[F.sum(source).alias(name) for name, source in totals.items()]).select(
        "_part", *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_{name}") for name in totals]
    )
    joined = running.join(F.broadcast(starts), "_part")
    return joined.withColumns({name: F.col(name) + F.col(f"_{name}") for name in totals}).drop(
        "_part", *[f"_{name}" for name in totals]
    )
