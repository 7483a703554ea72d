"""Pseudo-random columns that depend on row keys only.

``rand(seed)`` changes with the partitioning and with task retries. These do
not: the same key, seed and salt give the same number on every run, which keeps
splits, shocks and resamples stable when an executor is lost half way.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

_DIGITS = 13  # hex digits, 52 bits: exact in a double


def key_text(keys: Sequence[Column | str]) -> Column:
    """The key columns as one string that no other key gives.

    Each part is preceded by its length, and NULL is written as ``-``, so neither
    separators inside a value nor NULLs can make two keys look alike.
    """
    parts = [col(k) if isinstance(k, str) else k for k in keys]
    return F.concat(*[cell_text(p) for p in parts])


def cell_text(cell: Column) -> Column:
    """A cell with its length in front, so that cells can be joined without a separator."""
    text = cell.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def uniform(keys: Sequence[Column | str], seed: int = 42, salt: str = "") -> Column:
    """Uniform in [0, 1) from md5 of key, seed and salt."""
    text = F.concat(key_text(keys), F.lit(f"|{seed}|{salt}"))
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("double") / F.lit(
        float(16**_DIGITS)
    )


def normal(keys: Sequence[Column | str], seed: int = 42, salt: str = "") -> Column:
    """Standard normal (Box-Muller) from two uniforms."""
    u1 = F.lit(1.0) - uniform(keys, seed, salt + "#r")
    u2 = uniform(keys, seed, salt + "#a")
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def poisson_steps() -> list[float]:
    """Cumulative probabilities of Poisson(1), up to the last one below 1 - 2**-52."""
    steps, term, total, k = [], math.exp(-1.0), 0.0, 0
    while term > 2.0**-52:
        total += term
        steps.append(total)
        k += 1
        term /= k
    return steps


def poisson1(u: Column) -> Column:
    """Poisson(1) draw for a uniform column: how many cumulative steps lie at or below it."""

    def steps(x: Column) -> Column:
        draw = F.lit(len(poisson_steps()))
        for count, step in reversed(list(enumerate(poisson_steps()))):
            draw = F.when(x < F.lit(step), F.lit(count)).otherwise(draw)
        return draw

    # Through an array of one, so that the hash is computed once and not per step.
    return F.transform(F.array(u), steps)[0]
