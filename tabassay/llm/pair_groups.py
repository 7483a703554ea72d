"""Candidate pairs dealt into groups of bounded size for verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabassay.llm.shared import same, scratch, written

#: Members of one neighbourhood that stand together, and pairs of a group on average.
PART = 256
GROUP_PAIRS = 2_000


def _part(value: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(value), parts)


def deal(pairs: DataFrame, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """(at, mates, g) for pairs (a, b): every a with those b of its that are in group g, and every b (no mates).

    Pairs around the same first b are a neighbourhood. Its members on either side
    are cut into parts, and two parts meet in one group, so a member goes to a few
    groups and not to one per pair. No group grows with its neighbourhood.
    """
    with scratch() as keep:
        pairs = written(pairs.select("a", "b").distinct(), "pairs")
        low = written(pairs.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("low")), "low")
        homes = pairs.join(low, same(F.col("a"), F.col("_a"))).groupBy(F.col("b").alias("_b"))
        homes = written(homes.agg(F.min("low").alias("home")), "homes")
        sizes = homes.groupBy(F.col("home").alias("_home")).agg(F.count(F.lit(1)).alias("members"))
        homes = homes.join(written(sizes, "sizes"), same(F.col("home"), F.col("_home")))
        homes = written(homes.select("_b", "home", (F.floor(F.col("members") / PART) + 1).alias("parts")), "parts")
        groups = pairs.count() // group_pairs + 1
        key = F.xxhash64("home", _part(F.col("a"), F.col("parts")), _part(F.col("b"), F.col("parts")))
        met = pairs.join(homes, same(F.col("b"), F.col("_b"))).select("a", "b", F.pmod(key, F.lit(groups)).alias("g"))
        met = written(met, "dealt")
        first = met.groupBy(F.col("a").alias("at"), "g").agg(F.collect_list("b").alias("mates"))
        nobody = F.lit(None).cast(first.schema["mates"].dataType)
        second = met.select(F.col("b").alias("at"), "g").distinct().select("at", "g", nobody.alias("mates"))
        return keep(written(first.union(second), "ends"))
