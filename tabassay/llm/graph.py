"""Connected components of links between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabassay.llm.shared import discard, scratch, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b): the smallest node that can be reached.

    Every node tells its larger neighbours, then its smaller ones, about the
    smallest node it knows, until all links of a component lead to its smallest
    node. The number of rounds grows with the logarithm of the longest chain. All
    tables in between are written; a node with very many links is summed up in
    each task first, and the joins read files on both sides, so Spark can split it.
    """
    up, down = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = written(links.filter("a <> b").select(up, down).distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        with scratch() as keep:
            both = edges.union(edges.select("b", "a"))
            nearer = keep(_to_smallest(_to_smallest(both, "b > a").select(up, down), None))
        discard(edges)
        edges = nearer
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select("b", "b").distinct()
    )


def _to_smallest(links: DataFrame, which: str | None) -> DataFrame:
    """Links each b of `which` (and a itself) to the smallest node that a knows."""
    lowest = links.groupBy("a").agg(F.min("b").alias("least"))
    lowest = written(lowest.select(F.col("a").alias("_a"), F.least("a", "least").alias("least")), "least")
    told = links.filter(which) if which else links
    heard = told.join(lowest, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    if not which:
        heard = heard.union(lowest.select("_a", "least"))
    return written(heard.filter("a <> b").distinct(), "links")
