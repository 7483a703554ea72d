"""Exact duplicates by naming blocks.

A text is cut into blocks of a fixed size. The distinct blocks are sorted, and a
block's place in that order is its integer name, so equal names mean equal
blocks. Adjacent names are paired, the distinct pairs are sorted and named in the
same way, and so on until one name stands for the whole text. Two texts have the
same name on the same level exactly if they are equal.

Texts whose length and 64-bit hash no other text has cannot equal another one;
they need no name and are not cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabassay.llm.shared import same, written

#: Bytes of a block. The number of rounds is the logarithm of the longest text in blocks.
BLOCK = 8192


def _named(things: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, name): the distinct rows in sorted order with their places as names.

    The names are written, so that every later job sees the same ones.
    """
    distinct = things.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    ordered = distinct.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return written(ordered.withColumn("name", F.monotonically_increasing_id()), "names")


def _with_names(things: DataFrame, columns: list[str]) -> DataFrame:
    """`things` with the name of each row's columns in their place.

    Both sides of the join come from files, so Spark can split a block that very
    many texts hold.
    """
    names = _named(things, columns).withColumnsRenamed({c: f"_{c}" for c in columns})
    equal = [F.col(c) == F.col(f"_{c}") for c in columns]
    return things.join(names, equal).drop(*columns, *(f"_{c}" for c in columns))


def _texts(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return df.select(
        F.col(doc_id).alias("doc"),
        data.alias("data"),
        F.octet_length(data).alias("bytes"),
        F.xxhash64(data).alias("hash"),
    )


def identities(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc, hash, bytes, rows, level, name) for (doc, hash, bytes, rows, data): equal names, equal texts.

    Each round halves the names of a text; texts with one name left drop out.
    """
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.col("bytes") - 1) / block), F.lit(0)).cast("int")),
        lambda i: F.substring(F.col("data"), (i * block + 1).cast("int"), F.lit(block)),
    )
    own = ["doc", "hash", "bytes", "rows"]
    cut = written(texts.select(*own, F.posexplode(blocks).alias("at", "block")), "blocks")
    rows = written(_with_names(cut, ["block"]), "round")
    done, level = None, 0
    # The number of blocks follows from the length, so texts in one round are compared in it.
    while True:
        many = F.greatest(F.ceil(F.col("bytes") / block), F.lit(1)) > 2**level
        ended = rows.filter(~many).select(*own, F.lit(level).alias("level"), "name")
        done = ended if done is None else done.unionByName(ended)
        rest = rows.filter(many)
        if rest.isEmpty():
            return done
        half = (F.col("at") % 2) == 0
        pairs = rest.groupBy(*own, F.expr("at div 2").cast("int").alias("at")).agg(
            F.max(F.when(half, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(~half, F.col("name"))), F.lit(-1)).alias("right"),
        )
        rows = written(_with_names(written(pairs, "pairs"), ["left", "right"]), "round")
        level += 1


def exact_groups(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK
) -> DataFrame:
    """(doc, keep, group_size, kept, sha256): one row per row of `df`.

    Of equal texts the row with the largest id stays; NULL counts as the empty
    text. Rows that repeat an id and a text are one document with several rows:
    they count in `group_size` and are kept or dropped together. A NULL id is
    smaller than any other. An empty table gives no rows.
    """
    texts = _texts(df, doc_id, text)
    # Fingerprints that at least two rows have; everything else is alone.
    shared = (
        texts.groupBy("hash", "bytes").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    )
    shared = written(shared.withColumnsRenamed({"hash": "_hash", "bytes": "_bytes"}), "shared")
    candidates = texts.join(
        shared, (F.col("hash") == F.col("_hash")) & (F.col("bytes") == F.col("_bytes")), "left_semi"
    )
    # One set of blocks per id and text: repeated rows are counted, not compared.
    candidates = candidates.groupBy("doc", "hash", "bytes", "data").agg(
        F.count(F.lit(1)).alias("rows")
    )
    named = written(identities(candidates, block), "identities")
    identity = ["level", "name"]
    groups = named.groupBy(*identity).agg(F.max("doc").alias("keep"), F.sum("rows").alias("group_size"))
    groups = written(groups.withColumnsRenamed({c: f"_{c}" for c in identity}), "groups")
    members = named.join(groups, [F.col(c) == F.col(f"_{c}") for c in identity]).select(
        F.col("doc").alias("_doc"),
        F.col("hash").alias("_hash"),
        F.col("bytes").alias("_bytes"),
        "keep",
        "group_size",
    )
    data = texts.withColumn("sha256", F.sha2("data", 256)).drop("data")
    joined = data.join(
        members,
        same(F.col("doc"), F.col("_doc"))
        & (F.col("hash") == F.col("_hash"))
        & (F.col("bytes") == F.col("_bytes")),
        "left",
    )
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc",
        F.when(alone, F.col("doc")).otherwise(F.col("keep")).alias("keep"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | same(F.col("doc"), F.col("keep"))).alias("kept"),
        "sha256",
    )
