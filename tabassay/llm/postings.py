"""Prefix members that different sets share, found with one shuffle of packed columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabassay.llm.shared import map_batches, ship_package
from tabassay.llm.shingles import PERCENT, mix

#: Members that a task packs together, and members of a bucket on average.
CHUNK = 250_000
BUCKET_MEMBERS = 500_000
#: Expected members of a token beyond which they are dealt to several buckets.
HOT_MEMBERS = 50_000
#: Words of 64 bits in the bitmap of a set's open members, which every row of a meeting carries.
WORDS = 4

#: Token, set, place in it (not negative) and expected number of equal tokens, of each member of some sets.
Members = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
_HOT = np.int64(-(2**63))


def _distinct(token: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Where the distinct pairs are, by token; only pairs whose token occurs again are compared by owner."""
    order = np.argsort(token)
    token = token[order]
    equal = token[1:] == token[:-1]
    again = np.concatenate([equal, [False]])
    again[1:] |= equal
    some = np.flatnonzero(again)
    rows = order[some]
    by_owner = np.lexsort((owner[rows], token[some]))
    order[some] = rows[by_owner]
    owner = owner[order]
    new = np.ones(len(order), bool)
    new[1:] = ~equal | (owner[1:] != owner[:-1])
    return order[new]


def _packed(parts: list[Members], buckets: int) -> dict:
    """A row per bucket with its distinct members as bytes; those of a hot token are marked and dealt by their set."""
    token, owner, at, expected = (np.concatenate(x) for x in zip(*parts, strict=True))
    some = _distinct(token, owner)
    token, owner, at, expected = token[some], owner[some], at[some], expected[some]
    dealt = np.ceil(expected / HOT_MEMBERS).astype(np.uint64)
    salt = mix(owner.view(np.uint64)) % np.maximum(dealt, np.uint64(1))
    at = np.where(dealt > 1, at | _HOT, at)
    bucket = (mix(token.view(np.uint64) + salt) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    cuts = list(zip(first, [*first[1:], len(order)], strict=True))
    blobs = {c: x[order] for c, x in (("tokens", token), ("sets", owner), ("places", at))}
    return {"bucket": found} | {c: [x[i:j].tobytes() for i, j in cuts] for c, x in blobs.items()}


def _shared(rows: pa.Table) -> pa.Table:
    """The members of a bucket whose token is in two different sets, or is hot."""
    token, owner, at = (
        np.concatenate([np.frombuffer(x, np.int64) for x in rows[c].to_pylist()]) for c in ("tokens", "sets", "places")
    )
    some = _distinct(token, owner)
    token, owner, at = token[some], owner[some], at[some]
    equal = token[1:] == token[:-1]
    stay = at < 0
    stay[1:] |= equal
    stay[:-1] |= equal
    return pa.table({"token": token[stay], "owner": owner[stay], "at": at[stay] & ~_HOT})


def shared_members(
    df: DataFrame, members: Callable[[Iterator[pa.RecordBatch]], Iterator[Members]], total: int
) -> DataFrame:
    """(token, owner, at): the distinct members that `members` finds in `df` whose token two sets have.

    `owner` stands for a set, so equal sets count once. Members travel in packs of
    a bucket of tokens each; there are about `total` of them, which gives the number
    of buckets. The members of a token that is expected to be hot are dealt to
    several buckets by their set and all stay, so no bucket grows with one token's sets.
    """
    buckets = int(total // BUCKET_MEMBERS) + 1
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        parts, size = [], 0
        for found in members(batches):
            parts.append(found)
            size += len(found[0])
            if size >= CHUNK:
                yield _packed(parts, buckets)
                parts, size = [], 0
        if size:
            yield _packed(parts, buckets)

    packs = map_batches(df, run, "bucket long, tokens binary, sets binary, places binary")
    return packs.groupBy("bucket").applyInArrow(_shared, "token long, owner long, at long")


def bounded(open_: DataFrame, owner: str, rest: Column) -> DataFrame:
    """`open_`, the prefix members that another set may have, with what bounds the members a set shares.

    `most` counts those after its prefix (`rest`) and its open ones; `w0` and on are a bitmap of the open ones.
    """
    own = Window.partitionBy(owner)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("token").bitwiseAND(F.lit(63)).cast("int"))
    word = F.pmod(F.shiftright("token", 6), F.lit(WORDS))
    words = {f"w{i}": F.bit_or(F.when(word == i, bit).otherwise(0)).over(own) for i in range(WORDS)}
    return open_.withColumns({"most": rest + F.count(F.lit(1)).over(own)} | words)


def enough_open() -> Column:
    """Whether two sets (l_, r_) that meet can be similar by their open members.

    All members up to the end of the prefix that ends first are known in both sets, so the
    bound holds for that set, whichever it is. A bit that only one has is a member not shared.
    """

    def most(a: str, b: str) -> Column:
        lacking = (F.col(f"{a}_w{i}").bitwiseAND(F.bitwise_not(F.col(f"{b}_w{i}"))) for i in range(WORDS))
        return reduce(lambda left, x: left - F.bit_count(x), lacking, F.col(f"{a}_most"))

    n, m = (F.shiftright(x, 32) for x in ("l_at", "r_at"))
    return (100 + PERCENT) * F.greatest(most("l", "r"), most("r", "l")) >= PERCENT * (n + m)
