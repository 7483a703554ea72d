"""Packing by non-negative least squares over the histogram of piece lengths.

Every document becomes pieces of at most one window. The histogram of their
lengths has one bucket per length, so it is small whatever the table's size. All
combinations of up to three lengths that fill a window are listed, and repeat
counts for them are solved so that together they use up the histogram. The counts
are rounded; what is left over is packed greedily, still as counts. Every piece
then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabassay.llm.shared import map_batches, slices, written
from tabassay.llm.trie_bpe import byte_characters

WINDOW = 1024
SEPARATOR = 0
#: Fixed value: how the vocabulary's file cuts texts into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
LONG_SPACE = 10_000
#: Pieces of one length are ranked in groups of about this many rows, at most MAX_BUCKETS groups.
BUCKET_ROWS = 512
MAX_BUCKETS = 8192


@lru_cache(maxsize=2)
def vocabulary_ids(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ids of the file's byte strings, and of its special tokens.

    A plain encoder merges two neighbours if their bytes together are in the
    vocabulary, the one with the smallest id first. That is what the file says only if
    ids rise with the merges and every token comes out of merging its own bytes: then
    no other two tokens ever stand side by side that make up the same bytes. A file
    for which it does not hold is refused.
    """
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {x["content"]: x["id"] for x in content["added_tokens"]}
    ids = {t: i for t, i in content["model"]["vocab"].items() if t not in special}
    pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in content["model"]["merges"]]
    ranks = {pair: rank for rank, pair in enumerate(pairs)}
    made = [ids[a + b] for a, b in pairs]
    if any(x >= y for x, y in zip(made, made[1:], strict=False)) or any(merged(t, ranks) != [t] for t in ids):
        raise ValueError(f"the merges of {path} do not follow from its tokens")
    back = {c: b for b, c in enumerate(byte_characters())}
    return {bytes(back[c] for c in t): i for t, i in ids.items()}, special


def merged(token: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """The characters of a token, merged by the lowest rank first."""
    parts = list(token)
    while len(parts) > 1:
        rank, at = min((ranks.get(p, len(ranks)), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == len(ranks):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class ByteEncoder:
    """Ids of whole texts as bytes, with nothing remembered between them."""

    def __init__(self, path: str, ids: dict[bytes, int], special: dict[str, int]) -> None:
        import tiktoken

        self.path = path
        self.plain = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ids, special_tokens={})
        # Special tokens within a text, and runs of white space that a pattern may give up on, are for the library.
        self.odd = re.compile("|".join([*map(re.escape, special), rf"\s{{{LONG_SPACE},}}"]))

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if self.odd.search(text):
                ids = self.library.encode(text, add_special_tokens=False).ids
                yield struct.pack(f"<{len(ids)}I", *ids)
            else:
                yield self.plain.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=2)
def _encoder(path: str, shared: Broadcast) -> ByteEncoder:
    return ByteEncoder(path, *shared.value)


def pieces(
    df: DataFrame,
    vocabulary: str,
    window: int = WINDOW,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """(doc, start, length, ids_crc32, doc_tokens[, ids]): every document cut into windows and a rest.

    A document's ids end with the separator, so an empty or NULL text is one piece
    of one id. Every row is cut for itself, repeated rows too.
    """

    # Checked once; its size is that of the vocabulary.
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_ids(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = _encoder(vocabulary, shared)
        end = SEPARATOR.to_bytes(4, "little")
        for rows, texts in slices(batches, "text"):
            at, start, length, crc, tokens, ids = [], [], [], [], [], []
            for i, packed in enumerate(encoder.encode([x.decode("utf-8") for x in texts])):
                packed += end
                n = len(packed) // 4
                for first in range(0, n, window):
                    piece = packed[4 * first : 4 * (first + window)]
                    at.append(i)
                    start.append(first)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    tokens.append(n)
                    if with_ids:
                        ids.append(piece)
            columns = {
                "doc": rows.column("doc").take(pa.array(at, pa.int64())),
                "start": start,
                "length": length,
                "ids_crc32": crc,
                "doc_tokens": tokens,
            }
            yield columns | ({"ids": ids} if with_ids else {})

    kind = df.schema[doc_id].dataType.simpleString()
    narrow = df.selectExpr(f"`{doc_id}` AS doc", f"`{text}` AS text")
    schema = f"doc {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    return map_batches(narrow, run, schema + (", ids binary" if with_ids else ""))


def combinations(window: int) -> np.ndarray:
    """All rising (a, b, c) with a + b + c = window; 0 stands for no length."""
    a, b = np.meshgrid(np.arange(window + 1), np.arange(window + 1), indexing="ij")
    c = window - a - b
    fits = (a <= b) & (b <= c) & (c > 0)
    return np.stack([a[fits], b[fits], c[fits]], axis=1)


def solve_counts(rows: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 with the least squared difference between the lengths used and the histogram.

    Accelerated projected gradient steps. A combination touches three lengths, so
    both products are sums over three index columns. Position 0 is no length.
    """
    scale = max(float(histogram.max()), 1.0)
    target = histogram / scale

    def used(x: np.ndarray) -> np.ndarray:
        total = sum(np.bincount(rows[:, k], x, len(histogram)) for k in range(3))
        total[0] = 0
        return total

    def against(r: np.ndarray) -> np.ndarray:
        return r[rows[:, 0]] + r[rows[:, 1]] + r[rows[:, 2]]

    # The largest eigenvalue, by power steps, bounds the step.
    v = np.ones(len(rows))
    for _ in range(12):
        v = against(used(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (1.05 * norm)
    x = y = np.zeros(len(rows))
    pace = 1.0
    for _ in range(rounds):
        rest = used(y) - target
        rest[0] = 0
        after = np.maximum(y - step * against(rest), 0)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        if ((y - after) * (after - x)).sum() > 0:
            faster = pace = 1.0
        y = after + (pace - 1) / faster * (after - x)
        x, pace = after, faster
    return x * scale


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths) that use up the histogram exactly; `histogram[n]` counts pieces of n ids."""
    left = histogram.astype(np.int64).copy()
    found: list[tuple[int, tuple[int, ...]]] = []
    present = left > 0
    present[0] = True
    rows = combinations(window)
    rows = rows[present[rows].all(axis=1)]
    if len(rows):
        counts = solve_counts(rows, left.astype(float))
        for i in np.argsort(-counts, kind="stable"):
            lengths = [int(n) for n in rows[i] if n]
            repeats = min(round(float(counts[i])), *(int(left[n]) // lengths.count(n) for n in lengths))
            if counts[i] < 0.5:
                break
            if repeats > 0:
                found.append((repeats, tuple(lengths)))
                for n in lengths:
                    left[n] -= repeats
    return found + pack_greedily(left, window)


def pack_greedily(left: np.ndarray, window: int) -> list[tuple[int, tuple[int, ...]]]:
    """Long pieces first, each into the fullest sequence that takes it; equal sequences move as one count."""
    open_: dict[int, list[list]] = defaultdict(list)
    for n in range(window, 0, -1):
        count = int(left[n])
        while count:
            space = next((s for s in range(n, window + 1) if open_[s]), None)
            if space is None:
                each = window // n
                repeats, rest = divmod(count, each)
                if repeats:
                    open_[window - each * n].append([repeats, (n,) * each])
                if rest:
                    open_[window - rest * n].append([1, (n,) * rest])
                break
            group = open_[space].pop()
            # As many of the length as the sequences take, evenly.
            each = min(space // n, max(count // group[0], 1))
            repeats = min(group[0], count // each)
            open_[space - each * n].append([repeats, group[1] + (n,) * each])
            if group[0] > repeats:
                open_[space].append([group[0] - repeats, group[1]])
            count -= repeats * each
    return [tuple(g) for groups in open_.values() for g in groups]


def places(found: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) for every part of every combination."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for repeats, lengths in found:
        offset = 0
        for n in lengths:
            rows.append((n, taken[n], taken[n] + repeats, sequence, offset))
            taken[n] += repeats
            offset += n
        sequence += repeats
    return rows


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """`cut` (written pieces) with sequence_id and offset of every piece.

    The plan has a row per combination used: a bound that depends on the window
    alone, so it may be broadcast. An empty table gives no rows.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    histogram = np.zeros(window + 1, np.int64)
    histogram[list(counts)] = list(counts.values())
    rows = places(plan(histogram, window))
    schema = "_length long, first long, end long, sequence long, offset long"
    planned = spark.createDataFrame(rows, schema)
    buckets = min(max(int(histogram.sum()) // BUCKET_ROWS, 1), MAX_BUCKETS)
    names = cut.columns
    bucketed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc", "start"), F.lit(buckets)))
    sizes = bucketed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(
        F.col("length").alias("_l"), F.col("bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("before")
    )
    own = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc", "start")) - 1
    ranked = bucketed.withColumn("own", own).join(
        sizes, (F.col("length") == F.col("_l")) & (F.col("bucket") == F.col("_b"))
    )
    rank = F.col("own") + F.col("before")
    placed = ranked.join(
        F.broadcast(planned),
        (F.col("length") == F.col("_length")) & (rank >= F.col("first")) & (rank < F.col("end")),
    )
    return placed.select(*names, (F.col("sequence") + rank - F.col("first")).alias("sequence_id"), "offset")


def pack_documents(df: DataFrame, vocabulary: str, window: int = WINDOW, **columns: str) -> DataFrame:
    """(doc, start, length, ids_crc32, doc_tokens, sequence_id, offset): every id in exactly one piece."""
    return pack(written(pieces(df, vocabulary, window, **columns), "pieces"), window)
