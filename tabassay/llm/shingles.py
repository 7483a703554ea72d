"""Words and word shingles of many texts at once, as numpy arrays, and how frequent they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabassay.llm.shared import map_batches, ship_package, slices

#: Words of a shingle, and the least similarity in hundredths.
WIDTH = 5
PERCENT = 75
#: Buckets of the frequency sketch: its size is the same for every table.
BUCKET_BITS = 16
#: Rows in which a task's counts of these buckets travel.
COUNT_PARTS = 16

#: The bits of a `Rarity` key that are the shingle's hash.
HASH_BITS = np.uint64(2**56 - 1)

_SPACE = bytes(x == 32 or 9 <= x < 14 for x in range(256))
_LOWER = bytes(range(256)).lower()
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit hash of 64-bit integers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, size: int) -> np.ndarray:
    """The first powers of the base or of its inverse, modulo 2^64."""
    if len(_powers[kind]) < size:
        factor = np.full(size, _BASE if kind == "up" else _INVERSE, np.uint64)
        factor[0] = 1
        _powers[kind] = np.cumprod(factor, dtype=np.uint64)
    return _powers[kind][:size]


@dataclass
class Words:
    """Words in the order of the texts: the row of their text, and a hash of their bytes."""

    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    hash: np.ndarray


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, from sums over all bytes: one step per byte and per span."""
    sums = np.zeros(len(data) + 1, np.uint64)
    letters = _LETTERS[data]
    letters *= _power("up", len(data))
    np.cumsum(letters, out=sums[1:])
    return mix((sums[end] - sums[start]) * _power("down", len(data) + 1)[start])


def words_of(texts: list[bytes], lower: bool = True) -> Words:
    """Runs of bytes other than space and \\t to \\r; A-Z count as a-z if `lower`."""
    data = b"\n".join(texts) + b"\n"
    if lower:
        data = data.translate(_LOWER)
    space = np.frombuffer(b"\1" + data.translate(_SPACE), np.uint8)
    flips = np.flatnonzero(space[1:] != space[:-1])
    start, end = flips[0::2], flips[1::2]
    ends = np.cumsum([len(x) + 1 for x in texts])
    data = np.frombuffer(data, np.uint8)
    return Words(data, parts_of(start, ends), start, span_hashes(data, start, end))


def parts_of(start: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number of `ends` at or before each start; both rise, so only the ends are looked up."""
    first = np.searchsorted(start, ends)
    return np.repeat(np.arange(len(ends) + 1), np.diff(first, prepend=0, append=len(start)))


def shingles_of(words: np.ndarray, segment: np.ndarray, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """(segment, hash) of every run of WIDTH words in one segment; `segment` never falls.

    With `short`, a segment of fewer words has one shingle of all of them.
    """
    n, width = len(words), WIDTH
    factor = np.uint64(_BASE)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = np.zeros(0, np.int64)
    hashes = np.zeros(0, np.uint64)
    if n >= width:
        value = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            value = value * factor + words[k : n - width + 1 + k]
        inside = segment[: n - width + 1] == segment[width - 1 :]
        whole, hashes = segment[: n - width + 1][inside], mix(value[inside])
    if not short:
        return whole, hashes
    first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    size = np.diff(np.append(first, n))
    few = size < width
    first, size = first[few], size[few]
    value = size.astype(np.uint64)
    for k in range(width - 1):
        has = size > k
        value[has] = value[has] * factor + words[first[has] + k]
    found = np.concatenate([whole, segment[first]])
    order = np.argsort(found, kind="stable")
    return found[order], np.concatenate([hashes, mix(mix(value))])[order]


#: Cuts a slice of texts into segments: (row of each segment, segment of each shingle, hash of each shingle).
Segments = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def text_segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every text is a segment; one with fewer words than a shingle is a shingle of its own."""
    words = words_of(texts)
    segment, hashes = shingles_of(words.hash, words.row, short=True)
    return np.arange(len(texts)), segment, hashes


def frequencies(df: DataFrame, text: str, segments: Segments) -> np.ndarray:
    """How many shingles fall into each of 2^BUCKET_BITS buckets of their hash, over all rows.

    Tasks count for themselves and Spark adds up, so the result does not depend on
    how the rows are dealt out. The driver gets the sums, as many as there are buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for _, texts in slices(batches, "text"):
            bucket = (segments(texts)[2] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            total += np.bincount(bucket, minlength=len(total))
        yield dict(zip(("part", "counts"), packed_counts(total), strict=True))

    narrow = df.selectExpr(f"`{text}` AS text")
    return summed_counts(map_batches(narrow, run, "part int, counts binary"))


def packed_counts(total: np.ndarray) -> tuple[list[int], list[bytes]]:
    """A task's counts as few rows: the numbers and the bytes of parts of the table that are not all zero."""
    parts = [(i, x) for i, x in enumerate(total.reshape(COUNT_PARTS, -1)) if x.any()]
    return [i for i, _ in parts], [x.tobytes() for _, x in parts]


def summed_counts(packed: DataFrame) -> np.ndarray:
    """The sum of the tables of all tasks, from (part, counts)."""

    def run(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in rows["counts"].to_pylist())
        return pa.table({"part": rows["part"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    ship_package(packed.sparkSession)
    rows = packed.groupBy("part").applyInArrow(run, "part int, counts binary").collect()
    table = np.zeros((COUNT_PARTS, (1 << BUCKET_BITS) // COUNT_PARTS), np.int64)
    for part, counts in rows:
        table[part] = np.frombuffer(counts, np.int64)
    return table.ravel()


class Rarity:
    """An order of shingles, rare ones first: a total order, whatever the sketch mixes up."""

    def __init__(self, table: np.ndarray) -> None:
        self.total = int(table.sum())
        usual = max(float(np.median(table)), 1.0)
        # What a bucket holds beyond the usual, less its scatter, comes from frequent shingles.
        self.excess = np.maximum(table - usual - 4 * np.sqrt(usual), 0)
        level = np.minimum(np.floor(4 * np.log2(1 + self.excess)), 127)
        self.level = level.astype(np.uint64) << np.uint64(56)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """Keys whose order is that of rarity; equal keys are equal shingles (56 bits of hash)."""
        return self.level[(hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)] | (hashes >> np.uint64(8))

    def expected(self, keys: np.ndarray) -> np.ndarray:
        """About how many others have each key."""
        return self.excess[(keys >> np.uint64(56 - BUCKET_BITS) & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64)]


def sorted_sets(segment: np.ndarray, keys: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of each segment in order, and where each of `count` segments begins."""
    order = _by_segment_and_key(segment, keys, count)
    segment, keys = segment[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (segment[1:] != segment[:-1]) | (keys[1:] != keys[:-1])
    return keys[new], np.searchsorted(segment[new], np.arange(count + 1))


def _by_segment_and_key(segment: np.ndarray, keys: np.ndarray, count: int) -> np.ndarray:
    """The order by segment, then key; of one packed number, where no two keys of a segment begin alike."""
    if count < 1 << 20:
        low = np.uint64(20)
        order = np.argsort(segment.astype(np.uint64) << np.uint64(44) | keys >> low)
        s, k = segment[order], keys[order]
        alike = (s[1:] == s[:-1]) & (k[1:] >> low == k[:-1] >> low) & (k[1:] != k[:-1])
        if not alike.any():
            return order
    return np.lexsort((keys, segment))


def digest(keys: np.ndarray, begins: np.ndarray, salt: int) -> np.ndarray:
    """64 bits that stand for each segment's set, whatever the order of its keys; 0 for an empty set."""
    sums = np.zeros(len(keys) + 1, np.uint64)
    np.cumsum(mix(keys + np.uint64(salt * _BASE % 2**64)), out=sums[1:])
    return (sums[begins[1:]] - sums[begins[:-1]]).view(np.int64)


def digests(keys: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each segment's set, in two parts; 0 for an empty set."""
    return digest(keys, begins, 1), digest(keys, begins, 2)


def prefix_length(n: int) -> int:
    """Of two sets of which one has n members, one of so many first members is shared if they are similar."""
    return n - -(-PERCENT * n // 100) + 1


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of two sorted sets at or above the threshold."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)
