"""Passages that repeat, found by merging the Burrows-Wheeler transforms of shards.

Every string of SPAN bytes is represented by the smallest hash of its GRAM-byte
parts, its anchor. Neighbouring strings mostly share the anchor at one place; such
a stretch is a run. Equal strings have equal anchors, so only runs whose anchor
occurs at least twice can hold a repeat, and runs with one anchor can be compared
apart from all others. Equal runs are one run with its first place.

Runs that share an anchor but differ go, many anchors together, into buckets of
bounded size. In a bucket the runs form shards. Each shard's suffixes are sorted
once, which gives its transform; the transforms are merged by refining an
interleave: the k-th refinement orders all suffixes by their first k * STEP bytes,
using only the last bytes and the interleave before. When SPAN bytes are reached the
suffixes that still share a block share SPAN bytes: a repeated interval.

An anchor with more different runs than a bucket should hold (the edge of a
passage that very many documents share) is spread over tasks instead: its runs are
cut into short stretches, which are grouped by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabassay.llm.shared import map_batches, same, scratch, ship_package, slices, written
from tabassay.llm.shingles import mix, span_hashes

SPAN = 100
GRAM = 20
#: Bytes of a bucket's runs and of a shard.
BUCKET_BYTES = 200_000
SHARD_BYTES = 50_000
#: Bytes that a refinement of the interleave adds.
STEP = 20
#: Different runs of one anchor beyond which they are cut into stretches of so many strings.
MOST_RUNS = 1_000
SEGMENT = 8


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    wide = data.astype(np.uint64)
    for k in (1, 2, 4):  # two, four, then eight bytes from each place on
        wide = wide[:-k] | wide[k:] << np.uint64(8 * k)
    n = len(data) - GRAM + 1
    x = wide[:n] * np.uint64(0x9E3779B97F4A7C15) + wide[8 : n + 8] * np.uint64(0xD6E8FEB86659FD93)
    return mix(x + wide[12 : n + 12] * np.uint64(0xC2B2AE3D27D4EB4F))


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def _cuts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, where each begins, and (row, start in the bytes, length, anchor) of every run.

    A run ends where the place of the smallest hash changes, so two strings of one
    run are never equal.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(x) for x in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    empty = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return data, begins, empty, empty, empty, empty
    grams = _gram_hashes(data)
    least = _smallest(grams, SPAN - GRAM + 1)
    new = np.ones(len(least) + 1, bool)
    new[1:-1] = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1])
    long = sizes >= SPAN
    new[begins[long]] = True
    ends = begins + sizes - SPAN + 1  # behind the last string of each text
    new[ends[long]] = True
    start = np.flatnonzero(new)
    length = np.diff(start)
    start = start[:-1]
    row = np.searchsorted(begins, start, "right") - 1
    # Texts without bytes begin where their successor does; the last of them owns the place.
    inside = start < ends[row]
    row, start, length = row[inside], start[inside], length[inside]
    return data, begins, row, start, length, mix(least[start]).view(np.int64)


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, anchor, hash) of every run; `length` counts the strings that start in it."""
    data, begins, row, start, length, anchor = _cuts(texts)
    hashes = span_hashes(data, start, start + length + SPAN - 1)
    return row, start - begins[row], length, anchor, hashes.view(np.int64)


def _suffix_order(rank: np.ndarray, step: int) -> np.ndarray:
    """The order of suffixes, given their ranks by the first `step` bytes; each ends with a byte of its own."""
    n = len(rank)
    order = _stable_order(rank)
    while True:
        sorted_ = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        if new[order[-1]] == n - 1:
            return order
        second = np.zeros(n, np.int64)
        second[:-step] = new[step:] + 1
        rank, step = new * (n + 1) + second, 2 * step
        order = np.argsort(rank)


def _stable_order(keys: np.ndarray) -> np.ndarray:
    """The order by key, equal keys as they stand; 16 bits at a time, which numpy sorts by counting."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    if len(keys) and keys.max() >> 16:
        order = order[_stable_order(keys[order] >> 16)]
    return order


def _grams(letters: np.ndarray, width: int, own: np.ndarray, bits: int) -> np.ndarray:
    """A number for the `width` letters from each place on, in their order; 0 ends a string.

    One that meets its string's end holds the string's number `own` too, in `bits` bits, so no other equals it.
    """
    out, open_ = letters.copy(), letters > 0
    for k in range(1, width):
        out <<= 9
        out[:-k] |= np.where(open_[:-k], letters[k:], 0)
        open_[:-k] &= letters[k:] > 0
    return out << bits | np.where(open_, 0, own)


def _ranks(letters: np.ndarray, own: np.ndarray, bits: int, widths: set[int]) -> dict[int, np.ndarray]:
    """The rank of the letters from each place on, for each number of letters: those of halves give the whole's."""
    known: dict[int, np.ndarray] = {}

    def rank(width: int) -> np.ndarray:
        if width not in known:
            if 9 * width + bits <= 63:
                key = _grams(letters, width, own, bits)
            else:
                first, second = rank(width - width // 2), rank(width // 2)
                # Letters that meet their string's end have a rank of their own, whatever comes second.
                key = first * len(letters)
                key[: width // 2 - width] += second[width - width // 2 :]
            known[width] = np.unique(key, return_inverse=True)[1]
        return known[width]

    return {w: rank(w) for w in widths}


def merged_blocks(shards: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, block) of all suffixes in merged order; one block has equal first `depth` bytes.

    `string` counts over all shards. A suffix shorter than `depth` is a block of
    its own. Each refinement adds the `STEP` last bytes before all suffixes, or what is left.
    """
    strings = [x for shard in shards for x in shard]
    widths = [STEP] * (depth // STEP) + [depth % STEP] * (depth % STEP > 0)
    sizes = np.array([len(x) + 1 for x in strings], np.int64)
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(strings)), sizes)
    letters = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
    letters[begins + sizes - 1] = 0
    ranks = _ranks(letters, owner + 1, (len(strings) + 1).bit_length(), set(widths))
    orders, rows = [], 0
    for shard in shards:
        size = sum(len(x) + 1 for x in shard)
        orders.append(rows + _suffix_order(ranks[widths[0]][rows : rows + size], widths[0]))
        rows += size
    order = np.concatenate(orders)
    place = np.empty(rows, np.int32)
    place[order] = np.arange(rows, dtype=np.int32)
    string = owner[order]
    offset = order - begins[string]
    # The interleave: which shard's next row stands at each place, by the number of that row.
    interleave = np.arange(rows, dtype=np.int32)
    block = np.zeros(rows, np.int32)
    new = np.ones(rows, bool)
    before = None
    for w in widths:
        if w != before:
            # Where the suffix longer by w bytes stands in its shard's order. Before a string's
            # beginning come its last suffixes: their ranks are like no other, so any of them will do.
            step = place[begins[string] + (offset - w) % sizes[string]]
            gram = ranks[w].astype(np.uint32)[order][step]
            # Every refinement sorts the same ranks.
            heads = np.sort(gram)
            heads = heads[1:] != heads[:-1]
            before = w
        found = _stable_order(gram[interleave])
        interleave, old = step[interleave[found]], block[found]
        new[1:] = heads | (old[1:] != old[:-1])
        block = np.cumsum(new, dtype=np.int32)
        if block[-1] == rows:
            break
    return string[interleave], offset[interleave], block


def later_starts(strings: list[bytes], lengths: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of the strings of SPAN bytes that an earlier run holds too.

    `rank` orders the runs by their places, `lengths` says how many starts of each count.
    """
    shards, size = [[]], 0
    for x in strings:
        if size > SHARD_BYTES:
            shards.append([])
            size = 0
        shards[-1].append(x)
        size += len(x) + 1
    string, offset, block = merged_blocks(shards, SPAN)
    counts = offset < lengths[string]
    string, offset, block = string[counts], offset[counts], block[counts]
    # Suffixes of a block are neighbours; its earliest place stays.
    first = np.concatenate([[True], block[1:] != block[:-1]])
    group = np.cumsum(first) - 1
    earliest = np.full(group[-1] + 1, len(rank), np.int64) if len(group) else np.zeros(0, np.int64)
    np.minimum.at(earliest, group, rank[string])
    late = rank[string] > earliest[group]
    return string[late], offset[late]


def _stretches(string: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, from, to) of the bytes covered by neighbouring starts."""
    order = np.lexsort((offset, string))
    string, offset = string[order], offset[order]
    new = np.ones(len(string), bool)
    new[1:] = (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(string)) - 1
    return string[first], offset[first], offset[last[: len(first)]] + SPAN


def _anchors(df: DataFrame) -> DataFrame:
    """Anchors that at least two runs have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for _, texts in slices(batches, "text"):
            yield {"_anchor": _cuts(texts)[5]}

    counted = map_batches(df.select("text"), run, "_anchor long").groupBy("_anchor")
    return written(counted.agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("_anchor"), "anchors")


def _runs(df: DataFrame) -> DataFrame:
    """(doc, at, anchor, hash): `at` packs start and length of a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for rows, texts in slices(batches, "text"):
            row, start, length, anchor, hashes = runs_of(texts)
            yield {
                "doc": rows.column("doc").take(pa.array(row, pa.int64())),
                "at": start * 128 + length,
                "anchor": anchor,
                "hash": hashes,
            }

    kind = df.schema["doc"].dataType.simpleString()
    return map_batches(df, run, f"doc {kind}, at long, anchor long, hash long")


def _texts(df: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc, at, anchor, hash, bytes) of the runs wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for rows, texts in slices(batches, "text"):
            at, anchor, hashes = rows.column("runs").flatten().flatten()
            row = np.repeat(np.arange(len(texts)), pc.list_value_length(rows.column("runs")).to_numpy())
            start, length = np.divmod(at.to_numpy(), 128)
            size = np.array([len(x) for x in texts], np.int64)
            begin = np.cumsum(size) - size
            end = np.minimum(start + length + SPAN - 1, size[row])
            start = np.minimum(start, end)
            data = np.frombuffer(b"".join(texts), np.uint8)
            own = span_hashes(data, begin[row] + start, begin[row] + end).view(np.int64)
            # Rows may share an id: the run belongs to the text that has it.
            good = np.flatnonzero((end > start) & (own == hashes.to_numpy()))
            cut = [texts[i][x:y] for i, x, y in zip(row[good].tolist(), start[good].tolist(), end[good].tolist())]
            doc, good = pa.array(row[good], pa.int64()), pa.array(good, pa.int64())
            found = {"at": at, "anchor": anchor, "hash": hashes}
            yield {"doc": rows.column("doc").take(doc), "bytes": cut} | {c: x.take(good) for c, x in found.items()}

    lists = runs.groupBy("doc").agg(F.collect_list(F.struct("at", "anchor", "hash")).alias("runs"))
    kind = df.schema["doc"].dataType.simpleString()
    joined = df.join(lists.withColumnRenamed("doc", "_doc"), same(F.col("doc"), F.col("_doc"))).drop("_doc")
    return map_batches(joined, run, f"doc {kind}, at long, anchor long, hash long, bytes binary")


def _by_transforms(texts: DataFrame, buckets: int) -> DataFrame:
    """(doc, first, end): bytes of the runs that an earlier run repeats, bucket by bucket."""
    ship_package(texts.sparkSession)
    kind = texts.schema["doc"].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        places = list(zip(rows["doc"].to_pylist(), rows["at"].to_pylist(), strict=True))
        # Rows that share an id bring the same run again: it has one place.
        order = {p: i for i, p in enumerate(sorted(set(places), key=lambda p: (p[0] is not None, p)))}
        rank = np.array([order[p] for p in places], np.int64)
        at = rows["at"].to_numpy()
        string, offset = later_starts(rows["bytes"].to_pylist(), at % 128, rank)
        string, first, end = _stretches(string, offset)
        start = at[string] // 128
        return pa.table(
            {
                "doc": rows["doc"].combine_chunks().take(pa.array(string, pa.int64())),
                "first": pa.array(start + first, pa.int64()),
                "end": pa.array(start + end, pa.int64()),
            }
        )

    bucketed = texts.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    return bucketed.groupBy("bucket").applyInArrow(run, f"doc {kind}, first long, end long")


def _segments(part: bytes, length: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(offset, starts, core, text) of a run's stretches of up to SEGMENT starts.

    Stretches are counted from the anchor, so equal strings of two runs fall into
    the same one. `core` is what all strings of a whole stretch have in common,
    whichever of them the run holds, with its place.
    """
    grams = _gram_hashes(np.frombuffer(part, np.uint8))
    anchor = int(np.argmin(grams[: SPAN - GRAM + 1]))
    offset = 0
    while offset < length:
        stretch = (anchor - offset) // SEGMENT
        last = min(anchor - stretch * SEGMENT, length - 1)
        core = part[anchor - stretch * SEGMENT : anchor - stretch * SEGMENT + SPAN - SEGMENT + 1]
        text = part[offset : last + SPAN]
        yield offset, last - offset + 1, b"%d:" % stretch + core, b"%d:" % (anchor - offset) + text
        offset = last + 1


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _by_segments(texts: DataFrame) -> DataFrame:
    """(doc, first, end) for anchors with very many runs.

    Their runs are cut into short stretches. Equal stretches are one; only different
    stretches with the same core are looked at string by string. All groups are
    hashes summed up in each task first, so none has to fit a task.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for rows, parts in slices(batches, "bytes"):
            row, start, starts, core, own, data = [], [], [], [], [], []
            for i, (part, at) in enumerate(zip(parts, rows.column("at").to_pylist(), strict=True)):
                for offset, n, inner, text in _segments(part, at % 128):
                    row.append(i)
                    start.append(at // 128 + offset)
                    starts.append(n)
                    core.append(_digest(inner))
                    own.append(_digest(text))
                    data.append(part[offset : offset + n + SPAN - 1])
            doc = rows.column("doc").take(pa.array(row, pa.int64()))
            yield {"doc": doc, "start": start, "starts": starts, "core": core, "own": own, "bytes": data}

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for rows, parts in slices(batches, "bytes"):
            found = [(i, k, _digest(x[k : k + SPAN])) for i, x in enumerate(parts) for k in range(len(x) - SPAN + 1)]
            row = np.array([x[0] for x in found], np.int64)
            start = rows.column("start").to_numpy()[row] + np.array([x[1] for x in found], np.int64)
            doc = rows.column("doc").take(pa.array(row, pa.int64()))
            yield {"doc": doc, "start": start, "key": [x[2] for x in found]}

    kind = texts.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, start long, starts long, core binary, own binary, bytes binary"
    cuts = written(map_batches(texts, cut, schema), "segments")
    place = F.struct("doc", "start")
    same_text = [F.first(c).alias(c) for c in ("starts", "core", "bytes")]
    firsts = cuts.groupBy("own").agg(F.min(place).alias("x"), F.count(F.lit(1)).alias("c"), *same_text)
    firsts = written(firsts, "firsts")
    repeated = written(firsts.filter("c > 1").select(F.col("own").alias("_own"), "x"), "repeated")
    copies = cuts.join(repeated, F.col("own") == F.col("_own")).filter(~same(place, F.col("x")))
    spans = copies.select("doc", F.col("start").alias("first"), (F.col("start") + F.col("starts") + SPAN - 1).alias("end"))
    several = firsts.groupBy(F.col("core").alias("_core")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    open_ = firsts.join(written(several.select("_core"), "several"), F.col("core") == F.col("_core"))
    single = map_batches(open_.select("x.doc", "x.start", "bytes"), strings, f"doc {kind}, start long, key binary")
    single = written(single, "strings")
    found = single.groupBy("key").agg(F.min(place).alias("x"), F.count(F.lit(1)).alias("c"))
    found = written(found.filter("c > 1").select(F.col("key").alias("_key"), "x"), "found")
    late = single.join(found, F.col("key") == F.col("_key")).filter(~same(place, F.col("x")))
    return spans.union(late.select("doc", "start", F.col("start") + SPAN))


def repeated_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, first, end): stretches of bytes that strings of SPAN bytes cover which start earlier too.

    Earlier means a smaller id, or the same id and an earlier start. Stretches may
    overlap.
    """
    narrow = df.selectExpr(f"`{doc_id}` AS doc", f"`{text}` AS text")
    anchors = _anchors(narrow)
    runs = _runs(narrow).join(anchors, F.col("anchor") == F.col("_anchor")).drop("_anchor")
    runs = written(runs, "runs")
    place = F.struct("doc", "at")
    firsts = runs.groupBy("anchor", "hash").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("c"))
    firsts = written(firsts, "firsts")
    repeated = written(
        firsts.filter("c > 1").select(F.col("anchor").alias("_a"), F.col("hash").alias("_h"), "place"), "repeated"
    )
    # An equal run stands earlier: all of it goes.
    copies = runs.join(repeated, (F.col("anchor") == F.col("_a")) & (F.col("hash") == F.col("_h")))
    start, length = F.floor(F.col("at") / 128), F.col("at") % 128
    copies = copies.filter(~same(place, F.col("place"))).select(
        "doc", start.alias("first"), (start + length + SPAN - 1).alias("end")
    )
    kinds = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("runs")).filter("runs > 1")
    kinds = written(kinds.withColumnRenamed("anchor", "_a"), "kinds")
    differing = firsts.join(kinds, F.col("anchor") == F.col("_a")).select("place.doc", "place.at", "anchor", "hash", "runs")
    differing = written(differing, "differing")
    many = kinds.filter(F.col("runs") > MOST_RUNS).select("_a")
    texts = written(_texts(narrow, differing.drop("runs")), "texts")
    many = written(many, "many")
    few = texts.join(many, F.col("anchor") == F.col("_a"), "left_anti")
    rest = texts.join(many, F.col("anchor") == F.col("_a"), "left_semi")
    size = texts.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    merged = _by_transforms(few, size // BUCKET_BYTES + 1)
    spans = copies.unionByName(merged)
    if not many.isEmpty():
        spans = spans.unionByName(_by_segments(rest))
    return written(spans, "spans")


def _sums(flags: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many flags each stretch of `size` from `begin` has set."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[begin + size] - total[begin]


def _cut(data: bytes, size: np.ndarray) -> list[bytes]:
    """The bytes in pieces of these sizes."""
    ends = np.cumsum(size).tolist()
    return [data[x:y] for x, y in zip([0, *ends[:-1]], ends)]


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc, kept, text, n_bytes, n_removed, n_spans): one row per row of `df`, with the columns in `carry`.

    `kept` has the remaining bytes. `text` has the same as characters: one goes
    only if all its bytes do. NULL counts as empty. Texts shorter than SPAN bytes
    keep everything. Rows that share an id are one document: equal places of equal
    texts do not repeat each other. A NULL id comes before all others. An empty
    table gives no rows.
    """
    inner = {f"c{i}": c for i, c in enumerate(carry)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for rows, texts in slices(batches, "text"):
            known = rows.column("text").is_valid().to_pylist()
            size = np.array([len(x) for x in texts], np.int64)
            begin = np.cumsum(size) - size
            data = np.frombuffer(b"".join(texts), np.uint8)
            first, end = (x.to_numpy() for x in rows.column("spans").flatten().flatten())
            row = np.repeat(np.arange(len(texts)), pc.list_value_length(rows.column("spans")).fill_null(0).to_numpy())
            # Each text's spans end with it, so the sums of all texts at once are those of each.
            gone = np.bincount(begin[row] + np.minimum(first, size[row]), minlength=len(data) + 1)
            gone -= np.bincount(begin[row] + np.minimum(end, size[row]), minlength=len(data) + 1)
            out = np.cumsum(gone)[:-1] > 0
            lead = np.flatnonzero((data & 0xC0) != 0x80)
            whole = np.minimum.reduceat(out, lead) if len(lead) else out
            letters = np.repeat(whole, np.diff(np.append(lead, len(data)))) if len(lead) else out
            heads = out.copy()
            heads[1:] &= ~out[:-1]
            heads[begin[size > 0]] = out[begin[size > 0]]
            removed, spans, less = (_sums(x, begin, size) for x in (out, heads, letters))
            kept = _cut(data[~out].tobytes(), size - removed)
            strings = [x.decode("utf-8") if has else None for x, has in zip(_cut(data[~letters].tobytes(), size - less), known)]
            yield {c: rows.column(c) for c in ("doc", *inner)} | {
                "kept": kept,
                "text": strings,
                "n_bytes": size,
                "n_removed": removed,
                "n_spans": spans,
            }

    with scratch() as keep:
        spans = keep(repeated_spans(df, doc_id, text))
    lists = spans.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    columns = {"doc": doc_id, "text": text, **inner}
    named = df.select(*(F.col(f"`{c}`").alias(n) for n, c in columns.items()))
    joined = named.join(lists, same(F.col("doc"), F.col("_doc")), "left").drop("_doc")
    kinds = {n: df.schema[c].dataType.simpleString() for n, c in columns.items()}
    schema = ", ".join(f"{n} {kinds[n]}" for n in ("doc", *inner))
    out = map_batches(joined, run, schema + ", kept binary, text string, n_bytes long, n_removed long, n_spans long")
    return out.withColumnsRenamed(inner)
