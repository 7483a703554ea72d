"""Near-duplicate documents by an exact similarity join with adaptive prefixes.

Each document is the set of its word shingles, rare shingles first. Two similar
sets share at least k of the first p + k - 1 members of each, where p follows from
the size and the threshold. k = 1 is the usual prefix; a longer prefix costs more
rows but needs k shared members before a pair is looked at. Each document takes
the k that promises the least work, given how frequent its first shingles are;
a pair is held to the smaller k of its two documents.

Links are wanted up to reachability, so a group of n copies needs no n * n pairs:
equal sets become one class, in a few turns every class is compared with one leader
that shares most of its prefix and is in another component, and then all pairs left in
different components are looked at. No pair that could join two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabassay.llm.graph import components
from tabassay.llm.pair_groups import deal
from tabassay.llm.postings import Members, bounded, enough_open, shared_members
from tabassay.llm.shared import (
    discard,
    map_batches,
    perhaps_in,
    runs_of_bytes,
    scratch,
    ship_package,
    slices,
    written,
)
from tabassay.llm.shingles import (
    PERCENT,
    Rarity,
    digest,
    digests,
    frequencies,
    prefix_length,
    similar,
    sorted_sets,
    text_segments,
)

#: The largest number of shared prefix members that is considered.
MOST_SHARED = 8
#: What verifying a candidate costs per member of the set, in rows of the prefix table.
VERIFY_COST = 1 / 16
#: Times every document is compared with a leader of its prefix before the pairs left are met token by token.
LEADER_TURNS = 4
#: Pairs for each posting up to which the pairs left are met at once.
MEETINGS = 2
#: Pairs verified together on average: their whole texts are in one task's memory.
GROUP_PAIRS = 500


def choose_shared(expected: np.ndarray, size: int) -> int:
    """The k whose prefix rows and expected candidates cost least.

    At most (postings met) / k sets share k members, which bounds the candidates.
    """
    first = prefix_length(size)
    most = min(MOST_SHARED, size - first + 1)
    met = np.cumsum(expected)[first - 1 : first - 1 + most]
    k = np.arange(1, most + 1)
    return int(np.argmin(first + k - 1 + VERIFY_COST * size * met / k)) + 1


def _narrow(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.selectExpr(f"`{doc_id}` AS doc", f"`{text}` AS text")


def bitmaps(segment: np.ndarray, hashes: np.ndarray, size: np.ndarray) -> list[bytes]:
    """A bit for the hash of each member of a segment, among 2 to 4 times as many bits as it has members."""
    width = 1 << np.ceil(np.log2(np.maximum(2 * size, 64))).astype(np.int64)
    end = np.cumsum(width)
    flags = np.zeros(int(width.sum()), bool)
    flags[(end - width)[segment] + (hashes & (width[segment] - 1).astype(np.uint64)).astype(np.int64)] = True
    packed = np.packbits(flags, bitorder="little").tobytes()
    return [packed[x:y] for x, y in zip((end - width) // 8, end // 8, strict=True)]


def may_be_similar(a: bytes, n: int, b: bytes, m: int) -> bool:
    """False only for sets that cannot be similar, by their bitmaps and sizes.

    A bit that one has and the other lacks is at least one member that is not shared.
    """
    if len(a) > len(b):
        a, n, b, m = b, m, a, n
    width, x, y = 8 * len(a), int.from_bytes(a, "little"), int.from_bytes(b, "little")
    while y >> width:  # the larger one, as it would be with fewer bits
        y = y >> width | y & (1 << width) - 1
    most = min(n - (x & ~y).bit_count(), m - (y & ~x).bit_count())
    return (100 + PERCENT) * most >= PERCENT * (n + m)


def signatures(df: DataFrame) -> DataFrame:
    """(doc, n, s1, s2, bits): set size, 128 bits that stand for the set, and its bitmap, from (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for rows, texts in slices(batches, "text"):
            _, segment, hashes = text_segments(texts)
            keys, begins = sorted_sets(segment, hashes, len(texts))
            s1, s2 = digests(keys, begins)
            n = np.diff(begins)
            yield {"doc": rows.column("doc"), "n": n, "s1": s1, "s2": s2, "bits": bitmaps(segment, hashes, n)}

    kind = df.schema["doc"].dataType.simpleString()
    return map_batches(df, run, f"doc {kind}, n long, s1 long, s2 long, bits binary")


def shared_prefixes(df: DataFrame, rarity: Rarity) -> DataFrame:
    """(token, owner, at): prefix members that different sets share; `at` packs set size, place and k.

    `owner` is the first half of the set's digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[Members]:
        for _, texts in slices(batches, "text"):
            _, segment, hashes = text_segments(texts)
            keys, begins = sorted_sets(segment, rarity.keys(hashes), len(texts))
            expected = rarity.expected(keys)
            size = np.diff(begins)
            k = np.zeros(len(texts), np.int64)
            for i in np.flatnonzero(size):
                k[i] = choose_shared(expected[begins[i] : begins[i + 1]], int(size[i]))
            length = np.where(size > 0, size - -(-PERCENT * size // 100) + k, 0)
            row = np.repeat(np.arange(len(texts)), length)
            place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
            member = begins[:-1][row] + place
            # The digest is that of the hashes themselves, as in `signatures`.
            owner = digest(*sorted_sets(segment, hashes, len(texts)), 1)[row]
            yield keys[member].view(np.int64), owner, size[row] << 32 | place << 4 | k[row], expected[member]

    return shared_members(df, run, rarity.total * (100 - PERCENT) // 100)


def _possible(a: str, b: str) -> Column:
    """Whether two sets that share this prefix member can be similar, by size, place and prefix."""
    n, m = (F.shiftright(x, 32) for x in (a, b))
    i, j = (F.shiftright(F.col(x).bitwiseAND(F.lit(2**32 - 1)), 4) for x in (a, b))
    k = F.least(*(F.col(x).bitwiseAND(F.lit(15)) for x in (a, b)))
    # At most so many members are shared before this one and after it.
    most = F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1)
    within = lambda size, at: 100 * (at - k + 1) <= (100 - PERCENT) * size
    return (
        (100 * F.least(n, m) >= PERCENT * F.greatest(n, m))
        & ((100 + PERCENT) * most >= PERCENT * (n + m))
        & within(n, i)
        & within(m, j)
    )


def _enough_shared(met: DataFrame) -> DataFrame:
    """(a, b): pairs that share as many prefix members as similar sets must.

    Of the set whose prefix ends first, all members up to there are known in both
    sets, so no more than those found and the rest of that set can be shared.
    """
    k = F.least(*(F.col(c).bitwiseAND(F.lit(15)) for c in ("l_at", "r_at"))).alias("k")
    n, m = F.shiftright("l_at", 32).alias("n"), F.shiftright("r_at", 32).alias("m")
    pairs = met.groupBy(F.col("l_doc").alias("a"), F.col("r_doc").alias("b"), n, m, k)
    counted = pairs.agg(F.count(F.lit(1)).alias("shared"))
    rest = lambda size: F.ceil(PERCENT * size / 100) - F.col("k")
    needed = F.ceil(PERCENT * (F.col("n") + F.col("m")) / (100 + PERCENT))
    least = needed - F.greatest(rest(F.col("n")), rest(F.col("m")))
    return counted.filter(F.col("shared") >= F.greatest("k", least)).select("a", "b").distinct()


def _unlike_left_out(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (a, b) but for those whose bitmaps show that no sets of theirs are similar."""
    kind = signed.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for rows in batches:
            sets = zip(*(rows.column(c).to_pylist() for c in ("x", "n", "y", "m")), strict=True)
            some = pa.array([i for i, x in enumerate(sets) if may_be_similar(*x)], pa.int64())
            yield {c: rows.column(c).take(some) for c in "ab"}

    ends = pairs.select("a").union(pairs.select("b"))
    sets = perhaps_in(signed.select("doc", "n", "bits"), [F.col("doc")], ends, [F.col("a")])
    left = pairs.join(sets.toDF("_a", "n", "x"), F.col("a") == F.col("_a")).drop("_a")
    both = left.join(sets.toDF("_b", "m", "y"), F.col("b") == F.col("_b")).drop("_b")
    return written(map_batches(both, run, f"a {kind}, b {kind}").distinct(), "like")


def _linked(docs: DataFrame, pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar; only texts of pairs that their bitmaps do not rule out are shuffled."""
    ship_package(docs.sparkSession)
    kind = docs.schema["doc"].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        sets: list[np.ndarray] = []
        for texts in runs_of_bytes([x or b"" for x in rows["text"].cast(pa.binary()).to_pylist()]):
            _, segment, hashes = text_segments(texts)
            keys, begins = sorted_sets(segment, hashes, len(texts))
            sets += [keys[x:y] for x, y in zip(begins[:-1], begins[1:], strict=True)]
        docs, mates = rows["doc"].to_pylist(), rows["mates"].to_pylist()
        # Rows that share an id may bring several texts of one document.
        known: dict[object, list[np.ndarray]] = {}
        for doc, own, mate in zip(docs, sets, mates, strict=True):
            if mate is None:
                known.setdefault(doc, []).append(own)
        good = [
            (doc, m)
            for doc, own, mate in zip(docs, sets, mates, strict=True)
            for m in mate or ()
            if any(similar(own, x) for x in known.get(m, ()))
        ]
        kinds = rows["doc"].type
        return pa.table({"a": pa.array([x for x, _ in good], kinds), "b": pa.array([y for _, y in good], kinds)})

    with scratch() as keep:
        ends = deal(_unlike_left_out(pairs, signed), GROUP_PAIRS)
        some = perhaps_in(docs, [F.col("doc")], ends, [F.col("at")])
        rows = some.join(ends, F.col("doc") == F.col("at")).drop("at")
        return keep(written(rows.groupBy("g").applyInArrow(run, f"a {kind}, b {kind}").distinct(), "linked"))


def similar_components(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """(n, s1, s2, component) for (doc, text): a row per class of equal sets that are not empty."""
    some = signed.filter("n > 0")
    classes = some.groupBy("n", "s1", "s2").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("c"))
    classes = written(classes, "classes")
    several = classes.filter("c > 1").select(*(F.col(c).alias(f"_{c}") for c in ("n", "s1", "s2")), "first")
    # Equal sets are linked to the first document that has them; only that one is compared further.
    copies = some.join(
        several,
        (F.col("n") == F.col("_n")) & (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")),
    )
    copies = written(copies.filter("doc <> first").select(F.col("doc").alias("a"), F.col("first").alias("b")), "copies")
    rarity = Rarity(frequencies(docs, "text", text_segments))
    members = written(shared_prefixes(docs, rarity), "members")
    # A set's first document stands for it from here on.
    postings = members.join(classes.select("s1", "first"), F.col("owner") == F.col("s1"))
    postings = written(postings.select("token", F.col("first").alias("doc"), "at"), "postings")
    discard(members)
    rows = postings.count()
    links, known = copies, None
    for turn in range(LEADER_TURNS):
        open_ = written(_open(postings, known), "open")
        if turn and _meetings(open_) <= MEETINGS * rows:
            break
        best = written(_best_leaders(open_, turn), "best")
        if best.isEmpty():
            break
        found = _linked(docs, best, some)
        links = links.union(found)
        if turn and 100 * found.count() < best.count():  # the documents that meet are not similar
            break
        known = written(components(links), "components")
    # What is left: pairs of different components, by the links counted so far.
    rest = F.ceil(PERCENT * F.shiftright("at", 32) / 100) - F.col("at").bitwiseAND(F.lit(15))
    open_ = written(bounded(_open(postings, known), "doc", rest), "open")
    discard(postings)
    l, r = (open_.select(*(F.col(c).alias(f"{s}_{c}") for c in open_.columns)) for s in "lr")
    crossing = l.join(
        r,
        (F.col("l_token") == F.col("r_token"))
        & (F.col("l_doc") > F.col("r_doc"))
        & (F.col("l_component") != F.col("r_component"))
        & _possible("l_at", "r_at")
        & enough_open(),
    )
    more = _linked(docs, written(_enough_shared(crossing), "pairs"), some)
    final = written(components(links.union(more)), "components")
    found = classes.join(final, F.col("first") == F.col("node"), "left")
    return written(
        found.select("n", "s1", "s2", F.coalesce("component", "first").alias("component")), "found"
    )


def _open(postings: DataFrame, known: DataFrame | None) -> DataFrame:
    """(token, doc, at, component): postings of tokens that still stand in several components."""
    if known is None:
        return postings.withColumn("component", F.col("doc"))
    placed = postings.join(known, F.col("doc") == F.col("node"), "left")
    placed = written(
        placed.select("token", "doc", "at", F.coalesce("component", "doc").alias("component")), "placed"
    )
    ends = placed.groupBy(F.col("token").alias("_token")).agg(F.min("component").alias("x"), F.max("component").alias("y"))
    mixed = written(ends.filter("x <> y").select("_token"), "mixed")
    return placed.join(mixed, F.col("token") == F.col("_token"), "left_semi")


def _meetings(open_: DataFrame) -> int:
    """How many pairs of postings have the same token."""
    counts = open_.groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    return int(counts.agg(F.sum(F.col("c") * (F.col("c") - 1) / 2)).first()[0] or 0)


def _best_leaders(open_: DataFrame, turn: int) -> DataFrame:
    """(a, b): every document with the one that leads most of its open prefix members, if that is in another component.

    In the first turn the smallest document leads a token, later another in an order
    by hash, the same for all tokens.
    """
    rank = F.xxhash64("doc", F.lit(turn)) if turn else F.lit(0).cast("long")
    leads = open_.groupBy(F.col("token").alias("_token")).agg(
        F.min(F.struct(rank.alias("rank"), "doc", "at", "component")).alias("x")
    )
    met = open_.join(leads, F.col("token") == F.col("_token")).filter(F.col("component") != F.col("x.component"))
    met = met.select(F.col("doc").alias("a"), "at", F.col("x.doc").alias("b"), F.col("x.at").alias("lead_at"))
    counted = met.filter(_possible("at", "lead_at")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    return counted.groupBy("a").agg(F.max(F.struct("shared", "b")).alias("x")).select("a", "x.b")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_shingles, component): one row per row of `df`.

    A-Z count as a-z. A text with fewer words than a shingle has one shingle of
    all its words. Texts without words, NULL included, are linked with nothing and
    are their own component. Rows that share an id are one document, with the
    links of all its texts. A row without an id is linked with nothing and has no
    component. An empty table gives no rows.
    """
    docs = _narrow(df, doc_id, text)
    with scratch() as keep:
        signed = keep(written(signatures(docs), "signatures"))
        found = keep(similar_components(docs.filter("doc IS NOT NULL"), signed.filter("doc IS NOT NULL")))
    joined = signed.alias("d").join(
        found.alias("f"),
        (F.col("d.n") == F.col("f.n")) & (F.col("d.s1") == F.col("f.s1")) & (F.col("d.s2") == F.col("f.s2"))
        & F.col("d.doc").isNotNull(),
        "left",
    )
    return joined.select(
        "d.doc", F.col("d.n").alias("n_shingles"), F.coalesce("f.component", "d.doc").alias("component")
    )
