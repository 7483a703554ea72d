"""Near-duplicate lines by an exact set-similarity join; the earliest of similar lines stays.

The tokens of a line are its word shingles, in an order of rarity that holds for
the whole table. Two similar sets share one of the first members of both (prefix
filter); the sizes and the places of that member rule out most other pairs, and
the rest is verified. A line goes if it is similar to an earlier one, whether that
one stays or not. Lines with fewer words than a shingle have no token, so they
match nothing; with `short`, all their words are one token, so they match their
exact repeats.

Only whether an earlier line exists is asked, so equal lines become one, every
line is first compared with the earliest line that shares its prefix, and only
those still unmatched are compared with all earlier lines they share a member with.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabassay.llm.pair_groups import deal
from tabassay.llm.postings import WORDS, Members, bounded, enough_open, shared_members
from tabassay.llm.shared import discard, map_batches, parted, perhaps_in, same, scratch, ship_package, slices, written
from tabassay.llm.shingles import (
    BUCKET_BITS,
    HASH_BITS,
    PERCENT,
    Rarity,
    digest,
    digests,
    packed_counts,
    parts_of,
    shingles_of,
    sorted_sets,
    summed_counts,
    words_of,
)


def _lines(texts: list[bytes], short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and number in its text of every line with a shingle; place in that list and hash of every shingle."""
    words = words_of(texts)
    breaks = np.flatnonzero(words.data == 10)
    line = parts_of(words.start, breaks)
    segment, hashes = shingles_of(words.hash, line, short)
    new = np.ones(len(segment), bool)
    new[1:] = segment[1:] != segment[:-1]
    found, place = segment[new], np.cumsum(new) - 1
    # The break after each text counts as one, so a text's first line follows from its end.
    ends = np.cumsum([len(x) + 1 for x in texts]) - 1
    last = np.searchsorted(breaks, ends)
    row = np.searchsorted(last, found)
    first = np.concatenate([[0], last[:-1] + 1])
    return row, found - first[row], place, hashes


def _signatures(docs: DataFrame, short: bool) -> tuple[DataFrame, Rarity]:
    """(doc, line, n, s1, s2, bits) of every line with a token, and the tokens' rarity, from one pass.

    `bits` has a bit for each token. A task's counts travel as rows with n = 0, a part's number in
    `line` and its bytes in `counts`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for rows, texts in slices(batches, "text"):
            row, line, segment, hashes = _lines(texts, short)
            # As many bits as the keys of `Rarity` hold, which give the same digests.
            keys, begins = sorted_sets(segment, hashes >> np.uint64(8), len(row))
            s1, s2 = digests(keys, begins)
            doc = rows.column("doc").take(pa.array(row, pa.int64()))
            bits = np.uint64(1) << (keys & np.uint64(63))
            bits = np.bitwise_or.reduceat(bits, begins[:-1]).view(np.int64) if len(row) else bits.view(np.int64)
            none = pa.nulls(len(row), pa.binary())
            yield {"doc": doc, "line": line, "n": np.diff(begins), "s1": s1, "s2": s2, "bits": bits, "counts": none}
            total += np.bincount((hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
        part, counts = packed_counts(total)
        none = np.zeros(len(part), np.int64)
        own = {c: none for c in ("n", "s1", "s2", "bits")}
        yield own | {"doc": [None] * len(part), "line": part, "counts": counts}

    kind = docs.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, line long, n int, s1 long, s2 long, bits long, counts binary"
    both = written(map_batches(docs, run, schema), "lines")
    table = summed_counts(both.filter("n = 0").select(F.col("line").cast("int").alias("part"), "counts"))
    lines = both.filter("n > 0").drop("counts")
    lines._tabassay_path = both._tabassay_path
    return lines, Rarity(table)


def _shared_prefixes(docs: DataFrame, rarity: Rarity, short: bool) -> DataFrame:
    """(token, owner, at): prefix members that different sets share; `at` packs set size and place.

    `owner` is the first half of the set's digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[Members]:
        for _, texts in slices(batches, "text"):
            row, _, segment, hashes = _lines(texts, short)
            keys, begins = sorted_sets(segment, rarity.keys(hashes), len(row))
            size = np.diff(begins)
            length = size - -(-PERCENT * size // 100) + 1
            own = np.repeat(np.arange(len(row)), length)
            place = np.arange(len(own)) - np.repeat(np.cumsum(length) - length, length)
            token = keys[begins[:-1][own] + place]
            # The digest is that of the hashes themselves, as in `_signatures`.
            owner = digest(keys & HASH_BITS, begins, 1)[own]
            yield token.view(np.int64), owner, size[own] << 32 | place, rarity.expected(token)

    return shared_members(docs, run, rarity.total * (100 - PERCENT) // 100)


def _possible(a: str, b: str, a_bits: str, b_bits: str) -> Column:
    """Length, positional and bitmap filter for two sets that share a prefix member."""
    n, m = (F.shiftright(x, 32) for x in (a, b))
    i, j = (F.col(x).bitwiseAND(F.lit(2**32 - 1)) for x in (a, b))
    # At most so many members are shared before this one and after it.
    most = F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1)
    # A bit that only one of them has is a member, at least, that is not shared.
    lacking = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y))))
    most = F.least(most, n - lacking(a_bits, b_bits), m - lacking(b_bits, a_bits))
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & ((100 + PERCENT) * most >= PERCENT * (n + m))


def _texts_of(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """(doc, line, mates, g, bytes): `ends` with the text of its lines.

    Only lines that are asked for are shuffled, and few others. Rows may share an id.
    """
    lines = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("line", "bytes"))
    lines = lines.select("doc", F.col("line").cast("long").alias("line"), F.col("bytes").cast("binary").alias("bytes"))
    asked = ends.select(F.col("at.doc").alias("_doc"), F.col("at.line").alias("_line"), "mates", "g")
    lines = perhaps_in(lines, [F.col("doc"), F.col("line")], asked, [F.col("_doc"), F.col("_line")])
    joined = lines.join(asked, same(F.col("doc"), F.col("_doc")) & (F.col("line") == F.col("_line")))
    return joined.select("doc", "line", "mates", "g", "bytes")


def _matched(docs: DataFrame, pairs: DataFrame, short: bool) -> DataFrame:
    """(doc, line) of the pairs (a, b) of lines whose first is similar to its second."""
    ship_package(docs.sparkSession)
    kind = docs.schema["doc"].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        row, _, segment, hashes = _lines(rows["bytes"].to_pylist(), short)
        keys, begins = sorted_sets(segment, hashes, len(row))
        keys, begins = keys.tolist(), begins.tolist()
        sets = [frozenset()] * rows.num_rows
        for r, x, y in zip(row.tolist(), begins[:-1], begins[1:], strict=True):
            sets[r] = frozenset(keys[x:y])
        places = list(zip(rows["doc"].to_pylist(), rows["line"].to_pylist(), strict=True))
        mates = rows["mates"].to_pylist()
        # Rows that share an id may bring several texts of one line.
        known: dict[tuple, set[frozenset]] = {}
        for place, own, mate in zip(places, sets, mates, strict=True):
            if mate is None:
                known.setdefault(place, set()).add(own)
        good = [
            i
            for i, (own, mate) in enumerate(zip(sets, mates, strict=True))
            if mate and any(_similar(own, x) for m in mate for x in known.get((m["doc"], m["line"]), ()))
        ]
        take = pa.array(good, pa.int64())
        return pa.table({"doc": rows["doc"].take(take), "line": rows["line"].take(take)})

    with scratch() as keep:
        texts = _texts_of(docs, deal(pairs))
        found = texts.groupBy("g").applyInArrow(run, f"doc {kind}, line long")
        return keep(written(found.distinct(), "matched"))


def _similar(a: frozenset, b: frozenset) -> bool:
    both = len(a & b)
    return both > 0 and 100 * both >= PERCENT * (len(a) + len(b) - both)


def later_matches(df: DataFrame, doc_id: str = "doc_id", text: str = "text", short: bool = False) -> DataFrame:
    """(doc, line): the lines that are similar to an earlier one, by id, then by place in the text."""
    docs = df.selectExpr(f"`{doc_id}` AS doc", f"`{text}` AS text")
    place = F.struct("doc", "line")
    # Equal sets: the first line stands for all.
    signed, rarity = _signatures(docs, short)
    sets = ["n", "s1", "s2"]
    found = signed.groupBy(*sets).agg(
        *(F.min(c).alias(c) for c in ("doc", "line")), F.max("bits").alias("bits"), F.count(F.lit(1)).alias("c")
    )
    found = written(found, "classes")

    def met_by_set(df: DataFrame, other: DataFrame) -> DataFrame:
        other = other.withColumnsRenamed({c: f"_{c}" for c in sets})
        return df.join(other, reduce(and_, (F.col(c) == F.col(f"_{c}") for c in sets))).drop(*(f"_{c}" for c in sets))

    # The first line is looked for only among those that have equals; a set alone has one line and one text.
    several = written(met_by_set(signed, found.filter("c > 1").select(*sets)), "several")
    firsts = several.groupBy(*sets).agg(F.min(place).alias("first"), F.max("bits").alias("bits"))
    firsts = written(firsts, "firsts")
    copies = met_by_set(several, firsts.drop("bits")).filter(~same(place, F.col("first")))
    copies = written(copies.select("doc", "line").distinct(), "copies")
    alone = found.filter("c = 1").select("s1", place.alias("first"), "bits")
    classes = alone.union(firsts.select("s1", "first", "bits"))
    discard(signed, several)

    members = written(_shared_prefixes(docs, rarity, short), "members")
    postings = members.join(
        classes, F.col("owner") == F.col("s1")
    ).select("token", F.col("first").alias("a"), "at", "bits")
    after = F.ceil(PERCENT * F.shiftright("at", 32) / 100) - 1
    postings = written(bounded(postings, "a", after), "postings")
    discard(members, found, firsts)
    # Each line is first compared with the one that leads most of its prefix.
    leads = postings.groupBy(F.col("token").alias("_t")).agg(F.min(F.struct("a", "at", "bits")).alias("x"))
    met = postings.join(leads, F.col("token") == F.col("_t"))
    met = met.select("a", "at", "bits", *(F.col(f"x.{c}").alias(d) for c, d in (("a", "b"), ("at", "b_at"), ("bits", "b_bits"))))
    met = met.filter(~same(F.col("a"), F.col("b")) & _possible("at", "b_at", "bits", "b_bits"))
    best = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).groupBy("a")
    best = best.agg(F.max(F.struct("c", "b")).alias("x")).select("a", "x.b")
    matched = _matched(docs, best, short)

    settled = written(copies.union(matched).select(place.alias("_a")).distinct(), "settled")
    rest = postings.join(settled, same(F.col("a"), F.col("_a")), "left_anti")
    carried = ("token", "at", "bits", "most", *(f"w{i}" for i in range(WORDS)))
    l, r = ([F.col("a").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in carried)] for s in "lr")
    pairs = written(rest.select(*l), "rest").join(
        postings.select(*r),
        (F.col("l_token") == F.col("r_token"))
        & (F.col("l") > F.col("r"))
        & _possible("l_at", "r_at", "l_bits", "r_bits")
        & enough_open(),
    )
    more = _matched(docs, _enough_shared(pairs), short)
    return copies.union(matched).union(more).distinct()


def _enough_shared(met: DataFrame) -> DataFrame:
    """(a, b): pairs that share as many prefix members as similar sets must.

    Of the set whose prefix ends first, all members up to there are known in both
    sets, so no more than those found and the rest of that set can be shared.
    """
    n, m = F.shiftright("l_at", 32).alias("n"), F.shiftright("r_at", 32).alias("m")
    counted = met.groupBy(F.col("l").alias("a"), F.col("r").alias("b"), n, m).agg(F.count(F.lit(1)).alias("c"))
    rest = lambda size: F.ceil(PERCENT * size / 100) - 1
    needed = F.ceil(PERCENT * (F.col("n") + F.col("m")) / (100 + PERCENT))
    least = needed - F.greatest(rest(F.col("n")), rest(F.col("m")))
    return counted.filter(F.col("c") >= least).select("a", "b").distinct()


def remove_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", short: bool = False) -> DataFrame:
    """`df` with the later matches cut out of its texts, and the columns _lines and _removed (counts).

    Lines are cut at \\n; the lines that stay are joined by it again. A text that
    loses every line becomes empty. NULL stays NULL, with no lines. Rows that share
    an id are one document: a line is removed from all or none of them, by its
    place. A NULL id comes before all others. An empty table gives no rows. With
    `short`, a line with fewer words than a shingle goes if an earlier one has the
    same words; without, it always stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for rows, texts in slices(batches, "_text"):
            bodies, lines, removed = [], [], []
            known = rows.column("_text").is_valid().to_pylist()
            for body, gone, has in zip(texts, rows.column("_gone").to_pylist(), known, strict=True):
                parts = body.split(b"\n") if has else []
                out = set(gone or ())
                left = [x for i, x in enumerate(parts) if i not in out] if out else parts
                bodies.append(b"\n".join(left).decode("utf-8") if has else None)
                lines.append(len(parts))
                removed.append(len(parts) - len(left))
            own = {name: rows.column(name) for name in inner}
            yield own | {"_text": bodies, "_lines": lines, "_removed": removed}

    with scratch() as keep:
        later = keep(written(later_matches(df, doc_id, text, short), "later"))
    gone = later.groupBy("doc").agg(F.collect_set("line").alias("_gone"))
    # Own names, so that no column of the table clashes with the ones added here.
    inner = [f"c{i}" for i, c in enumerate(df.columns) if c != text]
    named = df.select(*(F.col(f"`{c}`").alias("_text" if c == text else f"c{i}") for i, c in enumerate(df.columns)))
    key = f"c{df.columns.index(doc_id)}"
    # A text that loses no line needs no join, so few of those are shuffled.
    cut, whole = parted(named, [F.col(key)], later, [F.col("doc")])
    cut = cut.join(gone.withColumnRenamed("doc", "_doc"), same(F.col(key), F.col("_doc")), "left").drop("_doc")
    rows = cut.unionByName(whole.withColumn("_gone", F.lit(None).cast(gone.schema["_gone"].dataType)))
    kinds = {f"c{i}": f.dataType.simpleString() for i, f in enumerate(df.schema)}
    schema = ", ".join(f"{c} {kinds[c]}" for c in inner) + ", _text string, _lines long, _removed long"
    result = map_batches(rows, run, schema)
    back = [F.col("_text" if c == text else f"c{i}").alias(c) for i, c in enumerate(df.columns)]
    return result.select(*back, "_lines", "_removed")
