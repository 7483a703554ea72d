"""Rows left out before a shuffle, digests in any order, and refinements of several bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tabassay.llm.line_dedup import _texts_of
from tabassay.llm import repeated_bytes
from tabassay.llm.repeated_bytes import _grams, _stable_order
from tabassay.llm.shared import parted, perhaps_in
from tabassay.llm.shingles import HASH_BITS, Rarity, digest, digests, parts_of, sorted_sets


def test_rows_asked_for_stay_and_most_others_go(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id")).alias("doc"), F.lit(7).cast("long").alias("line"))
    asked = rows.filter("doc % 100 = 0 OR doc IS NULL")
    found = perhaps_in(rows, [F.col("doc"), F.col("line")], asked, [F.col("doc"), F.col("line")])
    assert found.columns == ["doc", "line"]
    got = {r["doc"] for r in found.collect()}
    assert {r["doc"] for r in asked.collect()} <= got and len(got) < 250
    assert perhaps_in(rows, [F.col("doc")], asked.limit(0), [F.col("doc")]).count() == 0


def test_only_lines_asked_for_are_joined(spark):
    docs = spark.createDataFrame([(1, "a\n\nb é\n"), (1, "x"), (2, None), (None, "n")], "doc long, text string")
    ends = spark.sql(
        "SELECT struct(d AS doc, l AS line) AS at, CAST(NULL AS array<struct<doc:bigint,line:bigint>>) AS mates, 0L AS g"
        " FROM VALUES (1L, 0L), (1L, 2L), (1L, 3L), (1L, 9L), (2L, 0L), (CAST(NULL AS BIGINT), 0L) AS t(d, l)"
    )
    out = _texts_of(docs, ends)
    got = sorted(((r["doc"] or 0, r["line"], bytes(r["bytes"])) for r in out.collect()))
    assert got == [(0, 0, b"n"), (1, 0, b"a"), (1, 0, b"x"), (1, 2, "b é".encode()), (1, 3, b"")]
    assert "MapInArrow" not in out._jdf.queryExecution().toString()  # no whole text is sent on


def test_digest_from_keys_of_rarity():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 2**64, 500, dtype=np.uint64)
    hashes[100:200] = hashes[:100]
    segment = np.sort(rng.integers(0, 20, 500))
    by_hash = digests(*sorted_sets(segment, hashes >> np.uint64(8), 20))[0]
    keys, begins = sorted_sets(segment, Rarity(rng.integers(0, 9999, 1 << 16)).keys(hashes), 20)
    assert (digest(keys & HASH_BITS, begins, 1) == by_hash).all()


def test_grams_are_in_the_order_of_the_suffixes():
    letters = np.array([3, 1, 2, 0, 3, 1, 2, 9, 0], np.int64)
    grams = _grams(letters, 3, np.array([1] * 4 + [2] * 5), 2)
    assert grams[0] == grams[4] and len(set(grams.tolist())) == len(grams) - 1
    key = [tuple(letters[i : i + 3]) for i in range(9)]
    assert grams[1] < grams[5] and key[1][:2] == key[5][:2]
    keys = np.array([70_000, 1, 70_000, 65_536, 1, 0], np.uint32)
    assert _stable_order(keys).tolist() == [5, 1, 4, 3, 0, 2]


def test_ranks_of_many_letters_are_in_the_order_of_the_suffixes():
    strings = [b"abcabcabcabcabcabcabcabcabc", b"bcabcabcabcabcabcabcabcabca", b"abcabcabcabc", b"c", b""]
    letters, own, suffixes = [], [], []
    for i, x in enumerate(strings):
        letters += [*(c + 1 for c in x), 0]
        own += [i + 1] * (len(x) + 1)
        suffixes += [(*x[k:], -100 + i) for k in range(len(x) + 1)]
    for width in (1, 5, 7, 20):
        rank = repeated_bytes._ranks(np.array(letters), np.array(own), 3, {width})[width]
        first = [x[:width] for x in suffixes]
        places = sorted(set(first))
        assert rank.tolist() == [places.index(x) for x in first]


def test_five_refinements_reach_the_length_sought(monkeypatch):
    sorts, ordered = [], repeated_bytes._stable_order
    monkeypatch.setattr(repeated_bytes, "_stable_order", lambda keys: sorts.append(len(keys)) or ordered(keys))
    part = bytes(np.random.default_rng(1).integers(65, 91, 150, np.uint8))
    shards = [[b"x" + part, part + b"y"], [b"z" + part]]
    string, offset, block = repeated_bytes.merged_blocks(shards, repeated_bytes.SPAN)
    texts = [x for shard in shards for x in shard]
    found = {}
    for s, o, b in zip(string.tolist(), offset.tolist(), block.tolist()):
        found.setdefault(b, []).append(texts[s][o : o + 100])
    assert all(len(set(x)) == 1 for x in found.values())
    assert sorted(len(x) for x in found.values())[-51:] == [3] * 51
    assert len(sorts) <= len(shards) + 5


def test_anchors_need_no_hashes_of_whole_runs(monkeypatch):
    texts = [b"", bytes(range(1, 250)), b"short", bytes(range(1, 250))]
    expected = repeated_bytes.runs_of(texts)[3].tolist()
    monkeypatch.setattr(repeated_bytes, "span_hashes", None)
    assert repeated_bytes._cuts(texts)[5].tolist() == expected


def test_rows_that_no_join_needs_are_parted_from_the_others(spark):
    rows = spark.range(5_000).select(F.when(F.col("id") > 0, F.col("id")).alias("doc"))
    asked = rows.filter("doc % 100 = 0 OR doc IS NULL").union(rows.filter("doc = 300"))
    some, rest = ([r["doc"] for r in x.collect()] for x in parted(rows, [F.col("doc")], asked, [F.col("doc")]))
    assert len(some) + len(rest) == 5_000 and len(set(some) | set(rest)) == 5_000
    assert {None, *range(100, 5_000, 100)} <= set(some) and len(some) < 100
    empty = asked.filter("doc < 0")
    assert parted(rows, [F.col("doc")], empty, [F.col("doc")])[1].count() == 5_000


def test_parts_are_those_of_a_search_for_each_start():
    ends = np.array([3, 3, 7, 20])
    start = np.array([0, 1, 3, 6, 7, 19, 20, 25])
    assert parts_of(start, ends).tolist() == np.searchsorted(ends, start, "right").tolist()
    assert parts_of(start[:0], ends).tolist() == [] and parts_of(start, ends[:0]).tolist() == [0] * 8
