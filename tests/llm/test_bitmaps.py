"""Pairs that bitmaps and open members rule out are neither met nor verified; similar ones always are."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from tabassay.llm import line_dedup, ngram_join
from tabassay.llm.line_dedup import later_matches
from tabassay.llm.ngram_join import bitmaps, may_be_similar, near_duplicates
from tabassay.llm.shared import slices
from tabassay.llm.shingles import BUCKET_BITS, packed_counts, similar, summed_counts


def _words(name: str, count: int) -> str:
    return " ".join(f"{name}{i}" for i in range(count))


def test_bitmaps_rule_out_no_similar_sets():
    rng = np.random.default_rng(5)
    left_out = 0
    for n in (1, 3, 31, 33, 64, 200, 1500):
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            few = rng.random(len(a)) < rng.random()
            b = np.union1d(a[few], rng.integers(0, 2**64, rng.integers(0, n // 2 + 1), dtype=np.uint64))
            segment = np.repeat([0, 1], [len(a), len(b)])
            x, y = bitmaps(segment, np.concatenate([a, b]), np.array([len(a), len(b)]))
            if similar(a, b) and len(b):
                assert may_be_similar(x, len(a), y, len(b)) and may_be_similar(y, len(b), x, len(a))
            left_out += not may_be_similar(x, len(a), y, len(b))
    assert left_out > 150
    assert bitmaps(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(2, np.int64)) == [bytes(8), bytes(8)]


def test_sets_just_short_of_similar_do_not_meet_in_pairs(spark, monkeypatch):
    common = _words("c", 120)
    texts = [(i, f"{common} {_words(f'u{i}x', 22)}") for i in range(40)]
    texts += [(100, f"{texts[7][1]} more"), (101, None), (102, "")]
    met, counted = [], ngram_join._enough_shared
    monkeypatch.setattr(ngram_join, "_enough_shared", lambda pairs: (met.append(pairs.count()), counted(pairs))[1])
    found = near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["doc"]: r["component"] for r in found} == {d: 7 if d == 100 else d for d, _ in texts}
    assert met == [0]  # though 40 sets share 20 members of their prefixes


def test_only_texts_of_pairs_that_may_be_similar_are_verified(spark, monkeypatch):
    texts = [(i, f"{_words(f'c{i % 60}x', 40)} {_words(f'u{i}x', 60)}") for i in range(120)]
    texts.append((200, texts[0][1] + " more"))
    verified, dealt = [], ngram_join.deal
    monkeypatch.setattr(ngram_join, "deal", lambda pairs, size: (verified.append(pairs.count()), dealt(pairs, size))[1])
    found = near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["doc"]: r["component"] for r in found} == {d: 0 if d == 200 else d for d, _ in texts}
    assert sum(verified) == 1


def test_only_lines_that_may_be_similar_are_verified(spark, monkeypatch):
    texts = [(i, f"{_words(f'c{i % 60}x', 5)} {_words(f'u{i}x', 4)}\n{_words('same', 9)}") for i in range(120)]
    texts.append((200, _words("u7x", 2) + "\n" + texts[7][1].split("\n")[0].replace("c7x0", "else")))
    verified, dealt = [], line_dedup.deal
    monkeypatch.setattr(line_dedup, "deal", lambda pairs: (verified.append(pairs.count()), dealt(pairs))[1])
    found = later_matches(spark.createDataFrame(texts, "doc_id long, text string"), short=True)
    assert sorted((r["doc"], r["line"]) for r in found.collect()) == [(i, 1) for i in range(1, 120)]
    assert sum(verified) <= 2  # line 200 is like 7 in four of six shingles


def test_counts_of_tasks_are_added_up(spark):
    tables = np.zeros((3, 1 << BUCKET_BITS), np.int64)
    tables[0, [0, 5, 65_535]], tables[1, [5, 40_000]] = [1, 2**40, 3], [7, 9]
    rows = [(i, bytearray(x)) for t in tables for i, x in zip(*packed_counts(t), strict=True)]
    assert len(rows) == 4
    assert (summed_counts(spark.createDataFrame(rows, "part int, counts binary")) == tables.sum(axis=0)).all()
    none = spark.createDataFrame([], "part int, counts binary")
    assert not summed_counts(none).any()


def test_slices_copy_only_the_texts_of_a_run():
    texts = ["ab", None, "é" * 5, "", "x" * 30, "y"]
    batch = pa.RecordBatch.from_pydict({"i": list(range(6)), "t": texts})
    asked = []
    parts = slices(iter([batch, batch.slice(0, 0)]), "t", 12)
    before = tracemalloc_peak(lambda: asked.append(next(parts)))
    got = [*asked, *parts]
    assert [(rows.column("i").to_pylist(), found) for rows, found in got] == [
        ([0, 1], [b"ab", b""]),
        ([2, 3], ["é".encode() * 5, b""]),
        ([4], [b"x" * 30]),
        ([5], [b"y"]),
    ]
    many = pa.RecordBatch.from_pydict({"t": ["z" * 1000] * 5000})
    assert before < 100_000 and tracemalloc_peak(lambda: next(slices(iter([many]), "t", 50_000))) < 1_000_000


def tracemalloc_peak(work) -> int:
    """The most bytes that Python held at once during some work."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
