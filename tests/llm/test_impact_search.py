"""Ranked search against scores of all documents in plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from tabassay.llm import impact_search
from tabassay.llm.impact_search import Bucket, search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, doc string, term array<int>, step int, n bigint, score string"


def _plain(docs, items, top):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t, *_ in docs]
    bags = [(i, b) for i, b in bags if b]
    count, length = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        found = []
        for doc, bag in bags:
            m = 50 + 50 * bag.total() * count // length
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m))
                for t in terms if t in bag
            )
            if score > 0:
                found.append((doc, score))
        found.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out += [(item, k, doc, score) for k, (doc, score) in enumerate(found[:top], 1)]
    return sorted(out, key=str)


def _tables():
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(300)] + ["Über", "ñandú", "日本", "x1y2"]
    weight = 1 / np.arange(1, len(words) + 1)
    draw = lambda n: " ".join(rng.choice(words, n, p=weight / weight.sum()))
    docs = [(i, draw(int(rng.integers(0, 60)))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(90)]  # a third are copies: equal scores
    docs += [(5, docs[8][1]), (5, docs[8][1]), (None, docs[9][1]), (None, docs[9][1]), (7, None), (8, ""), (9, "--- !!")]
    docs += [(2000, draw(9000)), (2001, "W1 w1,W1;w1 ÜBER über"), (2002, "only here")]
    items = [(i, draw(int(rng.integers(1, 25)))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "nowhere unseen"), (103, "only"), (3, "w1 w1 w1"), (None, "w2 w40"), (None, "w7")]
    items += [(104, docs[7][1]), (105, docs[7][1])]
    return docs, items


@pytest.fixture(scope="module")
def tables():
    return _tables()


def _frames(spark, tables):
    docs, items = tables
    clash = [(i, t, "d", [1], 2, 3, "s") for i, t in docs]
    return spark.createDataFrame(clash, SCHEMA).repartition(5), spark.createDataFrame(items, "item_id int, text string")


def _found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_as_plain_scores(spark, tables):
    docs, items = _frames(spark, tables)
    assert _found(search(docs, items, top=20)) == _plain(*tables, 20)
    assert _found(search(docs.limit(0), items)) == []
    assert _found(search(docs, items.limit(0))) == []


def test_many_buckets_waves_and_blocks(spark, tables, monkeypatch):
    monkeypatch.setattr(impact_search, "BUCKET_COST", 3000)
    monkeypatch.setattr(impact_search, "WAVE", 1)
    monkeypatch.setattr(impact_search, "BLOCK_TERMS", 150)
    docs, items = _frames(spark, tables)
    assert _found(search(docs, items, top=3)) == _plain(*tables, 3)


def test_ids_that_are_strings(spark, tables):
    docs, items = _frames(spark, tables)
    texts = search(docs.withColumn("doc_id", docs["doc_id"].cast("string")), items, top=5)
    assert texts.schema["doc"].dataType.simpleString() == "string"
    scores = [(r[0], r[1], r[3]) for r in texts.collect()]
    assert sorted(scores, key=str) == sorted(((a, b, d) for a, b, _, d in _plain(*tables, 5)), key=str)


def test_bounds_leave_out_no_document():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    for _ in range(200):
        rows, width = int(rng.integers(1, 30)), 12
        x = rng.integers(1, 1_000_000, (rows, width)) * (rng.random((rows, width)) < 0.4)
        norm = np.sqrt((x.astype(float) ** 2).sum(axis=1))
        batch = pa.RecordBatch.from_pydict({
            "doc": rng.permutation(rows), "norm": norm,
            "term": pa.array([np.flatnonzero(r).tolist() for r in x], pa.list_(pa.int32())),
            "x": pa.array([r[r > 0].tolist() for r in x], pa.list_(pa.int32())),
        })
        terms = rng.choice(width, int(rng.integers(1, width)), replace=False)
        weights = rng.integers(0, 9000, len(terms))
        scores = {int(d): int(s) for d, s in zip(batch.column("doc").to_pylist(), x[:, terms] @ weights, strict=True)}
        least = int(rng.choice([1, *scores.values()])) or 1
        bucket = Bucket(batch)
        found, values = bucket.search(terms.tolist(), weights.tolist(), least)
        got = dict(zip(bucket.docs.take(pa.array(found)).to_pylist(), values.tolist(), strict=True))
        assert got == {d: s for d, s in scores.items() if s >= least}


def test_long_texts_are_split_whole(monkeypatch):
    monkeypatch.setattr(impact_search, "PIECE", 5)
    text = "Abc déf, 12x  ghi-jkl ".encode() * 50
    assert [t.decode() for part in terms_of(text) for t in part] == ["abc", "déf", "12x", "ghi", "jkl"] * 50
