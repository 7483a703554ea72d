"""Members shared by different sets, against a plain count."""

import numpy as np
import pytest

from tabassay.llm import postings
from tabassay.llm.shingles import _by_segment_and_key, sorted_sets


@pytest.mark.parametrize("chunk, bucket, parts", [(500_000, 500_000, 1), (7, 40, 3)])
def test_shared_members(spark, monkeypatch, chunk, bucket, parts):
    monkeypatch.setattr(postings, "CHUNK", chunk)
    monkeypatch.setattr(postings, "BUCKET_MEMBERS", bucket)
    draw = np.random.default_rng(3)
    # Token 0 is in every set, sets are repeated, and some sets have one member only.
    rows = [(int(t), int(o), int(o) % 5) for o in draw.integers(-90, 90, 300) for t in {0, o % 17 + 1, o * 31 + 500}]
    df = spark.createDataFrame(rows, "token long, owner long, at long").repartition(parts)

    def members(batches):
        for b in batches:
            token, owner, at = (b.column(c).to_numpy() for c in ("token", "owner", "at"))
            yield token, owner, at, np.where(token == 0, 0.0, 1.0)

    sets = {}
    for t, o, _ in rows:
        sets.setdefault(t, set()).add(o)
    found = [tuple(r) for r in postings.shared_members(df, members, len(rows)).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {x for x in rows if len(sets[x[0]]) > 1}
    assert postings.shared_members(df.limit(0), members, 0).count() == 0


def test_hot_members_all_stay(spark):
    rows = [(1, o, 3) for o in range(40)] + [(2, 0, 3), (3, 0, 4), (3, 1, 4)]
    df = spark.createDataFrame(rows, "token long, owner long, at long").repartition(4)

    def members(batches):
        for b in batches:
            token, owner, at = (b.column(c).to_numpy() for c in ("token", "owner", "at"))
            yield token, owner, at, np.where(token == 1, 10.0 * postings.HOT_MEMBERS, 0.0)

    found = {tuple(r) for r in postings.shared_members(df, members, 50 * postings.BUCKET_MEMBERS).collect()}
    assert found == {x for x in rows if x[0] != 2}


@pytest.mark.parametrize("near", [False, True])
def test_sets_are_sorted_where_keys_begin_alike(near):
    draw = np.random.default_rng(5)
    segment = np.sort(draw.integers(0, 9, 400))
    keys = draw.integers(0, 50, 400).astype(np.uint64) << np.uint64(0 if near else 30)
    found, begins = sorted_sets(segment, keys, 10)
    for i in range(10):
        assert found[begins[i] : begins[i + 1]].tolist() == sorted(set(keys[segment == i].tolist()))
    assert len(_by_segment_and_key(segment, keys, 1 << 20)) == 400
