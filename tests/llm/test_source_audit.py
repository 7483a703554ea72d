"""Divergence of sources against sums in plain Python."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabassay.llm import source_audit
from tabassay.llm.source_audit import audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "text string, lang string, source string, term string, digest int, grp string, rank int, n int"


def _plain(rows, least=10, top=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = TERM.findall(low)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = [g[1] for g in groups if g[0] == lang]
        whole = sum((counts[lang, s] for s in own), Counter())

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in own}
        q = shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in own if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(found[:most], 1)]
    return sorted(out)


def _texts():
    rng = np.random.default_rng(5)
    words = [*(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)), "Über", "ñandú", "ZEBRA", "zebra", "日本"]
    rows = []
    for i in range(260):
        first = (i % 7) * 9
        own = rng.choice(words[first : first + 40] + words[-5:], rng.integers(0, 30))
        text = " ".join(own) + rng.choice(["", " 12 3", "\n--x_y", " a1b"])
        rows.append((text, ["aa", "bb", None][i % 3], f"s{i % 7}" if i % 11 else None))
    rows += [(None, "aa", "s1"), ("", "cc", "none"), (None, None, None), ("few words", "dd", "x"), ("word", "dd", "y")]
    rows += [("tie same " * 2, "ee", s) for s in ("p", "q", "r") for _ in range(12)] + [rows[0]] * 3
    rows.append((" ".join(words) * 400, "aa", "long"))
    return [(*r, "clash", 1, "g", 2, 3) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return _texts()


def _found(df):
    return sorted(tuple(r) for r in df.collect())


def test_as_plain_sums(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert _found(audit(df)) == _plain(rows)
    assert _found(audit(df.limit(0))) == []


@pytest.mark.parametrize("bits", [1, 40])
def test_terms_that_share_a_digest(spark, rows, bits):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    poor = lambda term: F.pmod(F.xxhash64(term), F.lit(bits))
    assert _found(audit(df, digest=poor)) == _plain(rows)


def test_blocks_and_buckets(spark, rows, monkeypatch):
    monkeypatch.setattr(source_audit, "BLOCK", 2)
    monkeypatch.setattr(source_audit, "BUCKET", 7)
    monkeypatch.setattr(source_audit, "HELD", 50)
    monkeypatch.setattr(source_audit, "FEW_GROUPS", 0)
    monkeypatch.setattr(source_audit, "FEW_TERMS", 0)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert _found(audit(df)) == _plain(rows)
