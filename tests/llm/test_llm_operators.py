"""The text operators against brute force on a small table with every awkward case."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabassay.llm import cotraining, repeated_bytes
from tabassay.llm.block_naming import exact_groups
from tabassay.llm.cotraining import score, train
from tabassay.llm.graph import components
from tabassay.llm.language_mixture import identify, learn
from tabassay.llm.line_dedup import remove_lines
from tabassay.llm.ngram_join import near_duplicates
from tabassay.llm.packing import ByteEncoder, combinations, pack_documents, plan, vocabulary_ids
from tabassay.llm.quality_rules import PRIOR_ROWS, RULES, fences, judge, sketch_bucket
from tabassay.llm.repeated_bytes import merged_blocks, remove_repeats
from tabassay.llm.template_extract import extract_block, main_text
from tabassay.llm.trie_bpe import TextEncoder, encode_digests, encode_texts

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    # Names that the operators use themselves.
    "doc string, line int, n int, kept string, keys string, rows int, name string, component string"
)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _prose(seed: int, words: int) -> str:
    rng = np.random.default_rng(seed)
    parts = ["ka", "lo", "mi", "ter", "sen", "dra", "pu", "é", "ñor", "bil"]
    text = ["".join(rng.choice(parts, rng.integers(1, 5))) for _ in range(words)]
    return "\n".join(" ".join(text[i : i + 12]) for i in range(0, words, 12))


def _texts() -> list[tuple]:
    base = _prose(1, 300)
    edited = base.replace(base.split()[150], "changed", 1)
    passage = _prose(2, 40)
    texts = [
        base,
        base,  # an exact copy
        edited,  # a near copy
        None,
        "",
        "",
        " \n\t ",
        "one two",
        "One TWO",
        "one two three four five",
        _prose(3, 120) + "\n" + passage,
        _prose(4, 120) + "\n" + passage + "\n" + _prose(5, 30),
        passage,
        "ab" * 400,  # overlaps itself
        "word " * 200,
        _prose(6, 9000),  # very long
        _prose(7, 5000).replace("\n", " "),
        "12 345 ### !!!",
        "日本語 テキスト 한국어 " * 12,
        "x" * 100,
        "x" * 99,
        "<|endoftext|> plain <|startoftext|>  two  spaces",
    ]
    rows = [
        (i, t, "aa" if i % 2 else None, "s1" if i % 3 else None, None if i % 5 == 0 else len(t or ""))
        for i, t in enumerate(texts)
    ]
    return rows + [rows[0], rows[3]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "d", 1, 2, "k", "x", 3, "n", "c") for r in _texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _rows(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def _by_id() -> dict:
    return {r[0]: r[1] or "" for r in _texts()}


def test_exact_groups(docs, empty):
    texts = _by_id()
    count = Counter(r[1] or "" for r in _texts())
    keep = defaultdict(list)
    for i, t in texts.items():
        keep[t].append(i)
    for block in (7, 8192):
        found = _rows(exact_groups(docs, block=block))
        assert len(found) == len(_texts())
        for r in found:
            t = texts[r["doc"]]
            assert r["keep"] == max(keep[t]) and r["group_size"] == count[t]
            assert r["kept"] == (r["doc"] == max(keep[t]))
            assert r["sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert exact_groups(empty).count() == 0


def test_exact_groups_with_null_ids(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (1, "a"), (None, "b")], "doc_id int, text string")
    found = sorted(((str(r["doc"]), r["keep"], r["group_size"], r["kept"]) for r in _rows(exact_groups(rows))), key=str)
    assert found == [("1", 1, 3, True), ("None", 1, 3, False), ("None", 1, 3, False), ("None", None, 1, True)]


def test_quality_counts(docs, empty):
    texts = _by_id()
    found = _rows(judge(docs, carry=["doc_id", "n", "kept"]).toDF(
        "doc_id", "n", "own", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept"))
    assert len(found) == len(_texts())
    for r in found:
        t = texts[r["doc_id"]]
        words = re.findall(r"[^ \t-\r]+", t)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^ \t-\r]", x)]
        assert (r["n_words"], r["word_chars"]) == (len(words), sum(map(len, words)))
        assert r["n_symbols"] == sum(t.count(c) for c in "#*$%&|<>")
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == len(covered)
        assert r["base_failed"] == (len(words) < 50 or 2 * len(covered) > len(words))
        assert r["n"] == 2 and r["own"] == "k"
        assert not (r["base_failed"] and r["kept"])
    assert judge(empty, carry=["doc_id"]).count() == 0


def test_fences_follow_their_group(spark):
    clean = [(i, _prose(i, 80), "aa", "quiet") for i in range(150)]
    busy = [(1000 + i, _prose(i, 80).replace(" ", "# "), "aa", "busy") for i in range(150)]
    odd = [(5000, _prose(9000, 80).replace(" ", "# "), "aa", "quiet")]
    df = spark.createDataFrame(clean + busy + odd, "doc_id int, text string, lang string, source string")
    kept = {r["doc_id"] for r in _rows(judge(df, carry=["doc_id"])) if r["kept"]}
    assert kept == {r[0] for r in clean + busy}


def test_fences_come_from_the_rows(spark):
    """Every fence against plain quartiles, mixed by rows; groups of other sizes and spreads have other fences."""
    rng = np.random.default_rng(7)
    rows = []
    for lang, source, count, words, share, letters in (
        ("aa", "short", 180, 60, 0.05, 4.5), ("aa", "long", 150, 600, 0.05, 5.5), ("aa", "signs", 160, 60, 0.4, 6.5),
        ("bb", "few", 3, 100, 0.1, 5), ("bb", None, 40, 300, 0.0, 7.5),
    ):
        for _ in range(count):
            n = int(words * rng.uniform(0.8, 1.3))
            symbols, chars = int(n * share * rng.uniform(0, 2)), int(n * letters * rng.uniform(0.95, 1.05))
            lines = max(n // 12, 1)
            rows.append((lang, source, n, chars, symbols, lines, int(rng.integers(0, 2)), int(rng.integers(0, 9))))
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    df = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{c} long" for c in names))

    def bucket(v):
        w = max(v.bit_length() - 6, 0)
        return v >> w << w

    def marks(chosen, value):
        held = sorted(bucket(value(dict(zip(names, r[2:], strict=True)))) for r in chosen)
        return len(held), [held[-(-q * len(held) // 4) - 1] for q in (1, 2, 3)]

    def mixed(mine, other):
        return [(mine[0] * x + PRIOR_ROWS * y) // (mine[0] + PRIOR_ROWS) for x, y in zip(mine[1], other, strict=True)]

    found = {(r["lang"], r["source"]): r for r in _rows(fences(df))}
    assert set(found) == {r[:2] for r in rows}
    for (lang, source), limits in found.items():

        def quartiles(value):
            own, wide = [r for r in rows if r[:2] == (lang, source)], [r for r in rows if r[0] == lang]
            return mixed(marks(own, value), mixed(marks(wide, value), marks(rows, value)[1]))

        for rule in RULES:
            q1, _, q3 = quartiles(lambda r: 1000 * r[rule.numerator] // r[rule.denominator])
            size = quartiles(lambda r: r[rule.denominator])[1]
            step = rule.reach * max(q3 - q1, 1000 * rule.events // (size + rule.events))
            assert limits[f"high_{rule.name}"] == q3 + step
            assert not rule.lower or limits[f"low_{rule.name}"] == q1 - step
    for name in ("high_symbols", "high_dup_lines", "high_repeats", "high_word_length", "low_word_length"):
        assert len({r[name] for r in found.values()}) >= 4, name
    # Each fence lies where a value can pass it.
    assert all(r["low_word_length"] > 1000 for r in found.values())
    assert all(found[k]["high_repeats"] < 1000 and found[k]["high_dup_lines"] < 1000 for k in [("aa", "long"), ("bb", None)])


def test_sketch_buckets(spark):
    df = spark.range(0, 5000).withColumn("b", sketch_bucket(F.col("id")))
    for r in df.collect():
        assert r["b"] <= r["id"] and r["id"] - r["b"] <= r["id"] / 32


def _shingles(words: list[bytes], short: bool) -> frozenset:
    if len(words) >= 5:
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return frozenset([tuple(words)]) if words and short else frozenset()


def _similar(a: frozenset, b: frozenset) -> bool:
    return bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)


@pytest.mark.parametrize("short", [False, True])
def test_line_removal(docs, empty, short):
    texts = {r[0]: r[1] for r in _texts()}
    lines = {
        (i, k): _shingles(WORD.findall(x.translate(LOWER)), short)
        for i, t in texts.items()
        for k, x in enumerate((t or "").encode().split(b"\n"))
    }
    order = sorted(lines)
    gone = {b for n, b in enumerate(order) if any(_similar(lines[a], lines[b]) for a in order[:n])}
    found = _rows(remove_lines(docs, short=short))
    assert len(found) == len(_texts())
    for r in found:
        t = texts[r["doc_id"]]
        parts = [] if t is None else t.split("\n")
        left = [x for k, x in enumerate(parts) if (r["doc_id"], k) not in gone]
        assert r["text"] == (None if t is None else "\n".join(left))
        assert (r["_lines"], r["_removed"]) == (len(parts), len(parts) - len(left))
        assert (r["line"], r["doc"]) == (1, "d")
    assert any(r["_removed"] for r in found)
    assert remove_lines(empty).count() == 0


def test_pipeline_removes_repeated_short_lines(spark):
    texts = {
        1: "Read more\n" + _prose(1, 24) + "\none two three four",
        2: "READ  more\n" + _prose(2, 24) + "\none two three\n\nfour one two three",
        3: "read\nRead more\n" + _prose(1, 24) + "\none two three four\nread more now\n",
        4: "read",
    }
    rows = [(i, t, len(t)) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_chars int").repartition(3)
    lines = {
        (i, k): _shingles(WORD.findall(x.translate(LOWER)), True)
        for i, t in texts.items()
        for k, x in enumerate(t.encode().split(b"\n"))
    }
    order = sorted(lines)
    gone = {b for n, b in enumerate(order) if any(_similar(lines[a], lines[b]) for a in order[:n])}
    left = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in texts.items()}
    found = {r["doc_id"]: r for r in _rows(corpus_pipeline.line_dedup(spark, docs, ""))}
    assert {i: (r["text"], r["n_chars"]) for i, r in found.items()} == {i: (t, len(t)) for i, t in left.items()}
    assert left[4] == "" and left[3] == "read\nread more now\n" and "READ" not in left[2]


def _components(sets: dict) -> dict:
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and _similar(sets[a], sets[b]):
                a_, b_ = root(a), root(b)
                parent[max(a_, b_)] = min(a_, b_)
    return {i: root(i) for i in sets}


def test_near_duplicates(docs, empty):
    sets = {i: _shingles(WORD.findall(t.encode().translate(LOWER)), True) for i, t in _by_id().items()}
    expected = _components(sets)
    found = _rows(near_duplicates(docs))
    assert len(found) == len(_texts())
    for r in found:
        assert (r["n_shingles"], r["component"]) == (len(sets[r["doc"]]), expected[r["doc"]])
    assert expected[8] == 7 and expected[2] == 0 and expected[5] == 5
    assert near_duplicates(empty).count() == 0


def test_near_duplicates_in_chains(spark):
    words = _prose(11, 130).split()
    texts = []
    for i in range(40):  # each is similar to its neighbours, not to all
        texts.append((i, " ".join(words[2 * i : 2 * i + 50])))
    rng = np.random.default_rng(5)
    for i in range(40, 90):  # a group around one text, every pair a little different
        own = _prose(12, 90).split()
        own[int(rng.integers(90))] = f"edit{i}"
        texts.append((i, " ".join(own)))
    df = spark.createDataFrame(texts + [(None, texts[0][1])], "doc_id int, text string").repartition(4)
    sets = {i: _shingles(WORD.findall(t.encode().translate(LOWER)), True) for i, t in texts}
    expected = _components(sets)
    found = {r["doc"]: r["component"] for r in _rows(near_duplicates(df))}
    assert found.pop(None) is None
    assert found == expected


def test_near_duplicates_of_an_id_with_a_copied_and_a_similar_text(spark):
    copied, other = _prose(21, 90), _prose(22, 90)
    near = other.replace(other.split()[80], "changed", 1)
    rows = [(0, copied), (2, other), (5, copied), (5, near), (7, copied), (8, _prose(23, 90))]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    found = {(r["doc"], r["component"]) for r in _rows(near_duplicates(df))}
    assert found == {(0, 0), (2, 0), (5, 0), (7, 0), (8, 8)}


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(40, 41), (42, 41), (50, 50)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a int, b int")).collect()}
    assert found == {**{i: 0 for i in range(31)}, 40: 40, 41: 40, 42: 40}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def _removed(texts: dict) -> dict:
    seen, out = set(), {}
    for i in sorted(texts):
        body = texts[i].encode()
        gone = np.zeros(len(body), bool)
        for p in range(len(body) - 99):
            part = body[p : p + 100]
            if part in seen:
                gone[p : p + 100] = True
            seen.add(part)
        out[i] = gone
    return out


@pytest.mark.parametrize("most", [1_000, 1])
def test_repeated_bytes(docs, empty, monkeypatch, most):
    monkeypatch.setattr(repeated_bytes, "MOST_RUNS", most)
    texts = _by_id()
    gone = _removed(texts)
    found = _rows(remove_repeats(docs, carry=("doc", "rows")).toDF(
        "doc_id", "own", "rows", "kept", "text", "n_bytes", "n_removed", "n_spans"))
    assert len(found) == len(_texts())
    for r in found:
        body = np.frombuffer(texts[r["doc_id"]].encode(), np.uint8)
        out = gone[r["doc_id"]]
        assert bytes(r["kept"]) == body[~out].tobytes()
        assert (r["n_bytes"], r["n_removed"]) == (len(body), int(out.sum()))
        assert r["n_spans"] == int((np.diff(np.concatenate([[0], out.astype(int)])) == 1).sum())
        assert (r["own"], r["rows"]) == ("d", 3)
        if not out.any() and r["text"] is not None:
            assert r["text"] == texts[r["doc_id"]]
    assert sum(r["n_removed"] for r in found) > 1000
    if most > 1:
        assert remove_repeats(empty).count() == 0


def test_merged_transforms_match_sorted_suffixes():
    rng = np.random.default_rng(3)
    shards = [[bytes(rng.integers(97, 99, int(n)).astype(np.uint8)) for n in rng.integers(3, 40, 6)] for _ in range(4)]
    strings = [x for s in shards for x in s]
    for depth in (1, 3, 8):
        string, offset, block = merged_blocks(shards, depth)
        suffixes = [strings[s][o:] for s, o in zip(string, offset, strict=True)]
        assert sorted(zip(string.tolist(), offset.tolist(), strict=True)) == [
            (i, o) for i, x in enumerate(strings) for o in range(len(x) + 1)
        ]
        heads = [x[:depth] for x in suffixes]
        assert heads == sorted(heads)
        groups = defaultdict(list)
        for x, b in zip(suffixes, block.tolist(), strict=True):
            groups[b].append(x)
        for members in groups.values():
            assert len({x[:depth] for x in members}) == 1 and (len(members) == 1 or len(members[0]) >= depth)
        assert sum(len(x) >= depth for x in {h for h in heads}) == len(
            {b for x, b in zip(suffixes, block.tolist(), strict=True) if len(x) >= depth}
        )


def test_packing(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = _by_id()
    found = _rows(pack_documents(docs, path))
    pieces = defaultdict(list)
    for r in found:
        pieces[r["doc"]].append(r)
    assert set(pieces) == set(texts)
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        own = {}
        for r in pieces[i]:
            assert r["doc_tokens"] == len(ids)
            part = ids[r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
            own[r["start"]] = r["length"]
        assert sum(own.values()) == len(ids)
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert pack_documents(empty, path).count() == 0


def test_plan_uses_up_the_histogram():
    rng = np.random.default_rng(2)
    lengths = np.minimum(rng.gamma(1.5, 20, 4000).astype(int) + 1, 64)
    histogram = np.bincount(lengths, minlength=65)
    found = plan(histogram, 64)
    used = np.zeros(65, int)
    for repeats, parts in found:
        assert sum(parts) <= 64
        for n in parts:
            used[n] += repeats
    assert (used == histogram).all()
    sequences = sum(repeats for repeats, _ in found)
    assert lengths.sum() / (64 * sequences) > 0.98
    assert (combinations(10).sum(axis=1) == 10).all()
    assert plan(np.zeros(65, int), 64) == []


def test_bpe_matches_the_library(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = _by_id()
    digests = {(r["doc"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in _rows(encode_digests(docs, path))}
    found = _rows(encode_texts(docs, path))
    assert len(found) == len(_texts())
    for r in found:
        ids = tokenizer.encode(texts[r["doc"]], add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert bytes(r["ids"]) == packed and r["decoded"] == decoded
        sha = [hashlib.sha256(x).hexdigest() for x in (packed, decoded.encode())]
        assert (r["doc"], len(ids), *sha) in digests
    assert encode_texts(empty, path).count() == 0


ODD = ["Σίσυφος ΣΑΣ", "İstanbul ǅ", "a\x1cb\x1fc d", "don't I'll 'S it's", "é ́x a b　c\xa0d", "😀👨‍🦲",
       "x'rey 123 ½", "\x00 \x7f", "ﬁ ẞ ŉ", "<|endof text|>", "a" * 300, "\x85x", "᠎y"]


@pytest.mark.parametrize("text", ODD)
def test_bpe_on_odd_characters(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    expected = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    encoder = _encoder(path)
    assert np.frombuffer(next(iter(encoder.encode([text])))[0], "<u4").tolist() == expected


_known: dict = {}


def _encoder(path):
    if path not in _known:
        _known[path] = TextEncoder(path)
    return _known[path]


def test_language_mixture(spark, empty):
    rng = np.random.default_rng(8)
    syllables = {"xx": ["tha", "ing", "he", "er"], "yy": ["und", "sch", "ö", "ei"], "zz": ["que", "ción", "la", "os"]}
    make = lambda k, n: " ".join("".join(rng.choice(syllables[k], 3)) for _ in range(n))
    rows = [(i, make(k, 60), k) for i, k in enumerate(["xx", "yy", "zz"] * 30)]
    train_ = spark.createDataFrame(rows + [(None, None, None), (1, None, "xx"), (2, "", None)], "doc_id int, text string, lang string")
    model = learn(train_)
    asked = [(0, make("xx", 40)), (1, make("zz", 3000)), (2, None), (3, ""), (4, "12 ?! 3"), (5, make("xx", 60) + make("yy", 60)), (0, "tha"), (None, make("yy", 9))]
    found = [tuple(r)[1:4] for r in identify(spark.createDataFrame(asked, "doc_id int, text string"), model).collect()]
    assert [x[0] for x in found] == ["xx", "zz", "und", "und", "und", found[5][0], "xx", "yy"]
    assert sorted(found[5][2]) == ["xx", "yy"] and 0.3 < found[5][1] < 0.7
    assert all(0 <= x[1] <= 1 for x in found) and found[2][1] == 0
    assert identify(empty, model).count() == 0
    none = learn(train_.filter("lang = 'no such'"))
    assert {r["lang_pred"] for r in identify(train_, none).collect()} == {"und"}


def test_byte_encoder_is_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = ByteEncoder(path, *vocabulary_ids(path)), Tokenizer.from_file(path)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [
        f"a{x}1{x} {x}, {x}{x}" for x in points
    ] + ["", "a" + " " * 9_999 + "b", "a" + " " * 20_000 + "b", "x" * 20_000, "a <|endoftext|> b", "\n\n a", "it's I'LL", _prose(5, 500)]
    for first in range(0, len(texts), 50_000):
        part = texts[first : first + 50_000]
        found = library.encode_batch_fast(part, add_special_tokens=False)
        assert list(encoder.encode(part)) == [np.array(x.ids, "<u4").tobytes() for x in found]


def test_vocabularies_that_do_not_follow_from_their_tokens_are_refused(tmp_path):
    # "bc" is merged before "ab", so "abc" never comes from "ab" and "c".
    vocab = {"a": 0, "b": 1, "c": 2, "bc": 3, "ab": 4, "abc": 5}
    content = {"added_tokens": [], "model": {"vocab": vocab, "merges": ["b c", "a b", "ab c"]}}
    file = tmp_path / "odd.json"
    file.write_text(json.dumps(content))
    with pytest.raises(ValueError):
        vocabulary_ids(str(file))


def test_cotraining(spark):
    good = [(i, _prose(i, 90), "aa", "s") for i in range(160)]
    bad = [(1000 + i, " | ".join(["buy###", "now%%%"] * 40), "aa", "t") for i in range(60)]
    docs = spark.createDataFrame(
        [Row(doc_id=i, text=t, lang=a, source=s, n_chars=len(t)) for i, t, a, s in good + bad]
        + [Row(doc_id=9999, text=None, lang=None, source=None, n_chars=None)]
    )
    labels = [(i, 1, 0) for i in range(0, 160, 2)] + [(1000 + i, 0, 0) for i in range(0, 60, 2)] + [(3, None, 0), (2, 1, 0), (None, 1, 1)]
    pair = train(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    found = {r["doc"]: r for r in score(docs, pair).collect()}
    assert len(found) == 221
    assert all(found[i]["score"] > 0.5 for i in range(160))
    assert all(found[1000 + i]["score"] < 0.5 for i in range(60))
    assert pair.exchanged and sum(pair.exchanged[-1]) > 0
    assert score(docs.limit(0), pair).count() == 0
    # Repeated rows are judged each for itself, and alike.
    again = score(docs.union(docs), pair).collect()
    assert len(again) == 442 and all(r["score"] == found[r["doc"]]["score"] for r in again)


@pytest.mark.parametrize("kept, rate", [([(1, 1), (2, 1), (3, None)], 3 / 4), ([(1, 0)], 1 / 3), ([], 1 / 2)])
def test_cotraining_without_both_labels(docs, empty, spark, kept, rate):
    labels = spark.createDataFrame(kept, "doc_id bigint, quality int")
    for df in (docs, empty):
        known = {i for i, y in kept if y is not None} & {r["doc_id"] for r in df.collect()}
        found = score(df, train(df, labels)).collect()
        assert len(found) == df.count()
        assert len(known) in (0, len([y for _, y in kept if y is not None]))
        for r in found:
            assert r["score_text"] == r["score_meta"]
            assert abs(r["score"] - rate) < 1e-9


def test_cotraining_tells_from_the_whole_pool(spark):
    # More unlabelled rows than any sample of 8,000; the rare kind is in all of them.
    good = "SELECT id AS doc_id, concat('plain words ', id % 97, ' of prose ', id % 89) AS text, 'aa' AS lang, 's' AS source"
    bad = "SELECT 1000000 + id AS doc_id, concat('buy### ', id % 97, ' now%%%') AS text, 'aa' AS lang, 't' AS source"
    docs = spark.sql(f"{good} FROM range(16000) UNION ALL {bad} FROM range(8000)").withColumn("n_chars", F.length("text"))
    labels = docs.filter("doc_id % 100 = 0").selectExpr("doc_id", "int(doc_id < 1000000) AS quality")
    pair = train(docs, labels)
    quota = 24_000 * 99 // 100 // 20
    for turn, told in enumerate(pair.exchanged, 1):
        for n in told:
            assert 0.97 * turn * quota <= n <= turn * quota + 2
    assert len(pair.exchanged) == 4
    found = {r["doc"]: r["score"] for r in score(docs, pair).collect()}
    assert len(found) == 24_000 and all((s > 0.5) == (i < 1_000_000) for i, s in found.items())


@pytest.mark.parametrize("parts", [1, 5])
def test_pool_sums_are_those_of_one_task(spark, parts):
    docs = spark.createDataFrame(
        [(i, _prose(i, 30) + " ###" * (i % 7), "aa", "s", i) for i in range(200)],
        "doc_id int, text string, lang string, source string, n_chars int",
    )
    rows = cotraining._features(
        cotraining._view(docs, "doc_id", "text").withColumn("place", F.xxhash64("id"))
    ).cache()
    table = rows.toArrow()
    x, place = cotraining._arrays(table), table["place"].to_numpy()
    rng = np.random.default_rng(1)
    views = tuple(cotraining.Logistic(weights=rng.normal(0, 3, a.shape[1] + 1)) for a in x)
    turn = cotraining._turn(rows, 200, 0.5, [], views)
    given = cotraining._told([turn], x, place)
    for v in (0, 1):
        logit = views[v].logit(x[v])
        for label, sign in ((1, 1), (0, -1)):
            told = set(np.flatnonzero(given[1 - v] == label))
            sure = np.flatnonzero(sign * logit >= np.log(9))
            assert len(told) == min(5, len(sure)) and told <= set(sure)
            if told and len(told) < len(sure):
                assert min(sign * logit[list(told)]) >= max(sign * logit[list(set(sure) - told)]) - 0.01
    weights = [view.weights for view in views]
    sums, told = cotraining._pool_sums(rows.repartition(parts), [turn], weights)
    for v in (0, 1):
        has = given[v] >= 0
        own = np.hstack([x[v][has], np.ones((has.sum(), 1))])
        assert told[v] == has.sum() and np.allclose(sums[v], cotraining.newton_sums(own, given[v][has], weights[v]))


PAGE = (
    "<!DOCTYPE html><html><head><title>T{0}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
    "<header><h1>Site name</h1></header><nav><ul><li><a href='/x{0}'>Menu {0}</a></li></ul></nav>"
    "<div class='sidebar'>Aside {0}</div>{1}<div class='cookie-notice'>We use cookies</div>"
    "<section id='comments'><p>first {0}!</p></section><form><p>Name</p></form><footer>&copy; {0}</footer></body></html>"
)


def test_extraction_in_articles():
    body = "<article><h1>Head {0}</h1><p>One <b>bo</b>ld&amp;x{0}<br>two\n  three</p><div class='ad'>Buy</div><p>four</article>"
    pages = [PAGE.format(i, body.format(i)) for i in range(9)]
    assert extract_block(pages) == [f"Head {i} One bold&x{i} two three four" for i in range(9)]


def test_extraction_without_articles():
    body = "<div class='content'><h2>Head {0}</h2><p>" + "long text {0} " * 20 + "</p></div>"
    pages = [PAGE.format(i, body.format(i)) for i in range(9)]
    assert extract_block(pages) == [(f"Head {i} " + f"long text {i} " * 20).strip() for i in range(9)]
    plain = [PAGE.format(i, "<table><tr><td>" + f"cell{i} " * 40 + "</td></tr></table><p>Read more</p>") for i in range(9)]
    assert extract_block(plain) == [(f"cell{i} " * 40).strip() for i in range(9)]


def test_extraction_drops_template_texts_within_articles():
    body = (
        "<article><h1>Head {0}</h1><p>Read our other stories</p><p>" + "own text {0} " * 30 + "</p>"
        "<p>Share this story with <b>friends</b> today</p><p>end {0}</p></article>"
    )
    pages = [PAGE.format(i, body.format(i)) for i in range(9)]
    assert extract_block(pages) == [f"Head {i} " + f"own text {i} " * 30 + f"end {i}" for i in range(9)]


def test_extraction_reads_the_articles_slot_where_a_page_has_no_mark():
    body = "<div{1}><h2>Head {0}</h2><p>" + "own text {0} " * 20 + "</p></div>"
    pages = [PAGE.format(i, body.format(i, " class='story'")) for i in range(40)]
    pages.append(PAGE.format(40, body.format(40, "")))
    assert extract_block(pages) == [(f"Head {i} " + f"own text {i} " * 20).strip() for i in range(41)]


def test_extraction_keeps_short_parts_of_unmarked_pages():
    page = (
        "<html><body><h1>Head {0}</h1><h2>lede {0}</h2><table><tr><td>" + "long text {0} " * 50 + "</td></tr></table>"
        "<h3>end {0}</h3><h4>Read more</h4></body></html>"
    )
    texts = extract_block([page.format(i) for i in range(9)])
    assert texts == [f"Head {i} lede {i} " + f"long text {i} " * 50 + f"end {i}" for i in range(9)]


@pytest.mark.parametrize("wrapper", [
    "<div class='layout has-sidebar'>{}</div>", "<div class='with-comments'>{}</div>", "<form action='/'>{}</form>",
    "<div id='no-header'>{}</div>", "<div class='widget'>{}</div>", "<section class='social-history'>{}</section>",
])
@pytest.mark.parametrize("copies", [1, 9])
def test_extraction_within_wrappers(wrapper, copies):
    body = "<article><header class='entry-header'><h1>Head {0}</h1></header><p>" + "text {0} " * 30 + "</p></article>"
    pages = [wrapper.format("<nav>Menu</nav>" + body.format(i) + "<footer>End</footer>") for i in range(copies)]
    assert extract_block(pages) == [(f"Head {i} " + f"text {i} " * 30).strip() for i in range(copies)]


def test_extraction_of_a_page_in_one_form():
    page = "<body><form><nav>Menu</nav><h1>Head {0}</h1><p>" + "text {0} " * 30 + "</p><footer>End</footer></form></body>"
    assert extract_block([page.format(i) for i in range(9)]) == [(f"Head {i} " + f"text {i} " * 30).strip() for i in range(9)]


def test_extraction_leaves_out_articles_of_other_pages():
    page = "<article><p>own {0}</p></article><div class='related'><article>other {0}</article></div><aside><article>x {0}</article></aside>"
    assert extract_block([page.format(i) for i in range(9)]) == [f"own {i}" for i in range(9)]
    assert extract_block([page.format(0)]) == ["own 0"]


def test_extraction_of_odd_pages(spark):
    rows = [
        (1, None, None, "u"),
        (1, None, "", "u"),
        (2, "http://a.b/c", "just text", "u"),
        (None, "http://A.b/d", "<p>not <i>closed &lt;", "u"),
        (3, "no url", "<article>a < b</article><p>x", "u"),
        (4, "http://a.b/e", "<html><article>" + "<div>" * 3000 + "deep" + "</p>" * 9, "u"),
        (4, "http://a.b/e", "<html><article>" + "<div>" * 3000 + "deep" + "</p>" * 9, "u"),
    ]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, host string")
    found = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in main_text(df).collect())
    assert found == [
        ("1", "", 0), ("1", "", 0), ("2", "just text", 9), ("3", "a < b", 5), ("4", "deep", 4), ("4", "deep", 4),
        ("None", "not closed <", 12),
    ]
    assert main_text(df.limit(0)).count() == 0
