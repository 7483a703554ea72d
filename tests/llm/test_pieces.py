"""SentencePiece ids and texts against the library."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tabassay.llm import queries
from tabassay.llm.piece_table import PieceEncoder, PieceModel, encode_pieces, piece_digests

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = [
    None,
    "",
    " ",
    "   ",
    "one",
    " two  spaces   ",
    "line\nends\r\n\tand tabs",
    "▁marks ▁▁ in the text",
    "<s> </s> <unk> <0x41>",
    "é ñ ﬁ 漢字 𝄞 \x00 ­ �",
    "x" * 300,
    " " * 100 + "word",
    "日本語 テキスト 한국어 " * 12,
    "the quick brown fox " * 3000,
    "aaaa" * 5000,
    "one",
]


@pytest.fixture(scope="module")
def encoder():
    return PieceEncoder(PATH)


def _wanted(text: str | None) -> tuple[list[int], str]:
    ids = LIBRARY.encode(text or "", add_eos=True)
    return ids, LIBRARY.decode(ids)


ALPHABET = st.one_of(st.sampled_from(" ▁\n\taeinorst.,'é²漢𝄞<0x41>"), st.characters(exclude_categories=["Cs"]))


@settings(max_examples=400, deadline=None)
@given(text=st.text(ALPHABET, max_size=60))
def test_any_text_as_the_library(encoder, text):
    ids, decoded = _wanted(text)
    assert list(encoder.encode([text])) == [(" ".join(map(str, ids)), decoded)]
    assert encoder.model.decode(ids) == decoded


def test_bytes_that_are_no_character():
    model = PieceModel(PATH)
    for ids in ([3 + 0xE6], [3 + 0xC3, 3 + 0xA9], [3 + 0xC3, 300], [1, 2, 300], []):
        assert model.decode(ids) == LIBRARY.decode(ids)


def test_documents(spark):
    rows = [(i, t, "clash", [1]) for i, t in enumerate(TEXTS)] + [(3, "another text of the id", "x", None), (None, "n", "y", [])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, doc string, ids array<int>").repartition(3)
    found = sorted(((r["doc"], list(r["ids"]), r["decoded"]) for r in encode_pieces(df, PATH).collect()), key=str)
    assert found == sorted(((i, *_wanted(t)) for i, t, *_ in rows), key=str)
    digests = sorted((tuple(r) for r in piece_digests(df, PATH).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        ids, decoded = _wanted(t)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded)]
        want.append((i, len(ids), *sha))
    assert digests == sorted(want, key=str)
    assert piece_digests(df.limit(0), PATH).count() == 0


def test_query(spark, sf):
    found = {r["doc_id"]: r for r in queries.QUERIES["op13_sentencepiece"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(found) == len(docs)
    for r in docs:
        ids, decoded = _wanted(r["text"])
        assert found[r["doc_id"]]["n_tokens"] == len(ids)
        assert found[r["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
