"""Byte-pair encoding over a trie of the distinct words, and decoding.

The encoding of a text's prefix is a prefix of its encoding up to the last token:
if a word's tokens are a, b, c, then a, b encode what stands before c. So the last
token of every prefix says everything: going back over the last tokens yields the
whole encoding. The last token of a prefix is the one token ending there that
follows the last token of what is left of it in a pair which no merge breaks up.

The distinct words of a run of rows are inserted into a trie; a depth-first walk
carries the last tokens along the path, so a prefix that many words share is
worked out once.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tabassay.llm.shared import Recent, map_batches, slices

#: About so many chunks, words and pairs of tokens a Python worker remembers each.
CACHE = 400_000
#: Bytes of text whose new words go through one trie.
SLICE = 8_000_000

#: How the vocabulary's file cuts words, and the white space it ignores.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it prints, else the next free one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


def trie(words: Iterable[str]) -> dict:
    """Nodes by character; the part of a word that no other shares is one string, "" marks a word's end."""
    root: dict = {}
    for word in words:
        node = root
        for i, character in enumerate(word):
            child = node.get(character)
            if child is None:
                node[character] = word[i + 1 :]
                break
            if child.__class__ is str:
                # Another word has ended its path here: its rest moves one node down.
                child = node[character] = {child[0]: child[1:]} if child else {"": ""}
            node = child
        else:
            node[""] = ""
    return root


class WordEncoder:
    """The vocabulary file's model: ids of single words, over a trie."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        pairs = (x.split(" ") if isinstance(x, str) else x for x in model["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        self.special = {x["content"]: x["id"] for x in content["added_tokens"]}
        self.strings = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        #: Every string with which a token ends: what no token ends with needs no longer look.
        self.tails = {t[i:] for t in self.ids for i in range(len(t))}
        self.characters = byte_characters()
        self.whole = {t for t in self.ids if self._merge(self._symbols(t)) == [t]}
        self.fits: dict[tuple[str, str], bool] = {}

    def _symbols(self, token: str) -> list[str]:
        if len(token) > len(self.end) and token.endswith(self.end):
            body = token.removesuffix(self.end)
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _merge(self, symbols: list[str]) -> list[str]:
        """Plain merging of a few symbols, the lowest rank first."""
        ranks, symbols = self.ranks, list(symbols)
        while len(symbols) > 1:
            best, at = min(
                (ranks.get(pair, len(ranks)), i) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False))
            )
            if best == len(ranks):
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _follows(self, left: str, right: str) -> bool:
        """Whether the two tokens side by side stay as they are."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= CACHE:
                self.fits.clear()
            known = self._merge(self._symbols(left) + self._symbols(right)) == [left, right]
            self.fits[left, right] = known
        return known

    def _last(self, path: str, last: list[str], end: str) -> str:
        """The last token of a prefix, given those of the shorter ones."""
        size, found = len(path), []
        for at in range(size - 1, -1, -1):
            token = path[at:] + end
            if token in self.whole:
                found.append((at, token))
            elif token not in self.tails:
                break
        for at, token in reversed(found):
            if not at or self._follows(last[at], token):
                return token
        raise ValueError(f"no token of the vocabulary ends {path!r}")

    def encode(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each distinct word with its ids. Words are strings of byte characters."""
        # last[d]: last token of the first d characters of the path.
        last: list[str] = []
        walk: list[tuple[int, str, dict]] = [(0, "", trie(words))]
        while walk:
            depth, path, node = walk.pop()
            del last[depth:]
            last.append(self._last(path, last, "") if depth else "")
            for character, child in node.items():
                if not character:
                    yield path, self._back(path, last)
                elif child.__class__ is dict:
                    walk.append((depth + 1, path + character, child))
                else:
                    word = path + character + child
                    for d in range(depth + 1, len(word)):
                        last.append(self._last(word[:d], last, ""))
                    yield word, self._back(word, last)
                    del last[depth + 1 :]

    def _back(self, word: str, last: list[str]) -> list[int]:
        token = self._last(word, last, self.end)
        ids, at = [self.ids[token]], len(word) - len(token.removesuffix(self.end))
        while at:
            token = last[at]
            ids.append(self.ids[token])
            at -= len(token)
        return ids[::-1]


@lru_cache(maxsize=2)
def _encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


class TextEncoder:
    """Whole texts: chunks between white space are encoded once and looked up."""

    def __init__(self, path: str) -> None:
        self.model = WordEncoder(path)
        self.words = regex.compile(WORDS)
        self.space = re.compile(SPACE)
        self.odd = re.compile(r"[\x1c-\x1f]")
        self.table = {b: c for b, c in enumerate(self.model.characters)}
        self.special = re.compile("|".join(re.escape(x) for x in self.model.special) or r"(?!)")
        self.known: Recent[str, tuple[bytes, str]] = Recent(CACHE // 2)
        self.chunks: Recent[str, tuple[bytes, str]] = Recent(CACHE)

    def _cut(self, text: str) -> list[str]:
        """str.split knows four separators more than the vocabulary's white space."""
        if self.odd.search(text):
            return [x for x in self.space.split(text) if x]
        return text.split()

    def _words(self, chunk: str) -> list[str]:
        if chunk.isascii() and chunk.isalpha():
            return [chunk.lower()]
        # Letter by letter: the vocabulary's lower case knows no final sigma.
        chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        return [x.encode("utf-8").decode("latin-1").translate(self.table) for x in self.words.findall(chunk)]

    def learn(self, chunks: set[str]) -> None:
        """Encodes the chunks not seen before; their new words go through one trie."""
        new = {chunk: self._words(chunk) for chunk in self.chunks.missing(chunks)}
        unknown = self.known.missing({w for words in new.values() for w in words})
        known, remember, strings = self.known.now, self.chunks.now, self.model.strings
        for word, ids in self.model.encode(unknown):
            packed = b"".join([i.to_bytes(4, "little") for i in ids])
            known[word] = (packed, " ".join([strings[i] for i in ids]))
        for chunk, words in new.items():
            if len(words) == 1:
                remember[chunk] = known[words[0]]
            else:
                found = [known[w] for w in words]
                remember[chunk] = (b"".join([x[0] for x in found]), " ".join([x[1] for x in found]))

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Per text the ids as little-endian unsigned 32-bit integers, and the decoded text."""
        parts: list[list[str]] = []
        wanted: set[str] = set()
        for text in texts:
            if not self.special.search(text):
                parts.append(self._cut(text))
                wanted.update(parts[-1])
                continue
            pieces, at = [], 0
            for found in self.special.finditer(text):
                # A space cannot be in a chunk, so it marks the vocabulary's own tokens.
                pieces += [*self._cut(text[at : found.start()]), " " + found.group()]
                at = found.end()
            parts.append(pieces + self._cut(text[at:]))
            wanted.update(x for x in parts[-1] if x[0] != " ")
        self.learn(wanted)
        known = self.chunks.now
        known.update((" " + x, self._special(x)) for x in self.model.special)
        for pieces in parts:
            found = [known[x] for x in pieces]
            # A chunk of characters that the vocabulary ignores has no ids.
            yield b"".join([x[0] for x in found]), " ".join([x[1] for x in found if x[0]])

    def _special(self, token: str) -> tuple[bytes, str]:
        return self.model.special[token].to_bytes(4, "little"), token


def encode_texts(df: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, ids, decoded): ids as bytes of little-endian unsigned 32-bit integers.

    NULL counts as the empty text, which has no ids. Every row is encoded for
    itself, so repeated rows, ties and empty tables need no rule.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = _encoder(vocabulary)
        for rows, texts in slices(batches, "text", SLICE):
            both = list(encoder.encode([x.decode("utf-8") for x in texts]))
            yield {
                "doc": rows.column("doc"),
                "ids": [x[0] for x in both],
                "decoded": [x[1] for x in both],
            }

    kind = df.schema[doc_id].dataType.simpleString()
    narrow = df.selectExpr(f"`{doc_id}` AS doc", f"`{text}` AS text")
    return map_batches(narrow, run, f"doc {kind}, ids binary, decoded string")


def encode_digests(df: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_tokens, ids_sha256, decoded_sha256): like encode_texts, but for the digests alone.

    The ids stay in the Python worker that made them instead of going through the JVM.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = _encoder(vocabulary)
        for rows, texts in slices(batches, "text", SLICE):
            counts, ids, decoded = [], [], []
            for packed, string in encoder.encode([x.decode("utf-8") for x in texts]):
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(string.encode("utf-8")).hexdigest())
            yield {"doc": rows.column("doc"), "n_tokens": counts, "ids_sha256": ids, "decoded_sha256": decoded}

    kind = df.schema[doc_id].dataType.simpleString()
    narrow = df.selectExpr(f"`{doc_id}` AS doc", f"`{text}` AS text")
    return map_batches(narrow, run, f"doc {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
