"""SentencePiece encoding by a table of last tokens, and decoding.

Which piece ends the encoding of a text's prefix is unique, and what stands before
it is the encoding of the shorter prefix. So one entry per prefix, the last token,
holds the encodings of all prefixes. An automaton over the pieces finds those that
end at a place; the one that stays as it is beside the last token of what precedes
it is the entry. The ids are read off backwards from the end of the text.

Whether two tokens stay as they are side by side depends on these two alone:
merges inside them never look further, and a merge across them would be made in
any text that holds them. The test merges their characters, best score first and
leftmost among equals, and is remembered per pair.

No piece has a space mark after another character, none mixes letters with others,
and line ends are in no longer piece, so merges never cross these places: texts are
cut there and what was encoded before is looked up. What a vocabulary has of these
properties is read off its pieces; one that has none is not cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tabassay.llm.shared import Recent, map_batches, slices

#: About so many cut pieces of text, and pairs of tokens, a Python worker remembers.
CHUNKS = 400_000
PAIRS = 500_000
#: Bytes of text that are cut at once.
SLICE = 4_000_000
#: Fixed value: the character that stands for a space in the vocabulary.
SPACE = "▁"
NEVER = float("-inf")
#: What counts as a letter where texts are cut between letters and others; digits do not, superscript ones neither.
LETTER = r"[^\W\d_²³¹]"


class PieceModel:
    """The vocabulary's pieces: ids of strings by the table of last tokens, strings of ids.

    Vocabularies with byte pieces, a space before the text and no other normalisation
    are supported; others are an error.
    """

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = range(model.get_piece_size())
        if model.normalize(" ﬁ  Å ") != " ﬁ  Å ".join((SPACE, "")).replace(" ", SPACE):
            raise ValueError("the vocabulary normalises texts in a way that is not supported")
        if any(model.is_unused(i) for i in kinds) or sum(model.is_byte(i) for i in kinds) != 256:
            raise ValueError("the vocabulary needs a piece for every byte and no unused ones")
        plain = [i for i in kinds if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.end: int = model.eos_id()
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.pieces = {i: piece for piece, i in self.ids.items()}
        self.scores = {piece: model.get_score(i) for piece, i in self.ids.items()}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in kinds if model.is_byte(i)}
        self.values = {i: b for b, i in self.bytes.items()}
        self.shown = {i: piece.replace(SPACE, " ") for i, piece in self.pieces.items()}
        self.decimal = [str(i) for i in kinds]
        self.sizes = {i: len(piece) for piece, i in self.ids.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        #: How each token is made; a piece that its characters do not merge into is in no encoding.
        self.made: dict[int, list[tuple[float, str, str]]] = {}
        for piece, i in self.ids.items():
            steps = self._merges(piece)
            if steps[-1][1] == piece:
                self.made[i] = steps
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.cut = re.compile(self._cut_pattern())

    def _cut_pattern(self) -> str:
        long = [piece for piece in self.ids if len(piece) > 1]
        if any(SPACE in piece.lstrip(SPACE) for piece in long):
            return r"(?s).+"
        joined = set("".join(long))
        alone = "".join(c for c in "\n\t\r" if c not in joined)
        rest = rf"[^{SPACE}{alone}]"
        letter = re.compile(LETTER)
        if not any(len({bool(letter.match(c)) for c in piece.lstrip(SPACE)}) > 1 for piece in long):
            rest = rf"(?:{LETTER}+|(?:(?!{LETTER}){rest})+)"
        else:
            rest += "+"
        return rf"[{SPACE}]*{rest}|[{SPACE}]+" + (f"|[{alone}]" if alone else "")

    def _merges(self, text: str) -> list[tuple[float, str, str]]:
        """Merges the characters of a piece, the best score first, leftmost among equals.

        Per merge its score with the first and the last symbol before it; at the end
        these two with the score NEVER.
        """
        scores, symbols, steps = self.scores, list(text), []
        while True:
            best, at = max(
                ((scores.get(symbols[i] + symbols[i + 1], NEVER), -i) for i in range(len(symbols) - 1)),
                default=(NEVER, 0),
            )
            steps.append((best, symbols[0], symbols[-1]))
            if best == NEVER:
                return steps
            symbols[-at : 2 - at] = [symbols[-at] + symbols[1 - at]]

    def _stay(self, pair: tuple[int, int]) -> bool:
        """Whether no merge across the two tokens comes before those that make them."""
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        left, right, scores = self.made[pair[0]], self.made[pair[1]], self.scores
        i = j = 0
        while True:
            (own, _, edge), (other, lead, _) = left[i], right[j]
            across = scores.get(edge + lead, NEVER)
            if across > own and across >= other:
                self.fits[pair] = False
                return False
            if own == other == NEVER:
                self.fits[pair] = True
                return True
            if own >= other:
                i += 1
            else:
                j += 1

    def encode(self, text: str) -> list[int]:
        """Ids of a string in which spaces are marked already. Characters without a piece become bytes."""
        # last[i]: the last token of the first i + 1 characters; None for a character without a piece.
        last: list[int | None] = [None] * len(text)
        fits, done = self.fits, -1
        for at, (token, size) in self.automaton.iter(text):
            if at == done:
                continue
            before = last[at - size] if at >= size else None
            if before is not None:
                stays = fits.get((before, token))
                if not (self._stay((before, token)) if stays is None else stays):
                    continue
            last[at] = token
            done = at
        ids: list[int] = []
        at = len(text) - 1
        while at >= 0:
            token = last[at]
            if token is None:
                ids += [self.bytes[b] for b in reversed(text[at].encode("utf-8"))]
                at -= 1
            else:
                ids.append(token)
                at -= self.sizes[token]
        return ids[::-1]

    def strings(self, ids: list[int]) -> str:
        """The pieces of ids one after another, with spaces; bytes that are no character become U+FFFD."""
        shown, values = self.shown, self.values
        if values.keys().isdisjoint(ids):
            return "".join([shown.get(i, "") for i in ids])
        out, run = [], bytearray()
        for i in ids:
            if i in values:
                run.append(values[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(shown.get(i, ""))
        return "".join(out) + run.decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        """The text of an encoding: the space that was put before it is taken away."""
        return self.strings(ids).removeprefix(" ")


class PieceEncoder:
    """Whole texts: what stands between the places that no merge crosses is encoded once and looked up."""

    def __init__(self, path: str) -> None:
        self.model = PieceModel(path)
        self.known: Recent[str, str] = Recent(CHUNKS)
        #: Chunks whose ids decode to something else than the chunk.
        self.odd: dict[str, str] = {}

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Per text: decimal ids joined by a space, with the end id, and the decoded text."""
        model = self.model
        marked = [SPACE + text.replace(" ", SPACE) if text else "" for text in texts]
        parts = [model.cut.findall(text) for text in marked]
        new = self.known.missing(set().union(*parts))
        known, decimal = self.known.now, model.decimal
        for chunk in new:
            ids = model.encode(chunk)
            known[chunk] = " ".join([decimal[i] for i in ids])
            if (string := model.strings(ids)) != chunk.replace(SPACE, " "):
                self.odd[chunk] = string
        end = str(model.end)
        for text, pieces in zip(marked, parts, strict=True):
            if self.odd:
                text = "".join([self.odd.get(x, x) for x in pieces])
            decoded = text.replace(SPACE, " ").removeprefix(" ")
            yield " ".join([*map(known.__getitem__, pieces), end]), decoded


@lru_cache(maxsize=2)
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encode_pieces(df: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, ids, decoded): ids as an array with the end id, and the text they decode to.

    NULL counts as the empty text, whose only id is the end. Every row is encoded for
    itself, so repeated rows, ties, empty tables and other columns need no rule.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = _encoder(vocabulary)
        for rows, texts in slices(batches, "text", SLICE):
            found = list(encoder.encode([x.decode("utf-8") for x in texts]))
            yield {
                "doc": rows.column("doc"),
                "ids": [[int(i) for i in ids.split(" ")] for ids, _ in found],
                "decoded": [decoded for _, decoded in found],
            }

    return map_batches(_narrow(df, doc_id, text), run, f"doc {_kind(df, doc_id)}, ids array<int>, decoded string")


def piece_digests(df: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_tokens, ids_sha256, decoded_sha256): like encode_pieces, but for the digests alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = _encoder(vocabulary)
        for rows, texts in slices(batches, "text", SLICE):
            counts, ids_sha, decoded_sha = [], [], []
            for ids, decoded in encoder.encode([x.decode("utf-8") for x in texts]):
                counts.append(ids.count(" ") + 1)
                ids_sha.append(hashlib.sha256(ids.encode("ascii")).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
            yield {"doc": rows.column("doc"), "n_tokens": counts, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha}

    schema = f"doc {_kind(df, doc_id)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(_narrow(df, doc_id, text), run, schema)


def _narrow(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.selectExpr(f"`{doc_id}` AS doc", f"`{text}` AS text")


def _kind(df: DataFrame, doc_id: str) -> str:
    return df.schema[doc_id].dataType.simpleString()
