"""Languages of a document as a mixture inferred by expectation-maximisation.

Every language has a distribution over n-grams, counted over all training rows. A
document's n-grams come from a mixture of languages whose proportions are
estimated by expectation-maximisation. Languages are then taken in the order of
their proportions, and the set with the best likelihood, less a penalty for each
further language, is the answer; its proportions are estimated anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabassay.llm.shared import crc_bucket, map_batches, slices
from tabassay.llm.shingles import mix

GRAM = 4
#: N-grams are hashed into 2^BITS cells: the model's size depends on the languages alone.
BITS = 16
SMOOTHING = 0.5
ROUNDS = 10
#: Overlapping n-grams repeat each other's evidence; the likelihood counts only one in so many.
OVERLAP = GRAM
#: Penalty of a further language, in units of log(n) / 2 as in the Bayesian information criterion.
PENALTY = 2.0
#: A language below this proportion of the first estimate is not tried.
LEAST_SHARE = 0.01
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
# ASCII characters that are no letters all count as a space.
_CELLS = np.arange(256, dtype=np.uint64)
_CELLS[[c for c in range(128) if not chr(c).isalpha()]] = 32


def gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, count) of the n-grams of each text in lower case, by row."""
    edge = b" " * (GRAM - 1)  # so that a single letter has n-grams
    lowered = [edge + x.decode("utf-8").lower().encode("utf-8") + edge for x in texts]
    data = _CELLS[np.frombuffer(b"".join(lowered), np.uint8)]
    sizes = np.array([len(x) for x in lowered])
    n = len(data) - GRAM + 1
    if n < 1:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    value = np.zeros(n, np.uint64)
    for k in range(GRAM):
        value = value << np.uint64(8) | data[k : n + k]
    row = np.repeat(np.arange(len(texts)), sizes)
    inside = row[:n] == row[GRAM - 1 :]
    # Runs of spaces say nothing about a language.
    inside &= value != np.uint64(0x20202020)
    cell = mix(value[inside]) >> np.uint64(64 - BITS)
    key, count = np.unique(row[:n][inside] << BITS | cell.astype(np.int64), return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), count


def _estimate(
    p: np.ndarray, row: np.ndarray, count: np.ndarray, share: np.ndarray, rounds: int
) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each text after some rounds, and the log-likelihood of those before the last one.

    `p` has the likelihoods of each text's n-grams, `row` names the text and never falls.
    """
    n = len(share)
    total = np.maximum(np.bincount(row, count, n), 1.0)[:, None]
    begins = np.searchsorted(row, np.arange(n))
    empty = np.append(begins[1:], len(row)) == begins
    for _ in range(rounds):
        joint = p * share[row]
        each = joint.sum(axis=1)
        joint *= (count / each)[:, None]
        sums = np.add.reduceat(np.concatenate([joint, np.zeros((1, joint.shape[1]))]), begins, axis=0)
        sums[empty] = 0
        share = sums / total
    return share, np.bincount(row, count * np.log(each), n)


class Languages:
    """Log-likelihoods of the cells in each language."""

    def __init__(self, names: list[str], counts: np.ndarray) -> None:
        self.names = names
        smoothed = counts + SMOOTHING
        self.likelihood = (smoothed / smoothed.sum(axis=0)).astype(np.float64)

    def infer(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, list[list[str]], list[list[float]]]:
        """Per text: main language, its proportion, all languages of the set and their proportions."""
        n, size = len(texts), len(self.names)
        row, cell, count = gram_counts(texts)
        has = np.zeros(n, bool)
        has[row] = True
        has &= np.array([bool(_LETTER.search(x.decode("utf-8"))) for x in texts], bool)
        if not size or not len(row):
            return [UNKNOWN] * n, np.zeros(n), [[] for _ in texts], [[] for _ in texts]
        total = np.maximum(np.bincount(row, count, n), 1.0)
        p = self.likelihood[cell]
        share, _ = _estimate(p, row, count, np.full((n, size), 1.0 / size), ROUNDS)
        order = np.argsort(-share, axis=1, kind="stable")
        result = np.zeros((n, size))
        result[np.arange(n), order[:, 0]] = 1.0
        # One language has nothing to estimate: its likelihood is a plain sum.
        best = np.bincount(row, count * np.log(p[np.arange(len(row)), order[row, 0]]), n) / OVERLAP
        best -= PENALTY * np.log(total) / 2
        growing = has.copy()
        for k in range(2, size + 1):
            # A language that has next to nothing of the mixture cannot pay for its penalty.
            growing &= np.take_along_axis(share, order[:, k - 1 : k], axis=1)[:, 0] >= LEAST_SHARE
            chosen = np.flatnonzero(growing)
            if not len(chosen):
                break
            inside = growing[row]
            place = np.searchsorted(chosen, row[inside])
            start = np.zeros((len(chosen), size))
            np.put_along_axis(start, order[chosen, :k], 1.0 / k, axis=1)
            proportions, fit = _estimate(p[inside], place, count[inside], start, ROUNDS)
            value = fit / OVERLAP - PENALTY * k * np.log(total[chosen]) / 2
            better = value > best[chosen]
            best[chosen[better]] = value[better]
            result[chosen[better]] = proportions[better]
            growing[chosen[~better]] = False
        order = np.argsort(-result, axis=1, kind="stable")
        names, score, sets, parts = [], np.zeros(n), [], []
        for i in range(n):
            if not has[i]:
                names.append(UNKNOWN)
                sets.append([])
                parts.append([])
                continue
            found = [j for j in order[i] if result[i, j] > 0]
            names.append(self.names[found[0]])
            score[i] = min(max(result[i, found[0]], 0.0), 1.0)
            sets.append([self.names[j] for j in found])
            parts.append([float(result[i, j]) for j in found])
        return names, score, sets, parts


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> Languages:
    """N-gram counts of every language over all rows that have one.

    Tasks add up their own rows; the driver gets a number per cell and language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        totals: dict[str, np.ndarray] = {}
        for rows, texts in slices(batches, "text"):
            names = rows.column("lang").to_pylist()
            row, cell, count = gram_counts(texts)
            known, code = np.unique(np.array(names), return_inverse=True)
            both = np.bincount((code[row] << BITS) | cell, count, len(known) << BITS).reshape(len(known), -1)
            for name, own in zip(known.tolist(), both, strict=True):
                totals[name] = totals.get(name, 0) + own
        for name, total in totals.items():
            found = np.flatnonzero(total)
            yield {"lang": [name] * len(found), "cell": found, "n": total[found].astype(np.int64)}

    rows = df.filter(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counted = map_batches(rows, run, "lang string, cell int, n long").groupBy("lang", "cell")
    found = counted.agg(F.sum("n").alias("n")).toPandas()
    names = sorted(found["lang"].unique())
    counts = np.zeros((1 << BITS, len(names)))
    code = {name: i for i, name in enumerate(names)}
    counts[found["cell"].to_numpy(np.int64), found["lang"].map(code).to_numpy(np.int64)] = found["n"]
    return Languages(names, counts)


def identify(df: DataFrame, model: Languages, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, lang_pred, score, languages, proportions): one row per row of `df`.

    A text without a letter, NULL included, is UNKNOWN with score 0, and so is
    every text if no language was learnt. Rows are judged for themselves; repeated
    rows get equal answers, and equal proportions are taken in the order of names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for rows, texts in slices(batches, "text"):
            names, score, sets, parts = model.infer(texts)
            yield {
                "doc": rows.column("doc"),
                "lang_pred": names,
                "score": score,
                "languages": pa.array(sets, pa.list_(pa.string())),
                "proportions": pa.array(parts, pa.list_(pa.float64())),
            }

    kind = df.schema[doc_id].dataType.simpleString()
    narrow = df.selectExpr(f"`{doc_id}` AS doc", f"`{text}` AS text")
    schema = f"doc {kind}, lang_pred string, score double, languages array<string>, proportions array<double>"
    return map_batches(narrow, run, schema)


def held_out_identify(df: DataFrame, folds: int = 5) -> DataFrame:
    """Learns from the rows whose id is not in the first fold and judges all."""
    held = F.coalesce(crc_bucket(F.col("doc_id"), folds) == 0, F.lit(False))
    model = learn(df.filter(~held))
    judged = identify(df, model)
    return judged.withColumn("held_out", F.coalesce(crc_bucket(F.col("doc"), folds) == 0, F.lit(False)))
