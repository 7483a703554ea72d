"""Ranked lexical search: documents as impact vectors, in buckets of their length.

A document's vector has a coordinate for each of its terms that some item asks for.
Its length (Euclidean norm) bounds its score for any item by Cauchy and Schwarz, so
documents are dealt into buckets from the longest vector to the shortest. Buckets
are searched in waves, each several times as large as the one before; what a wave
finds raises the score an item's result must reach, and a bucket whose length times
the item's length stays below it is not looked at.

Inside a bucket an item's terms are taken by the most they can add there. As soon
as the rest cannot reach the score needed, neither by the largest coordinates of the
bucket nor by the lengths of what is left, only documents that hold one of the terms
taken can qualify. Each of these is bounded by its own coordinates so far and the
length of its remainder; the survivors are scored in whole numbers.

A bucket holds a bounded number of coordinates, and a task keeps so many documents
per item as are asked for, however many documents share a length or a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabassay.llm.shared import discard, map_batches, slices, written

#: (item, term) pairs that are searched for together, in one reading of the documents.
BLOCK_TERMS = 200_000
#: Cost of a bucket: its coordinates, and so many more for each document.
BUCKET_COST = 4_000_000
ROW_COST = 128
#: Steps of length per doubling in which documents are counted.
STEPS = 32
#: A wave has so many times the buckets of all before it.
WAVE = 8
#: Added to bounds in floating point, so that rounding never loses a document.
SLACK = 1 + 1e-9

#: Letters, digits and other characters stay, A to Z in lower case; the rest separates.
_TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Bytes of a text that are split at once.
PIECE = 1_000_000


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of a bounded size."""
    text = text.translate(_TERMS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _occurrences(vocabulary: dict[bytes, int]) -> Callable:
    """Per document: how many terms it has, and the numbers and counts of those that items ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for rows, texts in slices(batches, "text"):
            sizes, terms, counts = [], [], []
            for text in texts:
                found: Counter = Counter()
                for words in terms_of(text):
                    found.update(words)
                sizes.append(found.total())
                here = [(vocabulary[t], n) for t, n in found.items() if t in vocabulary]
                terms.append([t for t, _ in here])
                counts.append([n for _, n in here])
            yield {"doc": rows.column("doc"), "n": sizes, "term": terms, "tf": counts}

    return run


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column one after another, and the row of each."""
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size)), size)


def _impacts(documents: int, length: int) -> Callable:
    """The coordinates of each document in whole numbers, its length, and the step of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for rows in batches:
            sizes = rows.column("n").to_pylist()
            scale = np.array([50 + 50 * n * documents // length for n in sizes], np.int64)
            tf, row = _lists(rows.column("tf"))
            tf = tf.astype(np.int64)
            x = 1_000_000_000 * tf // (1000 * tf + 20 * scale[row])
            norm = np.sqrt(np.bincount(row, x.astype(float) ** 2, len(rows)))
            step = np.floor(STEPS * np.log2(np.maximum(norm, 1))).astype(np.int32)
            begins = np.searchsorted(row, np.arange(len(rows) + 1)).astype(np.int32)
            yield {
                "doc": rows.column("doc"), "term": rows.column("term"), "norm": norm, "step": step,
                "x": pa.ListArray.from_arrays(begins, x.astype(np.int32)),
            }

    return run


class Bucket:
    """Some documents, with their coordinates by term."""

    def __init__(self, rows: pa.RecordBatch) -> None:
        # Rows in the order of their ids: equal scores are ranked by it.
        order = pc.sort_indices(rows.column("doc"), null_placement="at_end")
        rows = rows.take(order)
        self.docs = rows.column("doc")
        self.norm = rows.column("norm").to_numpy()
        self.longest = float(self.norm.max(initial=0))
        term, row = _lists(rows.column("term"))
        x = _lists(rows.column("x"))[0].astype(np.int64)
        by_term = np.argsort(term, kind="stable")
        self.row, self.x = row[by_term], x[by_term]
        own, first = np.unique(term[by_term], return_index=True)
        last = np.append(first[1:], len(by_term))
        most = np.maximum.reduceat(self.x, first) if len(own) else first
        #: Of each term: where its coordinates begin and end, and the largest.
        self.places = dict(zip(own.tolist(), zip(first.tolist(), last.tolist(), most.tolist(), strict=True), strict=True))

    def search(
        self, terms: list[int], weights: list[int], least: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """Rows that score `least` or more for an item, and their scores."""
        held = [
            (w * self.places[t][2], w, *self.places[t][:2])
            for t, w in zip(terms, weights, strict=True) if w and t in self.places
        ]
        held.sort(reverse=True)
        # What the terms from the k-th on can add: by the largest coordinates, and by lengths.
        rest = np.append(np.cumsum([h[0] for h in held][::-1])[::-1], 0)
        length = np.sqrt(np.append(np.cumsum([float(h[1]) ** 2 for h in held][::-1])[::-1], 0))
        open_to = np.minimum(rest, length * self.longest * SLACK) >= least
        k = int(np.flatnonzero(open_to)[-1]) + 1 if open_to.any() else 0
        none = np.zeros(0, np.int64)
        if not k:
            return none, none
        k = min(k, len(held))
        score = np.zeros(len(self.norm), np.int64)
        used = np.zeros(len(self.norm))
        for _, w, a, b in held[:k]:
            score[self.row[a:b]] += w * self.x[a:b]
            used[self.row[a:b]] += self.x[a:b].astype(float) ** 2
        rows = np.flatnonzero(score)
        if k < len(held):
            left = np.sqrt(np.maximum(self.norm[rows] ** 2 * SLACK - used[rows], 0))
            rows = rows[score[rows] + np.minimum(rest[k], length[k] * left * SLACK) >= least]
            for _, w, a, b in held[k:]:
                at = np.minimum(np.searchsorted(self.row[a:b], rows), b - a - 1) + a
                hit = self.row[at] == rows
                score[rows[hit]] += w * self.x[at[hit]]
        rows = rows[score[rows] >= least]
        return rows, score[rows]


def _search(items: list[tuple[list[int], list[int]]], least: list[int], top: int) -> Callable:
    """The best documents of each item in the buckets of a task, if they score what is needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        need = list(least)
        length = [math.sqrt(sum(float(w) ** 2 for w in weights)) for _, weights in items]
        best: list[tuple[np.ndarray, pa.Array] | None] = [None] * len(items)
        for rows in batches:
            bucket = Bucket(rows)
            for i, (terms, weights) in enumerate(items):
                if length[i] * bucket.longest * SLACK < need[i]:
                    continue
                found, scores = bucket.search(terms, weights, need[i])
                if not len(found):
                    continue
                # Rows are in the order of ids, so a stable sort by score keeps the first of equal ones.
                order = np.argsort(-scores, kind="stable")[:top]
                docs, scores = bucket.docs.take(pa.array(found[order])), scores[order]
                if best[i] is not None:
                    table = pa.table({"score": np.append(best[i][0], scores), "doc": pa.concat_arrays([best[i][1], docs])})
                    order = pc.sort_indices(
                        table, [("score", "descending"), ("doc", "ascending")], null_placement="at_end"
                    )[:top]
                    scores, docs = (c.combine_chunks() for c in table.take(order).columns)
                    scores = scores.to_numpy()
                best[i] = (scores, docs)
                if len(scores) == top:
                    need[i] = max(need[i], int(scores[-1]))
        for i, found in enumerate(best):
            if found is not None:
                yield {"item": [i] * len(found[0]), "doc": found[1], "score": found[0]}

    return run


def search(
    df: DataFrame, items: DataFrame, top: int = 50, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(item, rank, doc, score): the `top` documents of each item, the highest scores first.

    The score is BM25's in whole numbers: a term weighs floor(1000 ln((2N + 2)/(2df + 1))),
    and counts (10^9 tf) div (1000 tf + 20 m) with m = 50 + (50 n N) div L in a document
    of n terms. Each row of `df` is a document of its own, NULL text has no terms. Equal
    scores are ranked by id, NULL ids last; rows with one id and score in any order.
    Texts of one item id, NULL included, ask together, each term once; an item without
    terms or without documents has no rows, and empty tables give none.
    """
    spark = df.sparkSession
    narrow = df.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.regexp_extract_all(
        F.translate(F.col(item_text), upper, lower), F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)")
    )
    asked = written(
        items.select(F.col(item_id).alias("item"), F.explode(words).alias("term")).distinct(), "search-items"
    )
    pairs = asked.count()
    blocks = max(1, -(-pairs // BLOCK_TERMS))
    results = []
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        kind = asked.schema["item"].dataType.simpleString()
        results.append(_block(spark, narrow, kind, [(r["item"], r["term"]) for r in own], top))
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    discard(asked)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).select("item", "rank", "doc", "score")


def _block(spark: SparkSession, docs: DataFrame, item_kind: str, own: list[tuple], top: int) -> DataFrame:
    """Items whose terms fit in one vocabulary: (item, doc, score)."""
    kind = docs.schema["doc"].dataType.simpleString()
    terms = {t: i for i, t in enumerate(dict.fromkeys(t for _, t in own))}
    names = {x: i for i, x in enumerate(dict.fromkeys(x for x, _ in own))}
    vocabulary = {t.encode(): i for t, i in terms.items()}
    occurrences = map_batches(docs, _occurrences(vocabulary), f"doc {kind}, n long, term array<int>, tf array<int>")
    texts = written(occurrences, "search-texts")
    size = texts.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    documents, length = size["docs"], size["terms"] or 1
    counted = texts.select(F.explode("term").alias("term")).groupBy("term").count().toPandas()
    df = np.zeros(len(terms), np.int64)
    df[counted["term"].to_numpy(np.int64)] = counted["count"].to_numpy(np.int64)
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in df]
    items: list[tuple[list[int], list[int]]] = [([], []) for _ in names]
    for item, term in own:
        ids, its = items[names[item]]
        ids.append(terms[term])
        its.append(weights[terms[term]])

    impacts = written(
        map_batches(
            texts.filter(F.size("term") > 0), _impacts(documents, length),
            f"doc {kind}, term array<int>, x array<int>, norm double, step int",
        ),
        "search-impacts",
    )
    discard(texts)
    buckets, count = _buckets(impacts)
    discard(impacts)
    table = None
    done, least = 0, [1] * len(items)
    lengths = [math.sqrt(sum(float(w) ** 2 for w in weights)) for _, weights in items]
    while done < count:
        end = min(count, max(1, (WAVE + 1) * done))
        # No item can use shorter vectors than these: files of only such are not read.
        shortest = min((n / (q * SLACK) for n, q in zip(least, lengths, strict=True) if q), default=math.inf)
        within = (F.col("bucket") >= done) & (F.col("bucket") < end) & (F.col("norm") >= shortest)
        wave = buckets.filter(within).drop("bucket", "step")
        found = map_batches(wave, _search(items, least, top), f"item int, doc {kind}, score long")
        found = found if table is None else table.unionByName(found)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
        best = written(
            found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).drop("rank"),
            "search-best",
        )
        if table is not None:
            discard(table)
        table, done = best, end
        full = table.groupBy("item").agg(F.min("score").alias("score"), F.count("*").alias("n"))
        for r in full.filter(F.col("n") == top).collect():
            least[r["item"]] = r["score"]
    named = spark.createDataFrame([(i, x) for x, i in names.items()], f"item int, name {item_kind}")
    if table is None:
        return named.limit(0).select(
            F.col("name").alias("item"), F.lit(None).cast(kind).alias("doc"), F.lit(None).cast("long").alias("score")
        )
    return table.join(F.broadcast(named), "item").select(F.col("name").alias("item"), "doc", "score")


def _buckets(impacts: DataFrame) -> tuple[DataFrame, int]:
    """The documents with the number of their bucket, longest vectors first, and how many buckets there are.

    Costs are counted per step of length. Short steps share a bucket; a step that costs
    more than a bucket, as when a third of all documents are copies, is dealt to several
    by hashes of ids.
    """
    cost = F.sum(F.size("term") + ROW_COST).alias("cost")
    steps = impacts.groupBy("step").agg(cost).orderBy(F.desc("step")).collect()
    plan, at, filled = [], 0, 0
    for r in steps:
        parts = -(-r["cost"] // BUCKET_COST)
        if filled and (parts > 1 or filled + r["cost"] > BUCKET_COST):
            at, filled = at + 1, 0
        plan.append((r["step"], at, parts))
        filled += r["cost"]
        if parts > 1:
            at, filled = at + parts, 0
    count = at + (filled > 0)
    table = impacts.sparkSession.createDataFrame(plan, "step int, first long, parts long")
    share = F.pmod(F.xxhash64("doc", "norm", F.monotonically_increasing_id()), F.col("parts"))
    placed = impacts.join(F.broadcast(table), "step").withColumn("bucket", (F.col("first") + share).cast("int"))
    dealt = placed.drop("first", "parts").repartitionById(max(count, 1), F.col("bucket"))
    return written(dealt, "search-buckets"), count
