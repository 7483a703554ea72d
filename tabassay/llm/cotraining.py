"""Document quality by co-training two classifiers that see different things.

One classifier sees the text, the other what is known about the document besides:
language, source and length. Both learn from the labelled rows; then, in rounds,
each labels the unlabelled documents it is most sure of, and the other one learns
from them too. In the end both are calibrated on labelled rows that neither has
learnt from, and every document gets the two calibrated scores and their
combination.

Every unlabelled row takes part. What a row was told in earlier rounds follows from
its features and those rounds' weights and limits, so tasks keep nothing: they
count the surest rows in histograms, which give the next limits, and add up
gradients and curvatures, which give the next weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabassay.llm.shared import map_batches, same, slices, written
from tabassay.llm.shingles import mix, words_of

#: Labelled rows which the classifiers learn from at most.
LABELLED_ROWS = 8_000
#: Rounds, the share of the pool that each classifier may label per round, and how sure it must be.
ROUNDS = 4
SHARE = 0.05
SURE = 0.9
#: One labelled row in so many is kept for the calibration.
CALIBRATION = 4
WORD_CELLS = 256
FORM_CELLS = 7
META_CELLS = 128
#: Cells of the histograms of scores, and of the hashes by which rows of one cell are told apart.
SCORE_CELLS = 4096
HASH_CELLS = 4096
#: Newton steps of a fit at most, and the change that ends it.
STEPS = 8
STILL = 1e-4

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>!=~^_@{}[]\\"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True


def text_features(texts: list[bytes]) -> np.ndarray:
    """Shares of hashed words and a few measures of form; all zero for a text without words."""
    n = len(texts)
    words = words_of(texts)
    count = np.maximum(np.bincount(words.row, minlength=n), 1)
    cell = (words.hash >> np.uint64(56)).astype(np.int64)
    shares = np.bincount(words.row * WORD_CELLS + cell, minlength=n * WORD_CELLS).reshape(n, WORD_CELLS)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])[:-1]])
    size = np.maximum(np.array([len(x) for x in texts]), 1)
    share = lambda flags: np.add.reduceat(flags.astype(np.int64), begins) / size
    again = np.zeros(len(words.hash), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
    repeated = np.bincount(words.row, again, n) / count
    letters = 1 - share(_SYMBOLS[raw]) - share(raw <= 32)
    form = [
        np.sqrt(share(_SYMBOLS[raw])),
        share(_UPPER[raw]),
        share(_DIGITS[raw]),
        share(raw == 10) * 10,
        letters,
        repeated,
        np.minimum(size / count, 40) / 10,
    ]
    return np.hstack([np.sqrt(shares / count[:, None]), np.stack(form, axis=1)])


def meta_features(langs: list, sources: list, sizes: list) -> np.ndarray:
    """One-hot cells for language, source, both together and the size's power of two; NULL is a value."""
    out = np.zeros((len(langs), META_CELLS))
    for i, (lang, source, size) in enumerate(zip(langs, sources, sizes, strict=True)):
        length = "null" if size is None else str(max(int(size), 0).bit_length())
        for k, value in enumerate((lang, source, f"{lang}/{source}", length)):
            out[i, zlib.crc32(f"{k}:{value}".encode()) % META_CELLS] = 1
    return out


@dataclass
class Logistic:
    """Regularised logistic regression by Newton steps."""

    strength: float = 1.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        x = np.hstack([x, np.ones((len(x), 1))])
        ridge = np.full(x.shape[1], self.strength)
        ridge[-1] = 1e-3
        w = np.zeros(x.shape[1])
        for _ in range(STEPS):
            sums = newton_sums(x, y, w)
            step = np.linalg.solve(sums[:, :-1] + np.diag(ridge), sums[:, -1] - ridge * w)
            w += step
            if np.abs(step).max() < STILL:
                break
        self.weights = w
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)


def newton_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The curvature, and in the last column the gradient, of the rows' likelihood; sums of rows add up."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    curve = p * (1 - p) + 1e-6
    return np.hstack([(x * curve[:, None]).T @ x, (x.T @ (y - p))[:, None]])


def _probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-logit))


@dataclass
class Pair:
    """The two classifiers, their calibrations, and the labels' own odds."""

    views: tuple[Logistic, Logistic]
    calibration: tuple[Logistic, Logistic]
    prior: float
    exchanged: list[tuple[int, int]]

    def scores(self, features: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of good quality of either view, and of both together."""
        logits = [
            c.logit(v.logit(x)[:, None]) for v, c, x in zip(self.views, self.calibration, features, strict=True)
        ]
        # Given the quality the views count as independent, so their odds multiply.
        both = np.clip(logits[0] + logits[1] - self.prior, -30, 30)
        return _probability(logits[0]), _probability(logits[1]), _probability(both)


@dataclass(frozen=True)
class Turn:
    """A round: the classifiers that told, and per view and label the limit from which they did.

    A limit is a cell of the score and a cell of the hash: rows in higher cells of the
    score are told, and of the cell itself those in lower cells of the hash.
    """

    views: tuple[Logistic, Logistic]
    limits: dict[tuple[int, int], tuple[int, int]]


def _score_cells(logit: np.ndarray, label: int) -> np.ndarray:
    """Cells of how sure a row has the label, -1 below SURE."""
    least = np.log(SURE / (1 - SURE))
    sure = (logit if label else -logit) - least
    cell = np.minimum(sure / (30 - least) * SCORE_CELLS, SCORE_CELLS - 1)
    return np.where(sure >= 0, cell, -1).astype(np.int64)


def _hash_cells(place: np.ndarray) -> np.ndarray:
    return (mix(place.view(np.uint64)) % np.uint64(HASH_CELLS)).astype(np.int64)


def _told(turns: list[Turn], x: tuple[np.ndarray, np.ndarray], place: np.ndarray) -> np.ndarray:
    """The label that each view (first axis) was told of each row, -1 for none."""
    given = np.full((2, len(place)), -1)
    for turn in turns:
        for v in (0, 1):
            logit = turn.views[v].logit(x[v])
            free = given[1 - v] < 0
            for label in (1, 0):
                edge, below = turn.limits[v, label]
                cell = _score_cells(logit, label)
                given[1 - v][free & ((cell > edge) | ((cell == edge) & (_hash_cells(place) < below)))] = label
    return given


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[np.ndarray, np.ndarray], np.ndarray]]:
    """Features of both views, and hashes, of rows of `_features`."""
    for batch in batches:
        if batch.num_rows:
            yield _arrays(batch), batch.column("place").to_numpy(zero_copy_only=False).astype(np.int64)


def _arrays(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    words, meta = (
        np.frombuffer(b"".join(rows.column(c).to_pylist()), np.float32).astype(float).reshape(rows.num_rows, n)
        for c, n in (("words", WORD_CELLS + 7), ("meta", META_CELLS))
    )
    return words, meta


def _histogram(
    pool: DataFrame, turns: list[Turn], views: tuple[Logistic, Logistic], within: dict | None = None
) -> dict[tuple[int, int], np.ndarray]:
    """Per view and label, how many rows not yet told of fall into each cell of the score.

    With `within`, a cell of the score per view and label: into each cell of the hash
    in that one.
    """
    size = SCORE_CELLS if within is None else HASH_CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros((2, 2, size), np.int64)
        for x, place in _rows(batches):
            given = _told(turns, x, place)
            for v in (0, 1):
                free = given[1 - v] < 0
                logit = views[v].logit(x[v])
                for label in (0, 1):
                    cell = _score_cells(logit, label)
                    if within is None:
                        cell = cell[free & (cell >= 0)]
                    else:
                        cell = _hash_cells(place)[free & (cell == within.get((v, label), -2))]
                    total[v, label] += np.bincount(cell, minlength=size)
        view, label, cell = np.nonzero(total)
        yield {"view": view, "label": label, "cell": cell, "n": total[view, label, cell]}

    counted = map_batches(pool, run, "view int, label int, cell int, n long").groupBy("view", "label", "cell")
    found = {(v, label): np.zeros(size, np.int64) for v in (0, 1) for label in (0, 1)}
    for row in counted.agg(F.sum("n").alias("n")).toPandas().itertuples():
        found[row.view, row.label][row.cell] = row.n
    return found


def _turn(pool: DataFrame, rows: int, rate: float, turns: list[Turn], views: tuple[Logistic, Logistic]) -> Turn:
    """Limits so that each view tells its share of the pool's rows, the surest first."""
    quota = max(int(SHARE * rows), 1)
    limits, edges, rest = {}, {}, {}
    for key, counts in _histogram(pool, turns, views).items():
        most = max(round(quota * (rate if key[1] else 1 - rate)), 1)
        above = np.cumsum(counts[::-1])[::-1]
        if above[0] <= most:
            limits[key] = (0, HASH_CELLS)
            continue
        # The highest cell that does not fit any more is taken in part.
        edge = int(np.flatnonzero(above > most)[-1])
        edges[key], rest[key] = edge, most - int(above[edge] - counts[edge])
    if edges:
        hashed = _histogram(pool, turns, views, edges)
        for key, edge in edges.items():
            limits[key] = (edge, int((np.cumsum(hashed[key]) <= rest[key]).sum()))
    return Turn(views, limits)


def _pool_sums(
    pool: DataFrame, turns: list[Turn], weights: list[np.ndarray]
) -> tuple[list[np.ndarray], tuple[int, int]]:
    """`newton_sums` of either view over the rows it was told of, and how many those are."""
    sizes = [len(w) for w in weights]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = [np.zeros((n, n + 1)) for n in sizes]
        told = [0, 0]
        for x, place in _rows(batches):
            given = _told(turns, x, place)
            for v in (0, 1):
                has = given[v] >= 0
                if has.any():
                    own = np.hstack([x[v][has], np.ones((int(has.sum()), 1))])
                    total[v] += newton_sums(own, given[v][has], weights[v])
                    told[v] += int(has.sum())
        part = TaskContext.get().partitionId()
        for v in (0, 1):
            if told[v]:
                n = sizes[v]
                yield {
                    "view": [v] * n, "line": np.arange(n), "part": [part] * n, "told": [told[v]] * n,
                    "sums": [x.tobytes() for x in total[v]],
                }

    def add(rows: pa.Table) -> pa.Table:
        # In the order of the tasks, so that a sum is the same on every run.
        rows = rows.sort_by("part")
        sums = np.frombuffer(b"".join(rows["sums"].to_pylist())).reshape(rows.num_rows, -1)
        return pa.table({
            "view": rows["view"][:1], "line": rows["line"][:1], "told": pa.array([sum(rows["told"].to_pylist())]),
            "sums": pa.array([sums.sum(axis=0).tobytes()], pa.binary()),
        })

    each = map_batches(pool, run, "view int, line int, part int, told long, sums binary")
    found = each.groupBy("view", "line").applyInArrow(add, "view int, line int, told long, sums binary").toPandas()
    total = [np.zeros((n, n + 1)) for n in sizes]
    told = [0, 0]
    for row in found.itertuples():
        total[row.view][row.line] = np.frombuffer(row.sums)
        told[row.view] = row.told
    return total, (told[0], told[1])


def _fit(
    features: tuple[np.ndarray, np.ndarray], labels: np.ndarray, pool: DataFrame, turns: list[Turn]
) -> tuple[tuple[Logistic, Logistic], tuple[int, int]]:
    """Both views fitted to the labelled rows and what they were told, from the weights of the last round."""
    if not turns:
        return (Logistic().fit(features[0], labels), Logistic().fit(features[1], labels)), (0, 0)
    own = [np.hstack([x, np.ones((len(x), 1))]) for x in features]
    weights = [view.weights.copy() for view in turns[-1].views]
    told = (0, 0)
    for _ in range(STEPS):
        sums, told = _pool_sums(pool, turns, weights)
        moved = 0.0
        for v in (0, 1):
            ridge = np.full(len(weights[v]), Logistic.strength)
            ridge[-1] = 1e-3
            both = sums[v] + newton_sums(own[v], labels, weights[v])
            step = np.linalg.solve(both[:, :-1] + np.diag(ridge), both[:, -1] - ridge * weights[v])
            weights[v] = weights[v] + step
            moved = max(moved, float(np.abs(step).max()))
        if moved < STILL:
            break
    return (Logistic(weights=weights[0]), Logistic(weights=weights[1])), told


def cotrain(features: tuple[np.ndarray, np.ndarray], labels: np.ndarray, pool: DataFrame) -> Pair:
    """Learns from labelled rows (labels 0 and 1) in a fixed order and all rows of `pool`, as of `_features`."""
    held = np.arange(len(labels)) % CALIBRATION == 0
    if held.all() or len(set(labels[held])) < 2 or len(set(labels[~held])) < 2:
        held = np.zeros(len(labels), bool)  # too few labels: calibrate on what was learnt from
    learn = ~held
    check = held if held.any() else learn
    rate = min(max(float(labels[learn].mean()), 0.01), 0.99) if len(labels) else 0.5
    known = (features[0][learn], features[1][learn])
    rows = pool.count()
    turns: list[Turn] = []
    exchanged = []
    views, _ = _fit(known, labels[learn], pool, turns)
    for _ in range(ROUNDS if rows else 0):
        turns.append(_turn(pool, rows, rate, turns, views))
        views, told = _fit(known, labels[learn], pool, turns)
        exchanged.append((told[1], told[0]))
    calibration = tuple(
        Logistic(1e-2).fit(views[v].logit(features[v][check])[:, None], labels[check]) for v in (0, 1)
    )
    return Pair(views, calibration, float(np.log(rate / (1 - rate))), exchanged)


def _unlearned(y: np.ndarray) -> Pair:
    """A pair that knows the labels' rate only."""
    odds = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    views = tuple(Logistic(weights=np.zeros(n + 1)) for n in (WORD_CELLS + FORM_CELLS, META_CELLS))
    calibration = tuple(Logistic(weights=np.array([0.0, odds])) for _ in views)
    return Pair(views, calibration, odds, [])


def _features(df: DataFrame) -> DataFrame:
    """(id, place, words, meta): the features of (id, place, text, lang, source, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for rows, texts in slices(batches, "text"):
            meta = meta_features(*(rows.column(c).to_pylist() for c in ("lang", "source", "size")))
            yield {
                "id": rows.column("id"),
                "place": rows.column("place"),
                "words": [x.astype(np.float32).tobytes() for x in text_features(texts)],
                "meta": [x.astype(np.float32).tobytes() for x in meta],
            }

    kind = df.schema["id"].dataType.simpleString()
    return map_batches(df, run, f"id {kind}, place long, words binary, meta binary")


def train(
    df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality"
) -> Pair:
    """Fits the pair on at most LABELLED_ROWS labelled rows, those with the smallest hashes of their ids, and
    all unlabelled ones.

    A document with several labels takes the more frequent one, 1 if they are even;
    NULL labels do not count. Without labels of both kinds, or of an empty table, there
    is nothing to learn: then all rows score the labels' rate, with one label of each
    kind added, in both views. Labelled rows beyond LABELLED_ROWS are scored, but are
    neither labels nor part of the pool.
    """
    votes = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    votes = votes.groupBy(F.col(doc_id).alias("_id")).agg(
        (F.avg(F.col(label)) >= 0.5).cast("int").alias("label")
    )
    # Features are smaller than texts, so they are joined and kept.
    rows = _features(_view(df, doc_id, text).withColumn("place", F.xxhash64("id", "text")))
    rows = written(rows.join(votes, F.col("id") == F.col("_id"), "left").drop("_id"), "features")
    # Only ids are ordered; the rows of the chosen ones are fetched afterwards.
    chosen = rows.filter("label IS NOT NULL").select(F.col("id").alias("_id"), F.xxhash64("id").alias("order"))
    chosen = chosen.orderBy("order").limit(LABELLED_ROWS).distinct()
    found = rows.filter("label IS NOT NULL").join(F.broadcast(chosen), F.col("id") == F.col("_id"))
    found = found.select("order", "label", "words", "meta").toArrow().sort_by(
        [("order", "ascending"), ("words", "ascending"), ("meta", "ascending")]
    )
    y = found["label"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return _unlearned(y)
    return cotrain(_arrays(found), y, rows.filter("label IS NULL").select("place", "words", "meta"))


def _view(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(
        F.col(doc_id).alias("id"),
        F.col(text).alias("text"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.col("n_chars").cast("long").alias("size"),
    )


def score(df: DataFrame, pair: Pair, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, score_text, score_meta, score): one row per row of `df`, each judged for itself.

    NULL text counts as empty; NULL in language, source or size is a value of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for rows, texts in slices(batches, "text"):
            meta = meta_features(*(rows.column(c).to_pylist() for c in ("lang", "source", "size")))
            a, b, both = pair.scores((text_features(texts), meta))
            yield {"doc": rows.column("id"), "score_text": a, "score_meta": b, "score": both}

    kind = df.schema[doc_id].dataType.simpleString()
    return map_batches(
        _view(df, doc_id, text), run, f"doc {kind}, score_text double, score_meta double, score double"
    )
