"""Text columns as numbers and vectors: cross-fitted target means, one-hot vectors, signed hashing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import Interaction, OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, melt, number
from ..functions.hashing import cell_text, uniform
from ..functions.lookup import lookup
from ..functions.storage import stored
from .features import HOT_SHARE, MISSING_CATEGORY, SMALL_VOCABULARY, SMALL_VOCABULARY_BYTES, UNSEEN, encode

# Folds and smoothing of target means, width of hashed vectors.
TARGET_FOLDS = 5
SMOOTHING = 10.0
HASH_WIDTH = 256


def category(name: str) -> Column:
    """The text of a cell; a missing one is a category of its own."""
    return F.coalesce(col(name), F.lit(MISSING_CATEGORY))


# --- target means ------------------------------------------------------------


@dataclass
class TargetMeans:
    """Per category of each column the target's sum and count, over all folds and in each."""

    columns: list[str]
    stats: DataFrame  # column, value, total, rows, totals array, counts array
    small: bool
    total: float
    rows: int
    totals: list[float]
    counts: list[int]
    keys: list[str]
    seed: int
    smoothing: float

    def prior(self, fold: int | None = None) -> float | None:
        """Mean target of the training rows, or of those outside a fold."""
        total, rows = self.total, self.rows
        if fold is not None:
            total, rows = total - self.totals[fold], rows - self.counts[fold]
        return total / rows if rows else None


def _fold(keys: Sequence[str], seed: int, folds: int) -> Column:
    return F.floor(uniform(keys, seed, "target fold") * folds).cast("int")


def fit_target_means(
    train: DataFrame,
    columns: Sequence[str],
    target: str,
    keys: Sequence[str],
    folds: int = TARGET_FOLDS,
    smoothing: float = SMOOTHING,
    seed: int = 42,
    small_rows: int | None = None,
) -> TargetMeans:
    """Sums of a numeric or boolean target per category and fold, in one pass over the training rows.

    A row's fold is the hash of its key, so it is the same when the rows are encoded.
    Rows without a target teach nothing.
    """
    if folds < 2:
        raise ValueError("cross-fitting needs two folds or more")
    boolean = train.schema[target].dataType.simpleString() == "boolean"
    y = col(target).cast("double") if boolean else number(train, target)
    rows = train.select(*[category(c).alias(c) for c in columns], y.alias("_y"), _fold(keys, seed, folds).alias("_fold"))
    rows = rows.where(F.col("_y").isNotNull())
    of_fold = [F.when(F.col("_fold") == f, F.col("_y")) for f in range(folds)]
    sums = [
        F.sum("_y").alias("total"),
        F.count("_y").alias("rows"),
        F.array(*[F.coalesce(F.sum(v), F.lit(0.0)) for v in of_fold]).alias("totals"),
        F.array(*[F.count(v) for v in of_fold]).alias("counts"),
    ]
    pairs = [F.struct(F.lit(c).alias("column"), col(c).alias("value")) for c in columns]
    stats = stored(melt(rows, pairs, ["_y", "_fold"]).groupBy("column", "value").agg(*sums))
    whole = rows.agg(*sums).first()
    found, size = stats.agg(F.count(F.lit(1)), F.sum(F.octet_length("value") + 16 * folds)).first()
    most = SMALL_VOCABULARY if small_rows is None else small_rows
    small = found <= most and (size or 0) <= SMALL_VOCABULARY_BYTES
    return TargetMeans(
        list(columns), stats, small, whole["total"] or 0.0, whole["rows"], list(whole["totals"]),
        list(whole["counts"]), list(keys), seed, smoothing,
    )


def target_encode(df: DataFrame, means: TargetMeans, learned: Column | None = None) -> DataFrame:
    """Replace each column by the smoothed mean target of its category; the overall mean for an unseen one.

    For rows that were learned from (``learned``; by default those with ``split = 'train'``
    where there is such a column) the sums of the row's own fold are left out, so no row
    sees its own target.
    """
    if learned is None:
        learned = F.col("split") == "train" if "split" in df.columns else F.lit(False)
    fold = F.when(learned, _fold(means.keys, means.seed, len(means.totals)))
    priors = F.array(*[F.lit(means.prior(f)).cast("double") for f in range(len(means.totals))])
    prior = F.coalesce(F.get(priors, F.col("_fold")), F.lit(means.prior()).cast("double"))
    out = df.withColumn("_fold", fold)
    cells = ["total", "rows", "totals", "counts"]
    for c in means.columns:
        table = means.stats.where(F.col("column") == c).select("value", *[F.col(x).alias(f"_{x}") for x in cells])
        hot = [] if means.small else table.where(F.col("_rows") >= HOT_SHARE * means.rows).collect()
        found = lookup(out, category(c), table, [f"_{x}" for x in cells], means.small, hot)
        own = lambda name: F.coalesce(F.get(F.col(name), F.col("_fold")), F.lit(0))
        total = F.coalesce(F.col("_total") - own("_totals"), F.lit(0.0))
        rows = F.coalesce(F.col("_rows") - own("_counts"), F.lit(0))
        mean = (total + F.lit(means.smoothing) * prior) / (rows + F.lit(means.smoothing))
        out = found.select(*[(mean if x == c else col(x)).alias(x) for x in out.columns])
    return out.drop("_fold")


# --- vectors -----------------------------------------------------------------


def _slots(df: DataFrame, sizes: Mapping[str, int]) -> PipelineModel | object:
    """One-hot vectors of the given sizes for whole numbers; a number of that size has no slot."""
    row = df.sparkSession.createDataFrame([tuple(float(n) for n in sizes.values())], [f"_c{i}" for i in range(len(sizes))])
    return OneHotEncoder(
        inputCols=row.columns, outputCols=[f"_v{i}" for i in range(len(sizes))], dropLast=True
    ).fit(row)


def _replace(df: DataFrame, vectors: DataFrame, names: Sequence[str]) -> DataFrame:
    """The vector columns ``_v0..`` in the place of the named columns."""
    at = {c: f"_v{i}" for i, c in enumerate(names)}
    return vectors.select(*[(F.col(at[c]) if c in at else col(c)).alias(c) for c in df.columns])


def one_hot(
    df: DataFrame, vocabulary: DataFrame, columns: Sequence[str], small: bool, drop_last: bool = False
) -> DataFrame:
    """Replace each text column by a sparse vector with a slot per training category.

    An unseen category has no slot set. With ``drop_last`` the last category has none
    either, so that the slots are not collinear with an intercept. The vocabulary may
    be of any size (``features.fit_vocabulary``).
    """
    counted = vocabulary.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per column
    size = {r["column"]: r["n"] - drop_last for r in counted}
    sizes = {c: max(size.get(c, 0), 1) for c in columns}
    coded = encode(df, vocabulary, columns, small)
    slot = lambda c: F.when((col(c) == UNSEEN) | (col(c) >= sizes[c]), F.lit(sizes[c])).otherwise(col(c))
    numbers = coded.withColumns({f"_c{i}": slot(c).cast("double") for i, c in enumerate(columns)})
    return _replace(df, _slots(df, sizes).transform(numbers), columns)


def hot_slot(name: str) -> Column:
    """The slot that is set in a one-hot vector; NULL if none is.

    It is read from the sparse vector, which has one entry however many slots there are.
    """
    return F.get(F.unwrap_udt(col(name)).getField("indices"), F.lit(0)).cast("bigint")


def hash_slot(name: str, value: Column, width: int) -> tuple[Column, Column]:
    """Slot and sign of a value: from the md5 of column name and value, each with its length."""
    digest = F.md5(F.concat(cell_text(F.lit(name)), cell_text(value)))
    slot = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % width
    sign = 1 - 2 * (F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") % 2)
    return slot, sign


def hash_encode(df: DataFrame, columns: Sequence[str], width: int = HASH_WIDTH) -> DataFrame:
    """Replace each text column by a sparse vector of ``width`` slots with 1 or -1 in the slot of its hash.

    Nothing is learned and nothing joined, so any number of categories will do; the
    sign lets categories that share a slot cancel out on average.
    """
    if width < 1:
        raise ValueError("width must be positive")
    slots = {c: hash_slot(c, category(c), width) for c in columns}
    numbers = df.withColumns(
        {f"_c{i}": slots[c][0].cast("double") for i, c in enumerate(columns)}
        | {f"_s{i}": slots[c][1].cast("double") for i, c in enumerate(columns)}
    )
    out = _slots(df, {c: width for c in columns}).transform(numbers)
    for i in range(len(columns)):
        signed = Interaction(inputCols=[f"_s{i}", f"_v{i}"], outputCol=f"_w{i}").transform(out)
        out = signed.drop(f"_v{i}").withColumnRenamed(f"_w{i}", f"_v{i}")
    return _replace(df, out, columns)
