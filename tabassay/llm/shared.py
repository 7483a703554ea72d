"""Tables that later jobs read again, and small helpers that every operator uses."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once by numpy, so that its temporary arrays stay small enough to use their memory again.
SLICE_BYTES = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of this machine only where a local session has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(spark, "_local_checkpoints"):
        spark._local_checkpoints = tempfile.mkdtemp(prefix="run-llm-")
    return f"file://{spark._local_checkpoints}"


#: Deletes the shuffle files of a job when it has ended, instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables written in the blocks of `scratch` and `collected` that are open, innermost last.
_open: list[dict[str, SparkSession]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """The table as Parquet in the shared folder: computed once, whatever is lost afterwards.

    The files go with `discard`, at the end of a `scratch` block, or when the Python
    process ends; the shuffle files of the job go as soon as it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    atexit.register(_remove, spark, path)
    if _open:
        _open[-1][path] = spark
    found = spark.read.schema(df.schema).parquet(path)
    found._tabassay_path = path
    return found


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables written in the block at its end, but for those given to the function it yields.

    These belong to the block around it. A table must not be read after the block
    unless it was kept, nor may a result that has yet to read it.
    """
    own: dict[str, SparkSession] = {}

    def keep(df: DataFrame) -> DataFrame:
        spark = own.pop(df._tabassay_path)
        if _open:
            outer = next(i for i, x in enumerate(_open) if x is own) - 1
            if outer >= 0:
                _open[outer][df._tabassay_path] = spark
        return df

    _open.append(own)
    try:
        yield keep
    finally:
        _open[:] = [x for x in _open if x is not own]
        for path, spark in own.items():
            _remove(spark, path)


@contextlib.contextmanager
def collected(into: dict[str, SparkSession]) -> Iterator[None]:
    """Notes the tables that are written in the block and left when it ends."""
    _open.append(into)
    try:
        yield
    finally:
        _open[:] = [x for x in _open if x is not into]


def drop(tables: dict[str, SparkSession]) -> None:
    """Deletes noted tables."""
    for path, spark in tables.items():
        _remove(spark, path)
    tables.clear()


def discard(*tables: DataFrame) -> None:
    """Deletes the files of written tables whose last reader has been written itself."""
    for df in tables:
        _remove(df.sparkSession, df._tabassay_path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


#: Bits of the sketch below, packed by 64: its size is the same for every table.
SKETCH_BITS = 25


def parted(
    df: DataFrame, keys: list[Column], wanted: DataFrame, wanted_keys: list[Column]
) -> tuple[DataFrame, DataFrame]:
    """The rows of `df` whose keys `wanted` has, with a few others, and all the rest.

    The hashes of the keys wanted are the bits of a sketch of bounded size, which is broadcast.
    """

    def spot(keys: list[Column]) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*keys), 64 - SKETCH_BITS)

    def bit(spot: str) -> Column:
        return F.col(spot).bitwiseAND(F.lit(63)).cast("int")

    set_ = wanted.select(spot(wanted_keys).alias("_wanted")).withColumn("_word", F.shiftright("_wanted", 6))
    sketch = set_.groupBy("_word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit("_wanted"))).alias("_bits"))
    spotted, word = df.withColumn("_spot", spot(keys)), F.shiftright("_spot", 6) == F.col("_word")
    met = spotted.join(F.broadcast(sketch), word).filter(F.getbit("_bits", bit("_spot")) == 1)
    rest = spotted.join(F.broadcast(sketch), word, "left").filter(F.coalesce(F.getbit("_bits", bit("_spot")), F.lit(0)) == 0)
    own = ("_spot", "_word", "_bits")
    return met.drop(*own), rest.drop(*own)


def perhaps_in(df: DataFrame, keys: list[Column], wanted: DataFrame, wanted_keys: list[Column]) -> DataFrame:
    """The rows of `df` whose keys `wanted` has, and a few others; a join of the two shuffles no more than these."""
    return parted(df, keys, wanted, wanted_keys)[0]


def same(left: Column, right: Column) -> Column:
    """Equality under which NULL equals NULL."""
    return left.eqNullSafe(right)


def slices(
    batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The rows in runs of about `most` bytes of the column, with its values as UTF-8 (NULL: empty).

    A row is never cut: a text longer than `most` is a run of its own.
    """
    for batch in batches:
        values = batch.column(column).cast(pa.binary())
        # Only a run's texts are copied, not those of the whole batch.
        for first, end in _runs(pc.fill_null(pc.binary_length(values), 0).to_pylist(), most):
            rows = end - first
            yield batch.slice(first, rows), [x or b"" for x in values.slice(first, rows).to_pylist()]


def runs_of_bytes(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The texts in runs of about `most` bytes."""
    return (texts[first:end] for first, end in _runs([len(x) for x in texts], most))


def _runs(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, length in enumerate(lengths):
        if size and size + length > most:
            yield first, i
            first, size = i, 0
        size += length + 1
    if first < len(lengths):
        yield first, len(lengths)


def row_hashes(ids: pa.Array) -> np.ndarray:
    """A hash of each id that depends on nothing else."""
    return np.array([zlib.crc32(str(x).encode()) for x in ids.to_pylist()], np.uint64)


def ship_package(spark: SparkSession) -> None:
    """Gives the Python workers this package, once per session: they may not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_has_tabassay", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="run-llm-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._has_tabassay = True


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """`function` turns an iterator of Arrow batches into dicts of columns; empty ones are left out."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship_package(df.sparkSession)
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in function(batches):
            arrays = [
                x.cast(field.type) if isinstance(x, pa.Array) else pa.array(x, field.type)
                for x, field in ((columns[f.name], f) for f in target)
            ]
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


class Recent[K, V]:
    """A memory with a bound: what was not asked for while `limit` new entries came is forgotten."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.now: dict[K, V] = {}
        self.before: dict[K, V] = {}

    def missing(self, keys: set[K]) -> set[K]:
        """The keys not remembered. All others are in `now` until the next call."""
        if len(self.now) > self.limit:
            self.before, self.now = self.now, {}
        rest = keys - self.now.keys()
        known = rest & self.before.keys()
        self.now.update((k, self.before[k]) for k in known)
        return rest - known


def crc_bucket(column: Column, parts: int) -> Column:
    return F.crc32(column.cast("string").cast("binary")) % parts
