"""Keeping an intermediate table that several jobs read."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Persist a narrow table while the jobs of one operator read it.

    A result that is still lazy after the block computes the table once more.
    """
    df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def shared_folder(spark: SparkSession) -> str | None:
    """The folder the cluster names in ``spark.checkpoint.dir``, if it names one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/") if folder else None


def stored(df: DataFrame) -> DataFrame:
    """The table computed once for many jobs.

    With a shared folder it is written there as Parquet, which cuts the lineage;
    the files go when the Python process ends. Without one it is persisted, and a
    lost part is computed again: no operator here draws anything that differs on a
    second run.
    """
    folder = shared_folder(df.sparkSession)
    if folder is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{folder}/tabassay-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the session may have ended before
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def prepared(df: DataFrame) -> DataFrame:
    """A table stored for many passes; one in fewer partitions than cores is spread over them.

    A table read from one small file is the case in mind. A large table has
    partitions enough and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return stored(df.repartition(cores) if df.rdd.getNumPartitions() < cores else df)
