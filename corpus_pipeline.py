"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before kept, with the columns of `documents`; the
last one returns the pieces of the sequences. Between stages the rows are written
to the shared folder, so a lost executor costs no more than its own stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabassay.llm.line_dedup import remove_lines
from tabassay.llm.ngram_join import near_duplicates
from tabassay.llm.packing import pack_documents
from tabassay.llm.quality_rules import judge
from tabassay.llm.repeated_bytes import remove_repeats
from tabassay.llm.shared import collected, discard, documents, drop, same, written

#: Tables of the stage before, which its rows were read from until they were written.
_left: dict[str, SparkSession] = {}


def stage(function: Callable) -> Callable:
    """A stage begins when the rows of the one before have been written: what that one left can go."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(_left)
        with collected(_left):
            return function(spark, docs, sf_dir)

    return run_stage


def _measured(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the documents, with the length of the text as it is now."""
    if "n_chars" in columns:
        size = F.char_length(F.coalesce("text", F.lit(""))).cast(df.schema["n_chars"].dataType)
        df = df.withColumn("n_chars", size)
    return df.select(*columns)


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the fences of their language and source reject go."""
    judged = judge(docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns}),
                   text="in_text", lang="in_lang", source="in_source", carry=[f"in_{c}" for c in docs.columns])
    kept = judged.filter("kept").select(*(f"in_{c}" for c in docs.columns))
    return kept.withColumnsRenamed({f"in_{c}": c for c in docs.columns})


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are similar to an earlier line of the corpus are cut out, short ones if they repeat it."""
    return _measured(remove_lines(docs, short=True), docs.columns)


@stage
def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id stays."""
    found = near_duplicates(docs)
    stay = found.filter(same(F.col("doc"), F.col("component"))).select(F.col("doc").alias("_doc")).distinct()
    return docs.join(stay, same(F.col("doc_id"), F.col("_doc")), "left_semi")


@stage
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that stand earlier in the corpus are cut out."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = remove_repeats(docs, carry=others).withColumnRenamed("doc", "doc_id")
    return _measured(cut, docs.columns)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of token sequences."""
    packed = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.withColumnRenamed("doc", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

#: The stages from the third on cannot be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, function in STAGES[:-1]:
        docs = written(function(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    packed = STAGES[-1][1](spark, docs, sf_dir)
    _left.clear()  # what the result has yet to read stays until the process ends
    return packed
