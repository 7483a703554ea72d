"""One query per operator over its whole table, and the same result in DuckDB SQL where it has one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabassay.llm.block_naming import exact_groups
from tabassay.llm.cotraining import score, train
from tabassay.llm.impact_search import search
from tabassay.llm.language_mixture import held_out_identify
from tabassay.llm.line_dedup import remove_lines
from tabassay.llm.ngram_join import near_duplicates
from tabassay.llm.packing import pack_documents
from tabassay.llm.piece_table import piece_digests
from tabassay.llm.quality_rules import judge
from tabassay.llm.repeated_bytes import remove_repeats
from tabassay.llm.shared import documents, table
from tabassay.llm.source_audit import audit
from tabassay.llm.template_extract import main_text
from tabassay.llm.trie_bpe import encode_digests

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[function.__name__] = function
    return function


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(documents(spark, sf_dir))
    return groups.withColumnsRenamed({"doc": "doc_id", "keep": "keep_id", "sha256": "text_sha256"})


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(documents(spark, sf_dir), carry=["doc_id"])
    return judged.drop("n_lines")


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.withColumnRenamed("doc", "doc_id")


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = encode_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return digests.withColumnRenamed("doc", "doc_id")


@query
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.withColumnsRenamed({"doc": "doc_id", "component": "component_id"})


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_lines(documents(spark, sf_dir).select("doc_id", "text"), short=True)
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return cleaned.select(
        "doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), digest.alias("kept_sha256")
    )


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(documents(spark, sf_dir))
    return cut.select(
        F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = held_out_identify(documents(spark, sf_dir))
    return judged.select(
        F.col("doc").alias("doc_id"), "held_out", "lang_pred", "score", "languages", "proportions"
    )


@query
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


@query
def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.withColumnRenamed("doc", "doc_id").withColumn("kept", F.col("score") >= 0.5)


@query
def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = piece_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return digests.withColumnRenamed("doc", "doc_id")


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"doc": "doc_id", "item": "item_id"})
