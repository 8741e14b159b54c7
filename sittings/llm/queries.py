"""The operators over the whole given tables, in the form the checks compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sittings.llm import (
    alignment,
    classifier,
    decontaminate,
    exact,
    license,
    line_quality,
    minhash,
    packing,
    pii,
    sharding,
    substring,
    suffix,
    trie,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op2_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = line_quality.quality(_table(spark, sf_dir, "documents"))
    return verdicts.drop("digest", "common_lines")


def op4_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(_table(spark, sf_dir, "documents"))
    digest = F.sha2("text", 256).alias("kept_sha256")
    return cut.select("doc_id", "n_words", "n_removed", digest)


def op5_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    cut = suffix.remove_repeated_bytes(docs, shorter=suffix.PASSAGE_BYTES)
    return cut.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.col("n_repeated").alias("n_repeated_256"),
        (F.size("repeats") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_license_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license.licenses(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_licenses"),
        F.array_join("found.license", ",").alias("licenses"),
        F.array_join(F.transform("found.common", lambda n: n.cast("string")), ",").alias("shingles"),
    )


def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return classifier.classify(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op8_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(_table(spark, sf_dir, "documents"), ["doc_id"])
    return placed.select("doc_id", "source", "slot", "shard")


def op9_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "n_near_items",
        "contaminated",
    )


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = pii.replace(_table(spark, sf_dir, "documents"))
    return replaced.select("doc_id", "n_entities", "text")


def op11_block_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(_table(spark, sf_dir, "conversations"))


def op12_counting_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def op13_end_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_bin_completion": op2_bin_completion,
    "op3_line_frequency": op3_line_frequency,
    "op4_seed_extend": op4_seed_extend,
    "op5_suffix_sort": op5_suffix_sort,
    "op6_license_bands": op6_license_bands,
    "op7_rule_ensemble": op7_rule_ensemble,
    "op8_lookup_sharding": op8_lookup_sharding,
    "op9_inverted_index": op9_inverted_index,
    "op10_surrogates": op10_surrogates,
    "op11_block_trie": op11_block_trie,
    "op12_counting_filters": op12_counting_filters,
    "op13_end_alignment": op13_end_alignment,
}
