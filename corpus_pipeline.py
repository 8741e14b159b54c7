"""From raw documents to packed training sequences.

Every stage works on what the one before kept, and its decisions take effect: documents of
poor quality go, one document of each group of near-duplicates stays, documents contaminated by
the benchmark go, personal data is replaced, and what is left is tokenized and packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sittings.llm import classifier, decontaminate, minhash, packing, pii
from sittings.llm.tables import compact
from sittings.runtime import settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    return classifier.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _keyed(docs: DataFrame) -> DataFrame:
    """key, id, text and row: a document is a doc_id (or none) with a text."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(F.xxhash64(doc_id, text).alias("key"), doc_id.alias("id"), text.alias("text"), row)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each group.

    Different texts of one doc_id are documents of their own, as are texts without doc_id, which come
    before all others; texts of one doc_id are ordered by the hash of both. Of rows equal in
    both the least is taken.
    """
    rows = _keyed(docs)
    found = minhash.near_duplicates(rows.select(F.col("key").alias("doc_id"), "text"))
    found = settle(found.select(F.col("doc_id").alias("key"), "component_id").distinct(), "components")
    shared = found.groupBy("component_id").count().filter("count > 1").select("component_id")
    members = found.join(compact(shared, "shared"), "component_id", "left_semi")
    members = settle(members.join(rows.select("key", "id").distinct(), "key"), "members")
    least = members.groupBy("component_id").agg(F.min(F.struct("id", "key")).alias("least"))
    members = members.join(least, "component_id").filter("key <> least.key")
    gone = compact(members.select("key"), "near-duplicates")
    repeated = rows.groupBy("key").count().filter("count > 1").select("key")
    repeated = compact(repeated, "repeated")
    left = rows.select("key", "row").join(gone, "key", "left_anti")
    once = left.join(repeated, "key", "left_anti").select("row.*")
    again = left.join(repeated, "key", "left_semi").groupBy("key").agg(F.min("row").alias("row"))
    return once.unionByName(again.select("row.*"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates; a row goes by its own text, with doc_id or not."""
    rows = _keyed(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(rows.select(F.col("key").alias("doc_id"), "text"), benchmark)
    gone = found.filter("contaminated").select(F.col("doc_id").alias("key")).distinct()
    return rows.join(compact(gone, "contaminated"), "key", "left_anti").select("row.*")


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced."""
    return pii.replace(docs).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their ids, and their places in sequences."""
    return packing.pack_documents(docs, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_surrogates", pii_surrogates),
    ("best_fit_packing", best_fit_packing),
]

# Scores and packing are beyond SQL; tests/llm compares the stages with plain code.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        docs = settle(kept.select(*[F.col(f"`{c}`") for c in docs.columns]), name)
    return STAGES[-1][1](spark, docs, sf_dir)
