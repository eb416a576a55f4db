"""Queries of problem 4: items of held-out evaluation sets in training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.leakage import leaks
from siltstone.session import table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("row_key"), "text")
    samples = table(spark, sf_dir, "samples").select(F.lit("samples").alias("origin"), F.col("sample_index").alias("row_key"), F.col("prompt").alias("text"))
    return documents.unionByName(samples)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_records(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def by_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation set: how many of its items leaked, and into how many records."""
    hits = found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    items = table(spark, sf_dir, "eval_items").select("item_id", "dataset_path").join(hits, "item_id", "left")
    sets = table(spark, sf_dir, "eval_datasets").select("dataset_name", "dataset_path")
    return (
        sets.join(items, "dataset_path", "left")
        .groupBy("dataset_name", "dataset_path")
        .agg(F.count("item_id").alias("n_items"), F.count("n").alias("n_leaked"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"))
    )


QUERIES = {"p4_found": found, "p4_by_set": by_set}
SQL: dict[str, str] = {}
