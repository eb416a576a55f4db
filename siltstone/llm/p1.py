"""Queries of problem 1: broken prompt and response pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.responses import defects
from siltstone.session import table


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects(table(spark, sf_dir, "samples"))


def by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects against the status that the samples claim."""
    samples = table(spark, sf_dir, "samples").groupBy("sample_index").agg(F.min("status").alias("status"))
    marked = samples.join(found(spark, sf_dir), "sample_index", "left")
    return marked.groupBy("status", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p1_found": found, "p1_by_status": by_status}
SQL: dict[str, str] = {}
