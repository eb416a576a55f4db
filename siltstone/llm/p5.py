"""Queries of problem 5: documents packed into containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.packing import fill_report, pack_documents
from siltstone.session import table


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_specs"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(containers(spark, sf_dir), table(spark, sf_dir, "pack_specs"))


QUERIES = {"p5_containers": containers, "p5_fill_report": report}
SQL: dict[str, str] = {}
