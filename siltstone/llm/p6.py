"""Queries of problem 6: mixtures of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.mixing import mix
from siltstone.session import table


def draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


QUERIES = {"p6_mixtures": draw, "p6_shares": report}
SQL: dict[str, str] = {}
