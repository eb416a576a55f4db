"""Queries of problem 7: template residue and error pages among the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.templates import classified, residue
from siltstone.session import table


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "documents")).select("doc_id")


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without residue, per source."""
    documents = table(spark, sf_dir, "documents")
    clean = documents.select("doc_id", F.lower(F.trim("source")).alias("source")).join(residue(documents), "doc_id", "left")
    return clean.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.count("kind").alias("n_residue"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mined templates that aren't content, with the number of sentences each covers."""
    return classified(table(spark, sf_dir, "documents")).where("verdict <> 'content'").select("template", "verdict", "n")


QUERIES = {"p7_found": found, "p7_kept": kept, "p7_messages": messages}
SQL: dict[str, str] = {}
