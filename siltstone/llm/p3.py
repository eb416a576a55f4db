"""Queries of problem 3: conversations rebuilt from message rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.conversations import rebuild
from siltstone.session import table


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuild(spark, f"{sf_dir}/message_rows.parquet").select("sample_index", "turn_no", "message_id")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intact conversations with roles and texts."""
    turns = rebuild(spark, f"{sf_dir}/message_rows.parquet")
    texts = table(spark, sf_dir, "message_rows").where("sample_index IS NOT NULL").groupBy("message_id").agg(F.max("message_content").alias("content"))
    return turns.join(texts, "message_id")


QUERIES = {"p3_found": found, "p3_transcripts": transcripts}
SQL: dict[str, str] = {}
