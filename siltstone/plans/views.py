"""Inputs of the catalogue's queries, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.session import table

TOKENS = 16


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples: groups of eight, rewards by type."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.floor(F.col("event_id") / 8).alias("group_index"),
        F.floor(F.col("event_id") / 256).alias("rollout_id"),
        F.col("event_id").alias("sample_index"),
        F.when(kind == "purchase", 1.0).when(kind == "error", 0.0).otherwise(0.5).alias("reward"),
        (kind == "purchase").cast("int").alias("raw_reward"),
        (F.floor("value") + 1).alias("response_length"),
        F.when(kind == "error", "aborted").when(kind == "view", "truncated").otherwise("completed").alias("status"),
        kind.alias("event_type"),
        "user_id",
        "value",
        "ts",
    )


SAMPLES = """s AS (SELECT event_id // 8 AS group_index, event_id // 256 AS rollout_id, event_id AS sample_index,
CAST(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'error' THEN 0.0 ELSE 0.5 END AS DOUBLE) AS reward, CAST(event_type = 'purchase' AS INTEGER) AS raw_reward,
CAST(1 + floor(value) AS BIGINT) AS response_length, CASE event_type WHEN 'error' THEN 'aborted' WHEN 'view' THEN 'truncated' ELSE 'completed' END AS status,
event_type, user_id, value, ts FROM events)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of each user as a trajectory's turns."""
    w = Window.partitionBy("user_id").orderBy("sample_index")
    s = samples(spark, sf_dir).withColumn("turn_idx", (F.row_number().over(w) - 1).cast("bigint"))
    return s.withColumns({"removed": F.col("event_type") == "error", "speedup": F.col("value") / 100.0})


TURNS = """t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sample_index) - 1 AS turn_idx, event_type = 'error' AS removed, value / 100.0 AS speedup FROM s)"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen events in a row as one sequence of token columns."""
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.floor(F.col("event_id") / TOKENS).alias("seq"),
        F.struct(
            F.col("event_id").alias("at"),
            (-F.col("value") / 500.0).alias("old"),
            (-F.col("value") / 490.0).alias("new"),
            (-F.col("value") / 505.0).alias("base"),
            F.when(F.col("event_type") == "error", 0).otherwise(1).alias("mask"),
            (F.col("value") / 1000.0).alias("val"),
            (F.pmod("event_id", F.lit(7)) / 7.0 - 0.4).alias("adv"),
        ).alias("x"),
    )
    packed = rows.groupBy("seq").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return packed.select("seq", *[F.col(f"x.{c}").alias(c) for c in ("old", "new", "base", "mask", "val", "adv")])


ROWS = """r AS (SELECT event_id // 16 AS seq, event_id % 16 AS pos, -value / 500.0 AS old, -value / 490.0 AS new, -value / 505.0 AS base,
CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS mask, value / 1000.0 AS val, (event_id % 7) / 7.0 - 0.4 AS adv FROM events)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event up to the same user's next one; every third is a child of the span before it."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("start", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    n = e.withColumns({"end": F.lead("start").over(w), "before": F.lag("event_id").over(w)})
    return n.select(F.col("user_id").alias("trace"), F.col("event_id").alias("span"), F.when(F.pmod("event_id", F.lit(3)) == 0, F.col("before")).alias("parent"), F.col("event_type").alias("name"), "start", "end", "value")


SPANS = """p AS (SELECT user_id AS trace, event_id AS span, CASE WHEN event_id % 3 = 0 THEN lag(event_id) OVER w END AS parent, event_type AS name,
epoch_us(ts) / 1e6 AS start, lead(epoch_us(ts) / 1e6) OVER w AS "end", value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as busy intervals of their value in seconds, on one stream per type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("stream"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("start"), F.col("value").alias("dur"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + F.col("value")).alias("end"), "user_id")


INTERVALS = """i AS (SELECT event_type AS stream, event_id AS seq, epoch_us(ts) / 1e6 AS start, value AS dur, epoch_us(ts) / 1e6 + value AS "end", user_id FROM events)"""
