"""Queries of problem 2: latency percentiles of replayed requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import percentiles as P
from siltstone.session import table

KEYS = ["model_name", "status_code"]
SETS = [["model_name"], ["status_code"], ["model_name", "status_code"]]


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.once(table(spark, sf_dir, "request_results"), ["replay_round", "line_number"], "ingested_at", ["model_name", "status_code", "latency_ms"])


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each round and all rounds merged from their states (``replay_round`` null), per model, status and both."""
    rounds = P.state(_requests(spark, sf_dir), ["replay_round", *KEYS], "latency_ms")
    sets = [[*r, *s] for r in (["replay_round"], []) for s in SETS]
    return P.percentiles(P.levels(rounds, ["replay_round", *KEYS], sets), ["level", "replay_round", *KEYS])


def exact_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = P.state(_requests(spark, sf_dir), ["model_name"], "latency_ms", bits=None)
    return P.percentiles(states, ["model_name"], [5000, 9000, 9500, 9900], bits=None)


def round_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each round alone."""
    states = P.state(_requests(spark, sf_dir), ["replay_round"], "latency_ms")
    return P.percentiles(states, ["replay_round"], [5000, 9000, 9500, 9900])


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = P.state(_requests(spark, sf_dir), ["replay_round", *KEYS], "latency_ms")
    return P.counts(P.levels(rounds, KEYS, SETS), ["level", *KEYS])


QUERIES = {
    "p2_latency_percentiles": latency_percentiles,
    "p2_exact_percentiles": exact_percentiles,
    "p2_round_percentiles": round_percentiles,
    "p2_status_counts": status_counts,
}

_ONCE = "once AS (SELECT * FROM request_results QUALIFY row_number() OVER (PARTITION BY replay_round, line_number ORDER BY ingested_at) = 1)"
_C = "((latency_ms + 0.0) * 8796093022209.0)"
_BIN = f"({_C} - ({_C} - (latency_ms + 0.0)) + 0.0)"


def _ranks(source: str, keys: str, points: str, bound: str) -> str:
    return f"""
, f AS (SELECT {keys}, value, count(*) AS n FROM {source} WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY value) AS cum, sum(n) OVER (PARTITION BY {keys}) AS total FROM f),
t AS (SELECT c.*, b.bp, greatest((total * b.bp + 9999) // 10000, 1) AS target FROM c, (SELECT unnest({points}) AS bp) b)
SELECT {keys}, CAST(bp AS INTEGER) AS basis_points, value AS percentile, CAST(total AS BIGINT) AS n_values, {bound} AS max_relative_error
FROM t WHERE target <= cum AND target > cum - n"""


_ROUNDS = """
l AS (SELECT 'replay_round+model_name' AS level, replay_round, model_name, CAST(NULL AS INTEGER) AS status_code, value FROM v
UNION ALL SELECT 'replay_round+status_code', replay_round, NULL, status_code, value FROM v
UNION ALL SELECT 'replay_round+model_name+status_code', replay_round, model_name, status_code, value FROM v
UNION ALL SELECT 'model_name', NULL, model_name, NULL, value FROM v
UNION ALL SELECT 'status_code', NULL, NULL, status_code, value FROM v
UNION ALL SELECT 'model_name+status_code', NULL, model_name, status_code, value FROM v)"""
_LEVELS = """
l AS (SELECT 'model_name' AS level, model_name, CAST(NULL AS INTEGER) AS status_code, value FROM v
UNION ALL SELECT 'status_code', NULL, status_code, value FROM v
UNION ALL SELECT 'model_name+status_code', model_name, status_code, value FROM v)"""
_ALL = str(P.BASIS_POINTS)
SQL = {
    "p2_latency_percentiles": f"WITH {_ONCE}, v AS (SELECT replay_round, model_name, status_code, {_BIN} AS value FROM once), {_ROUNDS}" + _ranks("l", "level, replay_round, model_name, status_code", _ALL, "CAST(0.0009765625 AS DOUBLE)"),
    "p2_exact_percentiles": f"WITH {_ONCE}, v AS (SELECT model_name, latency_ms + 0.0 AS value FROM once)" + _ranks("v", "model_name", "[5000, 9000, 9500, 9900]", "CAST(0.0 AS DOUBLE)"),
    "p2_round_percentiles": f"WITH {_ONCE}, v AS (SELECT replay_round, {_BIN} AS value FROM once)" + _ranks("v", "replay_round", "[5000, 9000, 9500, 9900]", "CAST(0.0009765625 AS DOUBLE)"),
    "p2_status_counts": f"""WITH {_ONCE}, v AS (SELECT model_name, status_code, latency_ms AS value FROM once), {_LEVELS}
SELECT level, model_name, status_code, count(*) AS n_rows, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null,
CAST(sum(CASE WHEN isnan(value) THEN 1 ELSE 0 END) AS BIGINT) AS n_nan FROM l GROUP BY ALL""",
}
