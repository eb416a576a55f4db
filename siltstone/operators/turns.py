"""Operators on multi-turn trajectories: one row per (trajectory, turn)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.tokens import discounted

THRESHOLDS = (1.0, 1.2, 1.5, 2.0, 3.0)


def folded_rewards(turns: DataFrame, key: list[str], turn: str, reward: str, removed: str, gamma: float) -> DataFrame:
    """Add ``multi_turn_reward``: R_t = r_t + gamma * R_{t+1} with removed turns at 0, folded over each trajectory's ordered turns."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(turn).cast("bigint").alias("t"), F.when(F.col(removed), 0.0).otherwise(F.col(reward)).cast("double").alias("r"))))
    folded = turns.groupBy(*key).agg(rows.alias("_rows")).withColumn("_g", discounted(F.col("_rows.r"), gamma))
    folded = folded.select(*key, F.explode(F.arrays_zip(F.col("_rows.t").alias("t"), F.col("_g").alias("g"))).alias("_x"))
    folded = folded.select(*key, F.col("_x.t").alias(turn), F.col("_x.g").alias("multi_turn_reward"))
    return turns.withColumn(turn, F.col(turn).cast("bigint")).join(folded, [*key, turn])


def finalise(turns: DataFrame, key: list[str], turn: str, reward: str, removed: str, mode: str = "positive") -> DataFrame:
    """Add ``final_removed``: after a positive running maximum, drop turns that aren't positive (or don't improve on it).

    Turns removed on entry don't advance the maximum, newly dropped ones do; the first turn always counts.
    """
    w = Window.partitionBy(*key).orderBy(turn)
    first = F.row_number().over(w) == 1
    value = F.when(F.col(removed), 0.0).otherwise(F.col(reward))
    seen = F.max(F.when(first | ~F.col(removed), value)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    bar = seen if mode == "improve" else F.lit(0.0)
    drop = ~first & ~F.col(removed) & (seen > 0) & (value <= bar)
    return turns.withColumn("final_removed", F.col(removed) | F.coalesce(drop, F.lit(False)))


def last_real_turn(turns: DataFrame, key: list[str], turn: str, padded: str) -> DataFrame:
    """(key, last turn that isn't padding)."""
    return turns.where(~F.col(padded)).groupBy(*key).agg(F.max(turn).alias(turn))


def pad_turns(turns: DataFrame, key: list[str], turn: str, n: int, fill: dict[str, Column]) -> DataFrame:
    """Every trajectory with turns 0 .. n-1; missing ones are masked rows."""
    spine = turns.select(*key).distinct().withColumn(turn, F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))
    joined = spine.join(turns.withColumn("_real", F.lit(True)), [*key, turn], "left").withColumn("is_pad_turn", F.col("_real").isNull()).drop("_real")
    return joined.withColumns({c: F.when(F.col("is_pad_turn"), v).otherwise(F.col(c)) for c, v in fill.items()})


def turn_metrics(turns: DataFrame, turn: str, correct: Column, compiled: Column, speedup: Column, thresholds=THRESHOLDS) -> DataFrame:
    return turns.groupBy(turn).agg(
        F.avg(correct.cast("double")).alias("correctness"),
        F.avg(compiled.cast("double")).alias("compilation"),
        F.avg(speedup).alias("speedup"),
        *[F.avg((correct & (speedup >= t)).cast("double")).alias(f"fast_at_{str(t).replace('.', '_')}") for t in thresholds],
    )


def trajectory_metrics(turns: DataFrame, key: list[str], turn: str, correct: Column, compiled: Column, speedup: Column) -> DataFrame:
    """First and last correctness, improved and regressed trajectories, best of the first one, two and three turns."""
    w = Window.partitionBy(*key).orderBy(turn)
    rows = turns.select(*key, turn, correct.alias("_ok"), compiled.alias("_built"), speedup.alias("_speed")).withColumn("_rn", F.row_number().over(w))
    aggs = [F.min_by("_ok", turn).alias("first_ok"), F.max_by("_ok", turn).alias("last_ok")]
    for k in (1, 2, 3):
        seen = F.col("_rn") <= k
        aggs += [F.max(F.when(seen, F.col(c).cast("double"))).alias(f"{c}{k}") for c in ("_ok", "_built", "_speed")]
    per = rows.groupBy(*key).agg(*aggs)
    up, down = ~F.col("first_ok") & F.col("last_ok"), F.col("first_ok") & ~F.col("last_ok")
    out = [
        F.avg(F.col("first_ok").cast("double")).alias("first_turn_correct_rate"),
        F.avg(F.col("last_ok").cast("double")).alias("last_turn_correct_rate"),
        F.count(F.when(up, 1)).alias("improved_samples"),
        F.count(F.when(down, 1)).alias("regressed_samples"),
        (F.count(F.when(up, 1)) - F.count(F.when(down, 1))).alias("net_improvement"),
    ]
    for k in (1, 2, 3):
        out += [F.avg(f"{c}{k}").alias(f"best_by_turn_{k}_{n}") for c, n in (("_ok", "correctness"), ("_built", "compilation"), ("_speed", "speedup"))]
    return per.agg(*out)


def regroup_by_turn(turns: DataFrame, group: str, turn: str, sample: str) -> DataFrame:
    """One row per (group, turn) with its samples in order."""
    return turns.groupBy(group, turn).agg(F.array_sort(F.collect_list(sample)).alias("samples"), F.count(F.lit(1)).alias("n"))
