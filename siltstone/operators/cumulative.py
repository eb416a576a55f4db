"""Prefix sums and exact ranks over groups of any size, without one task holding a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import materialize


def range_blocks(df: DataFrame, keys: list[str], order: list[str], blocks: int | None = None) -> DataFrame:
    """Range-sort by (keys, order) and name each row's block; the blocks are written once, so both later readers see the same ones."""
    cols = [F.col(c) for c in keys + order]
    ranged = df.repartitionByRange(blocks, *cols) if blocks else df.repartitionByRange(*cols)
    return materialize(ranged.withColumn("_block", F.spark_partition_id()), "blocks")


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, blocks: int | None = None) -> DataFrame:
    """Add ``_cum`` (inclusive running sum of ``value`` in ``order`` within ``keys``) and ``_total`` (the group's sum).

    A group may hold any share of the rows: it is cut into range blocks, block sums give offsets, and each window sees one block of one
    group only. The offset enters that window as a row of its own, so no join is needed and null keys need no special care.
    ``order`` must be unique within a group. Null ``value`` counts as 0. An empty input gives an empty result.
    """
    blocks_df = range_blocks(df.withColumn(value, F.coalesce(F.col(value), F.lit(0))), keys, order, blocks)
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sums = (
        blocks_df.groupBy(*keys, "_block")
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_cum0", F.sum("_sum").over(group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_total", F.sum("_sum").over(group))
    )
    kind = blocks_df.schema[value].dataType
    rows = blocks_df.withColumns({"_head": F.lit(1), "_total": F.lit(None).cast(sums.schema["_total"].dataType), "_step": F.col(value)})
    heads = sums.select(
        *keys,
        "_block",
        *[F.lit(None).cast(blocks_df.schema[c].dataType).alias(c) for c in blocks_df.columns if c not in (*keys, "_block")],
        F.lit(0).alias("_head"),
        "_total",
        F.coalesce("_cum0", F.lit(0)).cast(kind).alias("_step"),
    )
    cell = Window.partitionBy(*keys, "_block")
    upto = cell.orderBy("_head", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.unionByName(heads)
        .withColumns({"_cum": F.sum("_step").over(upto), "_total": F.max("_total").over(upto)})
        .where("_head = 1")
        .drop("_head", "_step", "_block")
    )


def first_at_ranks(counts: DataFrame, keys: list[str], value: str, n: str, basis_points: list[int], blocks: int | None = None) -> DataFrame:
    """Per group and probability (in basis points), the first value whose running count reaches ``ceil(p * N)`` (nearest rank)."""
    probs = F.array(*[F.lit(b).cast("long") for b in basis_points])
    ranked = running_total(counts, keys, [value], n, blocks)

    def rank(b):
        return F.greatest(F.call_function("div", F.col("_total") * b + F.lit(9999), F.lit(10000)), F.lit(1))

    hit = F.filter(probs, lambda b: (rank(b) > F.col("_cum") - F.col(n)) & (rank(b) <= F.col("_cum")))
    return ranked.withColumn("_hit", hit).where(F.size("_hit") > 0).select(
        *keys, F.explode("_hit").alias("basis_points"), F.col(value), F.col("_total").alias("n_values")
    )


def running_max(blocks_df: DataFrame, keys: list[str], order: list[str], value: str, inclusive: bool = True) -> DataFrame:
    """Add ``_max``: the maximum of ``value`` over the rows so far in ``order`` within ``keys`` (without the row itself if not ``inclusive``).

    ``blocks_df`` comes from ``range_blocks`` over the same keys and order; it keeps its ``_block``. The maximum carried into a block enters
    its window as a row of its own, so no task holds more than one block of a group.
    """
    group = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = blocks_df.groupBy(*keys, "_block").agg(F.max(value).alias("_top")).withColumn("_top", F.max("_top").over(group))
    heads = tops.select(*keys, "_block", *[F.lit(None).cast(blocks_df.schema[c].dataType).alias(c) for c in blocks_df.columns if c not in (*keys, "_block")], F.lit(0).alias("_head"), F.col("_top").alias("_step"))
    rows = blocks_df.withColumns({"_head": F.lit(1), "_step": F.col(value)}).select(*heads.columns)
    upto = Window.partitionBy(*keys, "_block").orderBy("_head", *order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return rows.unionByName(heads).withColumn("_max", F.max("_step").over(upto)).where("_head = 1").drop("_head", "_step")


def interpolated(counts: DataFrame, keys: list[str], value: str, n: str, probs: dict[str, float], blocks: int | None = None) -> DataFrame:
    """Exact percentiles per group, interpolated between neighbouring ranks, from (group, value, count) rows; one column per name."""
    ranked = running_total(counts, keys, [value], n, blocks)
    at = [(name, side, F.lit(p) * (F.col("_total") - 1)) for name, p in probs.items() for side in ("low", "high")]

    def rank(side, h):
        return (F.floor(h) if side == "low" else F.ceil(h)) + 1

    picks = [F.max(F.when((rank(side, h) > F.col("_cum") - F.col(n)) & (rank(side, h) <= F.col("_cum")), F.col(value))).alias(f"_{name}_{side}") for name, side, h in at]
    per = ranked.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)
    part = {name: F.lit(p) * (F.col("_total") - 1) for name, p in probs.items()}
    return per.select(*keys, *[(F.col(f"_{x}_low") + (F.col(f"_{x}_high") - F.col(f"_{x}_low")) * (h - F.floor(h))).alias(x) for x, h in part.items()])
