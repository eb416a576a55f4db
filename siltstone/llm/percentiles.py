"""Percentiles of very large numeric columns by cumulative frequencies, with a known error bound and mergeable states.

A state is a table of (group, value, count). States of different partitions, rounds or days merge by adding counts. Percentiles come from
a state by range-sorting it, adding block offsets to windowed running counts and taking the first value that reaches each target rank.

The error bound: values are rounded to ``bits`` significant binary digits before counting, so a reported percentile ``q`` and the exact
nearest-rank percentile ``x`` satisfy ``|q - x| <= 2**-bits * |x|``. Rounding is monotone, hence ranks are never wrong. ``bits=None``
counts exact values (bound 0); the state then grows with the number of distinct values instead of staying bounded.

Defined cases: null and NaN values are counted apart (``n_null``, ``n_nan``) and take no part in ranks; 0.0 and -0.0 are one value;
infinities are ordinary extreme values; null group keys form a group of their own; an empty input gives an empty result; a group
without a valid value appears in the counts with no percentile rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.cumulative import first_at_ranks

BITS = 10
BASIS_POINTS = [1000, 2500, 5000, 7500, 9000, 9500, 9900, 9990]


def once(df: DataFrame, key: list[str], arrival: str, keep: list[str]) -> DataFrame:
    """One row per key: the first delivery (ties of ``arrival`` by the other columns)."""
    rest = [c for c in keep if c not in key]
    first = F.min(F.struct(F.col(arrival).alias("_at"), *[F.col(c) for c in rest])).alias("_first")
    return df.groupBy(*key).agg(first).select(*key, *[F.col(f"_first.{c}").alias(c) for c in rest])


def rounded(value: Column, bits: int | None) -> Column:
    """Round to ``bits`` significant binary digits by splitting; values too large to split stay as they are."""
    x = value.cast("double") + F.lit(0.0)
    if bits is None:
        return x
    c = x * F.lit(float(2 ** (53 - bits) + 1))
    cut = c - (c - x)
    return F.when(F.isnan(cut) | (F.abs(c) == F.lit(float("inf"))), x).otherwise(cut + F.lit(0.0))


def state(df: DataFrame, keys: list[str], value: str, bits: int | None = BITS) -> DataFrame:
    """(keys, value, n): the mergeable state; ``value`` is null for missing and NaN for not-a-number rows."""
    return df.select(*keys, rounded(F.col(value), bits).alias("value")).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))


def merge(states: DataFrame, keys: list[str]) -> DataFrame:
    """Add states up over every column but ``keys`` (union them first if they are separate tables)."""
    return states.groupBy(*keys, "value").agg(F.sum("n").alias("n"))


def levels(states: DataFrame, keys: list[str], sets: list[list[str]]) -> DataFrame:
    """Merge a state into several groupings at once: ``level`` names the grouping, columns outside it are null."""
    cell = F.array(*[F.struct(F.lit("+".join(s) or "all").alias("level"), *[(F.col(k) if k in s else F.lit(None).cast(states.schema[k].dataType)).alias(k) for k in keys]) for s in sets])
    wide = states.select(F.explode(cell).alias("g"), "value", "n").select("g.*", "value", "n")
    return merge(wide, ["level", *keys])


def percentiles(states: DataFrame, keys: list[str], basis_points: list[int] | None = None, bits: int | None = BITS, blocks: int | None = None) -> DataFrame:
    """(keys, basis_points, percentile, n_values, max_relative_error) from a state."""
    valid = states.where(F.col("value").isNotNull() & ~F.isnan("value"))
    bound = 0.0 if bits is None else 2.0**-bits
    return first_at_ranks(valid, keys, "value", "n", basis_points or BASIS_POINTS, blocks).select(
        *keys, F.col("basis_points").cast("int").alias("basis_points"), F.col("value").alias("percentile"), "n_values", F.lit(bound).alias("max_relative_error")
    )


def counts(states: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the rows with a usable, a missing and a not-a-number value."""
    nan = F.col("value").isNotNull() & F.isnan("value")
    return states.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.sum(F.when(nan, F.col("n")).otherwise(0)).alias("n_nan"),
    )
