"""Operators on groups of samples that answer one prompt: filters with reasons, reward normalisation, pass rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tenths(x: Column) -> Column:
    """A reward as a label with one decimal."""
    return F.format_string("%.1f", F.bround(x, 1))


def nonzero_std(samples: DataFrame, key: list[str], reward: str, order: str) -> DataFrame:
    """(key, keep, reason): keep groups whose sample standard deviation exceeds 1e-6; a single sample has none and is dropped."""
    stats = samples.groupBy(*key).agg(F.stddev_samp(reward).alias("_std"), F.min_by(reward, order).alias("_first"))
    keep = F.coalesce((F.col("_std") > 1e-6) & ~F.isnan("_std"), F.lit(False))
    return stats.select(*key, keep.alias("keep"), F.when(~keep, F.concat(F.lit("zero_std_"), tenths(F.col("_first")))).alias("reason"))


def valid_group(samples: DataFrame, key: list[str], reward: str, removed: str, target: int, least: int | None = None, threshold: float = 1e-3) -> DataFrame:
    """(key, keep, reason): drop groups with too few unremoved samples or too small a population deviation among them."""
    least = target // 2 + 1 if least is None else least
    if least <= target // 2:
        raise ValueError(f"least must exceed {target // 2}")
    value = F.when(~F.col(removed), F.col(reward))
    stats = samples.groupBy(*key).agg(F.count(value).alias("_n"), F.stddev_pop(value).alias("_std"))
    small, flat = F.col("_n") < least, F.coalesce(F.col("_std") < threshold, F.lit(False))
    reason = F.when(small, F.concat(F.lit("group_size_lt_min_"), F.col("_n").cast("string"), F.lit(f"_{least}"))).when(flat, F.lit(f"reward_std_lt_{threshold:g}"))
    return stats.select(*key, (~small & ~flat).alias("keep"), reason.alias("reason"))


def keep_groups(samples: DataFrame, decisions: DataFrame, key: list[str]) -> DataFrame:
    return samples.join(decisions.where("keep").select(*key), key, "left_semi")


def drop_counts(decisions: DataFrame) -> DataFrame:
    return decisions.where("reason IS NOT NULL").groupBy(F.concat(F.lit("rollout/dynamic_filter/drop_"), "reason").alias("metric")).agg(F.count(F.lit(1)).alias("n"))


def complete_groups(items: DataFrame, key: list[str], least: int, last_text: str | None = None) -> DataFrame:
    """Keys with at least ``least`` items and, if asked, as many with a non-blank last message."""
    agg = [F.count(F.lit(1)).alias("n_items")]
    if last_text:
        agg.append(F.count(F.when(F.trim(last_text) != "", 1)).alias("n_valid"))
    out = items.groupBy(*key).agg(*agg).where(F.col("n_items") >= least)
    return out.where(F.col("n_valid") >= least) if last_text else out


def without_aborted(samples: DataFrame, key: list[str], status: str) -> tuple[DataFrame, DataFrame]:
    """Groups without an aborted sample, and the rows to queue again."""
    bad = samples.where(F.col(status) == "aborted").select(*key).distinct()
    return samples.join(bad, key, "left_anti"), samples.join(bad, key, "left_semi")


def normalise(samples: DataFrame, key: list[str], reward: str, estimator: str = "grpo", std: bool = True) -> DataFrame:
    """Add ``norm_reward``: group-relative rewards (grpo, gspo), leave-one-out (rloo), means only (reinforce_plus_plus_baseline) or as they are."""
    w = Window.partitionBy(*key)
    centred = F.col(reward) - F.avg(reward).over(w)
    if estimator in ("grpo", "gspo"):
        value = centred / (F.stddev_samp(reward).over(w) + 1e-6) if std else centred
    elif estimator == "rloo":
        n = F.count(F.lit(1)).over(w)
        value = F.when(n > 1, centred * n / (n - 1)).otherwise(0.0)
    elif estimator == "reinforce_plus_plus_baseline":
        value = centred
    else:
        value = F.col(reward)
    return samples.withColumn("norm_reward", value)


def normalise_turns(turns: DataFrame, key: list[str], reward: str, removed: str, std: bool = True) -> DataFrame:
    """As ``normalise``, per (group, turn), leaving removed rows out of the statistics and at 0."""
    w = Window.partitionBy(*key)
    live = F.when(~F.col(removed), F.col(reward))
    centred = live - F.avg(live).over(w)
    value = centred / (F.coalesce(F.stddev_samp(live).over(w), F.lit(0.0)) + 1e-6) if std else centred
    return turns.withColumn("norm_reward", F.coalesce(value, F.lit(0.0)))


def normalise_unit_rewards(items: DataFrame, key: list[str], reward: str, epsilon: float = 1e-8) -> DataFrame:
    """Rewards in [0, 1] become group z-scores (population deviation); others and groups of zeros stay."""
    w = Window.partitionBy(*key)
    unit = F.when(F.col(reward).between(0, 1), F.col(reward))
    mean, dev, top = F.avg(unit).over(w), F.stddev_pop(unit).over(w), F.max(unit).over(w)
    value = F.when(unit.isNull() | (top == 0), F.col(reward)).when(dev < epsilon, 0.0).otherwise((F.col(reward) - mean) / (dev + 1e-8))
    return items.withColumn("norm_reward", value)


def leave_one_out_baseline(samples: DataFrame, key: list[str], reward: str) -> DataFrame:
    w = Window.partitionBy(*key)
    n = F.count(F.lit(1)).over(w)
    return samples.withColumn("baseline", F.when(n > 1, (F.sum(reward).over(w) - F.col(reward)) / (n - 1)).otherwise(0.0))


def pass_at(n: Column, correct: Column, k: int) -> Column:
    """Probability that one of ``k`` draws without replacement from ``n`` samples is correct."""
    miss = F.aggregate(F.sequence((n - correct + 1).cast("int"), n.cast("int")), F.lit(1.0), lambda a, i: a * (1.0 - k / i))
    return F.when(n - correct < k, 1.0).when(correct == 0, 0.0).otherwise(1.0 - miss)


def pass_rates(samples: DataFrame, key: list[str], correct: Column, size: int) -> DataFrame:
    """(k, pass_rate) for k = 1, 2, 4 ... up to ``size`` over groups of exactly ``size``; nothing for single samples."""
    groups = samples.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(correct, 1)).alias("c")).where(F.col("n") == size)
    ks = [2**i for i in range(size.bit_length()) if 2**i <= size] if size > 1 else []
    if not ks:
        return groups.limit(0).select(F.lit(0).alias("k"), F.lit(0.0).alias("pass_rate"))
    means = groups.agg(*[F.avg(pass_at(F.col("n"), F.col("c"), k)).alias(str(k)) for k in ks])
    return means.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"`{k}`").alias("pass_rate")) for k in ks])).alias("x")).select("x.*")


def zero_variance_counts(samples: DataFrame, key: list[str], reward: str) -> DataFrame:
    flat = samples.groupBy(*key).agg(F.min(reward).alias("lo"), F.max(reward).alias("hi")).where("lo = hi")
    return flat.groupBy(F.concat(F.lit("zero_std/count_"), tenths(F.col("lo"))).alias("metric")).agg(F.count(F.lit(1)).alias("n"))


def trim_to_multiple(samples: DataFrame, order: str, size: int) -> DataFrame:
    """The first ``floor(n / size) * size`` rows in ``order``; an input smaller than ``size`` is an error.

    The cut is one order value, found by counting and an exact selection, so rows are never numbered in one task.
    """
    n = samples.count()
    if n < size:
        raise ValueError(f"{n} rows don't fill a batch of {size}")
    return head_rows(samples, order, n // size * size)


def head_rows(samples: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows in a unique ``order``: the n-th value is selected exactly, then a plain filter does the cut."""
    if n <= 0:
        return samples.limit(0)
    total = samples.count()
    if n >= total:
        return samples
    cut = nth_value(samples, order, n)
    return samples.where(F.col(order) <= F.lit(cut))


def nth_value(samples: DataFrame, order: str, n: int):
    """The n-th smallest value of a unique column: block counts of a range-partitioned copy, then one block."""
    blocks = samples.select(order).repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_block", F.spark_partition_id())
    from siltstone.session import materialize

    kept = materialize(blocks, "order")
    before = 0
    for r in kept.groupBy("_block").count().orderBy("_block").toLocalIterator():
        if before + r["count"] >= n:
            return kept.where(F.col("_block") == r["_block"]).orderBy(order).offset(n - before - 1).limit(1).collect()[0][order]
        before += r["count"]
    return None


def head_and_tail(samples: DataFrame, order: str, ratio: float) -> DataFrame:
    """The first ``r // 2`` and the last ``r - r // 2`` rows of ``r = int(n * ratio)``; ``r = 0`` keeps everything."""
    n = samples.count()
    r = int(n * ratio)
    if r == 0 or r >= n:
        return samples
    low = nth_value(samples, order, r // 2) if r // 2 else None
    high = nth_value(samples, order, n - (r - r // 2) + 1)
    tail = F.col(order) >= F.lit(high)
    return samples.where(tail if low is None else tail | (F.col(order) <= F.lit(low)))
