"""Deterministic shuffles, curricula, draws, slices and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.cumulative import running_total

LEVELS = [(2.5, "L0"), (4.0, "L1"), (5.5, "L2"), (7.5, "L3"), (10.5, "L4")]


def positions(rows: DataFrame, order: list[str], out: str = "pos", keys: list[str] | None = None) -> DataFrame:
    """Add 0-based positions in a unique order, by distributed prefix sums: no task holds all rows."""
    return running_total(rows.withColumn("_one", F.lit(1).cast("bigint")), keys or [], order, "_one").withColumn(out, F.col("_cum") - 1).drop("_cum", "_total", "_one")


def epoch_key(row_id: str, seed: int, epoch: int) -> Column:
    """The order key of one epoch's shuffle: a hash of the row and ``seed + epoch``, always from the original rows."""
    return F.xxhash64(F.col(row_id), F.lit(seed + epoch))


def mix_key(row_id: Column, salt: int) -> Column:
    """A portable pseudo-random key: a linear congruence of the row id, the same in any SQL engine."""
    return F.pmod((row_id + salt) * F.lit(7919) + F.lit(104729), F.lit(1000003))


def repeated_input(rows: DataFrame, row_id: str, instance: str, repeats: int, seed: int) -> DataFrame:
    """The generator's input: a missing ``instance`` is the row's number, and all rows come ``repeats`` times, shuffled anew each time."""
    named = rows.withColumn(instance, F.coalesce(F.col(instance), F.col(row_id)))
    times = named.withColumn("repeat_idx", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    keyed = times.withColumn("_key", mix_key(F.col(row_id) + F.col("repeat_idx"), seed))
    return positions(keyed, ["repeat_idx", "_key", row_id]).drop("_key")


def level(score: Column) -> Column:
    out = F.when(score <= LEVELS[0][0], LEVELS[0][1])
    for bound, name in LEVELS[1:]:
        out = out.when(score <= bound, name)
    return out.otherwise("L5")


def stage(rollout: Column, bounds: list[int]) -> Column:
    """Index of the first bound that the rollout id is below."""
    out = F.lit(len(bounds))
    for i, b in reversed(list(enumerate(bounds))):
        out = F.when(rollout < b, i).otherwise(out)
    return out


def curriculum_draws(n: int, weights: dict[str, float], sizes: dict[str, int], seed: int, spark) -> DataFrame:
    """(draw, level, position): weighted level draws over non-empty levels, then sequential positions within each level, wrapping round."""
    live = {k: w for k, w in sorted(weights.items()) if w > 0 and sizes.get(k, 0) > 0}
    total = sum(live.values())
    draws = spark.range(n).withColumnRenamed("id", "draw").withColumn("u", mix_key(F.col("draw"), seed) / 1000003.0)
    bound, pick = 1.0, F.lit(None).cast("string")
    for k, w in reversed(list(live.items())):  # the last interval is set first, earlier ones override below their bound
        pick = F.when(F.col("u") < bound, F.lit(k)).otherwise(pick)
        bound -= w / total
    size = F.lit(None).cast("bigint")
    for k in live:
        size = F.when(F.col("level") == k, F.lit(sizes[k])).otherwise(size)
    ranked = positions(draws.withColumn("level", pick), ["draw"], "k", ["level"])
    return ranked.select("draw", "level", (F.col("k") % size).alias("position"))


def repeat(rows: DataFrame, n: int, order: list[str], group: str = "group_index", sample: str = "sample_index", base: int = 0) -> DataFrame:
    """Each row n times, with global group and sample counters that start at ``base``."""
    numbered = positions(rows, order, group)
    return numbered.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns({sample: F.col(group) * n + F.col("repeat") + base * n, group: F.col(group) + base})


def wrapped_slice(rows: DataFrame, row_id: str, offset: int, n: int, size: int, seed: int, epoch: int) -> DataFrame:
    """``n`` rows from ``offset`` of the shuffled epoch; what is missing comes from the head of the next epoch's shuffle (one wrap)."""

    def part(e: int, low: int, high: int) -> DataFrame:
        shuffled = positions(rows.withColumn("_key", mix_key(F.col(row_id), seed + e)), ["_key", row_id], "_pos")
        return shuffled.where((F.col("_pos") >= low) & (F.col("_pos") < high)).withColumns({"epoch": F.lit(e), "pos": F.col("_pos") - low}).drop("_key", "_pos")

    tail = part(epoch, offset, min(offset + n, size))
    rest = offset + n - size
    return tail if rest <= 0 else tail.unionByName(part(epoch + 1, 0, rest).withColumn("pos", F.col("pos") + (n - rest)))


def newest(items: DataFrame, key: str, at: Column, n: int) -> DataFrame:
    """The items of the n groups with the latest timestamp (missing ones count as 0; ties by key)."""
    latest = items.groupBy(key).agg(F.max(F.coalesce(at, F.lit(0))).alias("_at")).orderBy(F.desc("_at"), key).limit(n).select(key)
    return items.join(F.broadcast(latest), key, "left_semi")


def accept_until(groups: DataFrame, key: str, completed: str, n: int) -> DataFrame:
    """The first n kept groups in completion order."""
    return groups.where("keep").orderBy(completed, key).limit(n)


def micro_batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    numbered = positions(rows, order)
    return numbered.withColumn("micro_batch", F.floor(F.col("pos") / size)).drop("pos")


def round_robin(rows: DataFrame, order: list[str], ranks: int) -> DataFrame:
    return positions(rows, order).withColumn("rank", F.pmod("pos", F.lit(ranks))).drop("pos")


def trajectory_split(turns: DataFrame, sample: str, ranks: int) -> DataFrame:
    """Contiguous runs of whole trajectories per rank; the number of trajectories must be divisible."""
    names = positions(turns.select(sample).distinct(), [sample], "_t")
    n = names.count()
    if n % ranks:
        raise ValueError(f"{n} trajectories don't divide into {ranks} ranks")
    return turns.join(names, sample).withColumn("rank", F.floor(F.col("_t") / (n // ranks))).drop("_t")


def dynamic_batch_size(n: int, ranks: int) -> int:
    return max(n // ranks * ranks, ranks)


def cumulative_lengths(rows: DataFrame, keys: list[str], order: list[str], length: str) -> DataFrame:
    """Add ``cu_start`` and ``cu_end``, the offsets of each sequence in its packed batch."""
    total = running_total(rows.withColumn("_n", F.col(length).cast("bigint")), keys, order, "_n")
    return total.withColumns({"cu_end": F.col("_cum"), "cu_start": F.col("_cum") - F.col("_n")}).drop("_cum", "_total", "_n")


def chunks_of(rows: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """Consecutive rows in chunks of ``size``; an incomplete last chunk is dropped."""
    w = Window.partitionBy(*keys).orderBy(order)
    numbered = rows.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size))
    return numbered.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "chunk"))).where(F.col("_n") == size).drop("_n")


def buffer_then_source(buffer: DataFrame, source: DataFrame, order: str, n: int) -> DataFrame:
    """Rows of the buffer first, then of the source, up to n."""
    both = buffer.withColumn("origin", F.lit(0)).unionByName(source.withColumn("origin", F.lit(1)))
    return both.orderBy("origin", order).limit(n)
