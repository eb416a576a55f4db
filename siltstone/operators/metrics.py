"""Batch statistics: summaries, masked means, whitening, histograms, ratios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import tokens as T


def statistics(x: Column, prefix: str = "") -> list[Column]:
    return [F.avg(x).alias(f"{prefix}mean"), F.median(x).alias(f"{prefix}median"), F.max(x).alias(f"{prefix}max"), F.min(x).alias(f"{prefix}min")]


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b isn't positive."""
    return F.when(b > 0, a / b).otherwise(0.0)


def sample_mean_sum(x: Column, mask: Column, per_token: bool = False) -> Column:
    """Sum over samples of their masked means, or the masked token sum."""
    return F.sum(T.masked_sum(x, mask) if per_token else T.masked_mean(x, mask))


def whiten(rows: DataFrame, x: str, mask: str, shift_mean: bool = True, eps: float = 1e-8) -> DataFrame:
    """Add ``whitened``: (x - mean) * rsqrt(var + eps) with moments over all unmasked tokens of all rows (sample variance)."""
    sums = rows.agg(
        F.sum(T.mask_total(F.col(mask))).alias("_n"),
        F.sum(T.masked_sum(F.col(x), F.col(mask))).alias("_s"),
        F.sum(T.masked_sum(F.transform(x, lambda v: v * v), F.col(mask))).alias("_q"),
    )
    mean = F.col("_s") / F.greatest(F.col("_n"), F.lit(1.0))
    var = F.col("_q") / F.greatest(F.col("_n"), F.lit(1.0)) - mean * mean
    moments = sums.select(mean.alias("_mean"), F.when(F.col("_n") >= 2, var * F.col("_n") / (F.col("_n") - 1)).otherwise(var).alias("_var"))
    back = F.lit(0.0) if shift_mean else F.col("_mean")
    return rows.crossJoin(F.broadcast(moments)).withColumn("whitened", F.transform(x, lambda v: (v - F.col("_mean")) / F.sqrt(F.col("_var") + eps) + back)).drop("_mean", "_var")


def histogram(rows: DataFrame, x: Column, total: float, n: int) -> DataFrame:
    """(bucket, fraction) of n equal widths over (0, total]; larger values are left out of the buckets but not of the fractions."""
    bucket = F.greatest(F.ceil(x * n / total), F.lit(1)).cast("int")
    counted = rows.select(bucket.alias("bucket"), F.lit(1).alias("one")).groupBy("bucket").agg(F.sum("one").alias("n"))
    every = counted.agg(F.sum("n").alias("all"))
    return counted.where(F.col("bucket") <= n).crossJoin(F.broadcast(every)).select("bucket", (F.col("n") / F.col("all")).alias("fraction"))


def category_fractions(rows: DataFrame, category: str) -> DataFrame:
    counted = rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    return counted.crossJoin(F.broadcast(counted.agg(F.sum("n").alias("all")))).select(F.concat(F.lit("error_cat/"), F.col(category)).alias("metric"), (F.col("n") / F.col("all")).alias("fraction"))


def map_metrics(rows: DataFrame, values: str, bool_keys: list[str]) -> DataFrame:
    """(key, mean, min, max) of a string-to-double map with keys that differ by row; of boolean keys the mean only."""
    flat = rows.select(F.explode(values).alias("key", "value")).where("value IS NOT NULL")
    is_bool = F.col("key").isin(bool_keys)
    return flat.groupBy("key").agg(F.avg("value").alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi")).select(
        "key", "mean", F.when(~is_bool, F.col("lo")).alias("min"), F.when(~is_bool, F.col("hi")).alias("max")
    )


def weighted_mean(parts: DataFrame, mean: str, n: str) -> Column:
    return F.sum(F.col(mean) * F.col(n)) / F.sum(n)


def throughput(rows: DataFrame, length: str, other_time: str, seconds: float, gpus: int) -> DataFrame:
    """Tokens per device and second, of the longest sample, and without the mean other time of the longest samples."""
    top = rows.groupBy(length).agg(F.avg(other_time).alias("tail"), F.sum(length).alias("s")).agg(F.max(length).alias("longest"), F.max_by("tail", length).alias("tail"), F.sum("s").alias("tokens"))
    return top.select(
        (F.col("tokens") / seconds / gpus).alias("tokens_per_gpu_per_sec"),
        (F.col("longest") / seconds).alias("longest_sample_tokens_per_sec"),
        F.col("tail").alias("longest_sample_non_generation_time"),
        (F.col("longest") / (seconds - F.col("tail"))).alias("longest_sample_tokens_per_sec_without_non_generation"),
    )


@dataclass(frozen=True)
class Experts:
    """Expert layers: their width, how many a token is routed to, the width of the shared one, and which layers have them.

    ``pattern`` is a period (layers 0, p, 2p, ... have experts), one flag per layer, or None for all layers.
    """

    ffn: int
    chosen: int
    shared: int = 0
    pattern: int | tuple[int, ...] | None = None

    def count(self, layers: int) -> int:
        if self.pattern is None:
            return layers
        return -(-layers // self.pattern) if isinstance(self.pattern, int) else sum(f > 0 for f in self.pattern)


@dataclass(frozen=True)
class LowRank:
    """Attention through low-rank projections: ranks of queries and of keys with values, and the head's content, position and value sizes."""

    kv_rank: int
    content: int
    position: int
    value: int
    q_rank: int | None = None


def forward_flops(length: Column, hidden: int, layers: int, ffn: int, heads: int, kv_heads: int, head_dim: int, vocab: int, experts: Experts | None = None, low_rank: LowRank | None = None) -> Column:
    """Decoder FLOPs of one forward pass over a sequence (multiply-adds count twice; causal attention is half of the square)."""
    x = low_rank
    q_weights = hidden * heads * head_dim if x is None or x.q_rank is None else x.q_rank * (hidden + heads * (x.content + x.position))
    kv_weights = 2 * hidden * kv_heads * head_dim if x is None else x.kv_rank * (hidden + heads * (x.content + x.value)) + hidden * x.position
    scored, mixed = (head_dim, head_dim) if x is None else (x.content + x.position, x.value)
    n_experts = experts.count(layers) if experts else 0
    n_dense = layers - n_experts if experts is None or not isinstance(experts.pattern, tuple) else sum(f == 0 for f in experts.pattern)
    widths = n_dense * ffn + (n_experts * (experts.ffn * experts.chosen + experts.shared) if experts else 0)
    per_token = 2.0 * ((n_dense + n_experts) * (q_weights + kv_weights + hidden * hidden) + 3 * hidden * widths + hidden * vocab)
    per_square = (n_dense + n_experts) * heads * (scored + mixed)
    return length * per_token + length * length * float(per_square)


def pass_rates(rows: DataFrame, dataset: str, group: str, correct: Column, ks: list[int]) -> DataFrame:
    """(dataset, pass_at_k ...): the unbiased estimate 1 - C(n - c, k) / C(n, k), averaged over the dataset's prompt groups."""
    per = rows.groupBy(dataset, group).agg(F.count(F.lit(1)).alias("_n"), F.sum(correct.cast("int")).alias("_c"))

    def estimate(k: int) -> Column:
        fail = F.lit(1.0)
        for i in range(k):
            fail = fail * (F.col("_n") - F.col("_c") - i) / (F.col("_n") - i)
        return F.when(F.col("_n") - F.col("_c") < k, 1.0).otherwise(1.0 - fail)

    return per.groupBy(dataset).agg(*[F.avg(F.when(F.col("_n") >= k, estimate(k))).alias(f"pass_at_{k}") for k in ks])


def run_rates(rows: DataFrame, masked: Column, correct: Column, precheck: Column, times: dict[str, Column], by: list[str]) -> DataFrame:
    """Fractions of rows masked, and masked among the correct ones; the share of prechecks passed; mean and sum of each time."""
    checked = precheck.isin("passed", "failed")
    return rows.groupBy(*by).agg(
        F.avg(masked.cast("double")).alias("masked_fraction"),
        F.avg(F.when(correct, masked.cast("double"))).alias("correct_masked_fraction"),
        F.avg(F.when(checked, (precheck == "passed").cast("double"))).alias("precheck_pass_rate"),
        *[f(x).alias(f"{name}_{kind}") for name, x in times.items() for kind, f in (("mean", F.avg), ("sum", F.sum))],
    )
