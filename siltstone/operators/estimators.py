"""Advantages, losses and data sources by name: plain dispatch over column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import tokens as T
from siltstone.operators import metrics as M
from siltstone.operators.ordering import wrapped_slice
from siltstone.sources import records

ESTIMATORS = ("grpo", "gspo", "rloo", "trloo", "ppo", "reinforce_plus_plus", "reinforce_plus_plus_baseline")


def advantages(batch: DataFrame, estimator: str, kl_coef: float = 0.0, gamma: float = 1.0, lam: float = 1.0, kl: Column | None = None, reward: str = "reward", values: str = "val", mask: str = "mask", custom: Callable | None = None) -> DataFrame:
    """Add ``advantages`` and ``returns`` (arrays per token) by the estimator's rule, or by a function of one's own."""
    if custom is not None:
        return custom(batch)
    if estimator not in ESTIMATORS:
        raise ValueError(f"unknown estimator {estimator}")
    kl = F.transform(mask, lambda m: F.lit(0.0)) if kl is None else kl
    r = F.col(reward)
    if estimator == "ppo":
        adv, ret = T.gae(T.ppo_rewards(kl, r, kl_coef), F.col(values), gamma, lam)
        return batch.withColumn("advantages", adv).withColumn("returns", F.zip_with("advantages", values, lambda a, v: a + v))
    if estimator == "reinforce_plus_plus":
        out = T.discounted(T.reinforce_rewards(kl, F.col(mask), r, kl_coef), gamma)
    else:
        out = T.broadcast_reward(kl, r, kl_coef if estimator == "reinforce_plus_plus_baseline" else 0.0)
    return batch.withColumns({"advantages": out, "returns": out})


def loss(batch: DataFrame, kind: str, per_token: bool = False, custom: Callable | None = None) -> DataFrame:
    """One row with the batch's loss, normalised by its samples or its tokens; kinds are policy, value and sft."""
    if kind == "policy":
        x, _ = T.policy_loss(F.zip_with("old", "new", lambda o, n: o - n), F.col("adv"), 0.2, 0.2)
    elif kind == "value":
        x, _ = T.value_loss(F.col("val"), F.col("old_val"), F.col("ret"), 0.2)
    elif kind == "sft":
        x = F.transform("new", lambda v: -v)
    elif custom is not None:
        x = custom(batch)
    else:
        raise ValueError(f"unknown loss {kind}")
    n = F.sum(T.mask_total(F.col("mask"))) if per_token else F.count(F.lit(1)).cast("double")
    return batch.agg((M.sample_mean_sum(x, F.col("mask"), per_token) / F.greatest(n, F.lit(1.0))).alias("loss"))


def policy_objective(
    batch: DataFrame, low: float, high: float, delta: float | None = None, truncate: tuple[float, float] | None = None, reject: tuple[float, float] | None = None,
    entropy_coef: float = 0.0, kl_coef: float = 0.0, kl_kind: str = "k3", per_token: bool = False, importance: Callable | None = None, reducer: Callable | None = None,
) -> DataFrame:
    """One row with the policy objective and what is reported with it, over columns old, new, base, rollout, mask, adv, entropy.

    ``delta`` drops tokens of sequences that went off policy, ``truncate`` clamps the importance weights against the rollout's log-probs,
    ``reject`` takes tokens with a weight outside its bounds out of the mask. Losses and their denominators use the mask after rejection;
    the weights' own figures use the mask before it, or rejected tokens would vanish from them. ``importance`` (train, rollout, mask ->
    weights, mask) and ``reducer`` (loss, mask -> aggregate) replace the rules.
    """
    kl = F.zip_with("old", "new", lambda o, n: o - n)
    loss, clipped = T.policy_loss(kl, F.col("adv"), low, high)
    times = lambda x, y: F.zip_with(x, y, lambda a, b: a * b)
    kept, before = F.col("mask"), F.col("mask")
    extra: dict[str, Column] = {}
    if delta is not None:
        on = T.off_policy_mask(F.col("old"), F.col("new"), before, F.col("adv"), delta)
        loss = times(loss, on)
        extra["off_policy_fraction"] = M.sample_mean_sum(F.transform(on, lambda x: 1.0 - x), before, per_token)
    if importance is not None:
        weight, kept = importance(F.col("old"), F.col("rollout"), before)
        loss = times(loss, weight)
    elif truncate is not None:
        weight, cut = T.truncated_ratio(F.col("old"), F.col("rollout"), *truncate)
        loss = times(loss, weight)
        extra["truncated_fraction"] = M.sample_mean_sum(cut, before, per_token)
    if reject is not None:
        inside = F.zip_with("old", "rollout", lambda o, r: F.exp(o - r).between(*reject).cast("int"))
        kept = times(kept, inside)
        extra["rejected_fraction"] = M.sample_mean_sum(F.transform(inside, lambda x: 1.0 - x), before, per_token)
    total = lambda x: M.sample_mean_sum(x, kept, per_token)
    sums = {
        "pg_loss": reducer(loss, kept) if reducer is not None else total(loss),
        "entropy_loss": total(F.col("entropy")),
        "pg_clipfrac": total(clipped),
        "ppo_kl": total(kl),
        "kl_loss": total(T.approx_kl(F.col("new"), F.col("base"), kl_kind)),
        "logprob_abs_diff": total(F.zip_with("old", "rollout", lambda o, r: F.abs(o - r))),
        **extra,
    }
    n = F.greatest(F.sum(T.mask_total(before)) if per_token else F.count(F.lit(1)).cast("double"), F.lit(1.0))
    out = batch.agg(*[(x / n).alias(k) for k, x in sums.items()])
    return out.withColumn("loss", F.col("pg_loss") - entropy_coef * F.col("entropy_loss") + kl_coef * F.col("kl_loss"))


class PromptSource:
    """Prompts by shuffled epochs, with a buffer of returned groups that is served first and a cursor that can be saved."""

    def __init__(self, spark: SparkSession, rows: DataFrame, row_id: str, seed: int = 42):
        self.spark, self.rows, self.row_id, self.seed = spark, rows, row_id, seed
        self.size = rows.count()
        self.offset = self.epoch = 0
        self.buffer: DataFrame | None = None

    def length(self) -> int:
        return self.size

    def get(self, n: int) -> DataFrame:
        """The next n rows: the buffer's first, then the epoch's, wrapping once into the next shuffle."""
        held = None
        if self.buffer is not None:
            held, left = self.buffer.orderBy(self.row_id).limit(n), self.buffer.orderBy(self.row_id).offset(n)
            n -= held.count()
            self.buffer = None if left.isEmpty() else left
        if n <= 0:
            return held
        out = wrapped_slice(self.rows, self.row_id, self.offset, n, self.size, self.seed, self.epoch).select(*self.rows.columns)
        self.offset += n
        if self.offset >= self.size:
            self.offset, self.epoch = self.offset - self.size, self.epoch + 1
        return out if held is None else held.unionByName(out)

    def add(self, groups: DataFrame) -> None:
        self.buffer = groups if self.buffer is None else self.buffer.unionByName(groups)

    def save(self, path: str, rollout_id: int) -> None:
        records.save_state(self.spark, path, rollout_id=rollout_id, sample_offset=self.offset, epoch_id=self.epoch, group_index=0, sample_index=0, metadata={})

    def load(self, path: str, rollout_id: int) -> None:
        state = records.load_state(self.spark, path, rollout_id)
        if state:
            self.offset, self.epoch = state["sample_offset"], state["epoch_id"]
