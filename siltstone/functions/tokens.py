"""Per-token math on array columns: every function maps columns to a column and, but for suffix sums, stays in the JVM.

A row holds one sequence; its arrays (log-probs, masks, values, advantages) have one entry per response token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero() -> Column:
    return F.lit(0.0)


def array_sum(x: Column) -> Column:
    return F.aggregate(x, _zero(), lambda s, v: s + v)


def masked_sum(x: Column, mask: Column) -> Column:
    return array_sum(F.zip_with(x, mask, lambda a, m: a * m))


def mask_total(mask: Column) -> Column:
    return F.aggregate(mask, _zero(), lambda s, m: s + m)


def masked_mean(x: Column, mask: Column) -> Column:
    """Sum over unmasked tokens by their number, at least one."""
    return masked_sum(x, mask) / F.greatest(mask_total(mask), F.lit(1.0))


def masked_min(x: Column, mask: Column) -> Column:
    return F.coalesce(F.array_min(_kept(x, mask)), _zero())


def masked_max(x: Column, mask: Column) -> Column:
    return F.coalesce(F.array_max(_kept(x, mask)), _zero())


def _kept(x: Column, mask: Column) -> Column:
    return F.filter(F.zip_with(x, mask, lambda a, m: F.when(m > 0, a)), lambda a: a.isNotNull())


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def effective_length(mask: Column, response_length: Column) -> Column:
    return F.coalesce(F.aggregate(mask, F.lit(0).cast("bigint"), lambda s, m: s + m), response_length.cast("bigint"))


def approx_kl(new: Column, base: Column, kind: str = "k1", ratio: Column | None = None) -> Column:
    """Estimators k1, k2, k3 and low_var_kl (k3 clamped to ten), optionally weighted by an importance ratio."""

    def one(a: Column, b: Column) -> Column:
        d = a - b
        if kind == "k1":
            return d
        if kind == "k2":
            return d * d / 2.0
        low = F.exp(-d) - 1.0 + d
        if kind == "k3":
            return low
        if kind == "low_var_kl":
            return clamp(low, -10.0, 10.0)
        raise ValueError(f"unknown estimator {kind}")

    kl = F.zip_with(new, base, one)
    return kl if ratio is None else F.zip_with(kl, ratio, lambda k, r: k * r)


def policy_loss(kl: Column, advantages: Column, low: float, high: float, dual: float | None = None) -> tuple[Column, Column]:
    """Clipped surrogate per token and the tokens where the clip is active; ``kl`` is old minus new log-prob."""
    pair = F.zip_with(kl, advantages, lambda k, a: F.struct(F.exp(-k).alias("r"), a.alias("a")))

    def loss(x: Column) -> Column:
        plain = -x["r"] * x["a"]
        cut = -clamp(x["r"], 1.0 - low, 1.0 + high) * x["a"]
        both = F.greatest(plain, cut)
        if dual is None:
            return both
        return F.when(x["a"] < 0, F.least(-F.lit(dual) * x["a"], both)).otherwise(both)

    def clipped(x: Column) -> Column:
        return (-clamp(x["r"], 1.0 - low, 1.0 + high) * x["a"] > -x["r"] * x["a"]).cast("double")

    return F.transform(pair, loss), F.transform(pair, clipped)


def value_loss(values: Column, old: Column, returns: Column, clip: float) -> tuple[Column, Column]:
    rows = F.zip_with(F.zip_with(values, old, lambda v, o: F.struct(v.alias("v"), o.alias("o"))), returns, lambda p, r: F.struct(p["v"].alias("v"), p["o"].alias("o"), r.alias("r")))

    def cut(x: Column) -> Column:
        return x["o"] + clamp(x["v"] - x["o"], -clip, clip)

    def loss(x: Column) -> Column:
        return F.greatest((cut(x) - x["r"]) * (cut(x) - x["r"]), (x["v"] - x["r"]) * (x["v"] - x["r"]))

    return F.transform(rows, loss), F.transform(rows, lambda x: (F.abs(x["v"] - x["o"]) > clip).cast("double"))


def decayed_suffix_sums(x: Column, decay: float) -> Column:
    """y_t = x_t + decay * y_{t+1} for each array: in Arrow batches, by doubling the reach of every partial sum, so linear but for a logarithm."""

    @F.arrow_udf("array<double>")
    def scan(rows: pa.Array) -> pa.Array:
        rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
        flat = rows.flatten()  # leaves out null rows
        y = flat.to_numpy(zero_copy_only=False).astype(float)
        sizes = np.asarray(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False), np.int64)
        ends = np.repeat(np.cumsum(sizes), sizes)
        at, step = np.arange(len(y)), 1
        while step < sizes.max(initial=0) and decay**step != 0.0:
            inside = at[: len(y) - step][at[step:] < ends[: len(y) - step]]
            more = y[inside + step]
            y[inside] += decay**step * more
            step *= 2
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(rows.is_null().to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(offsets, pa.array(y, from_pandas=True))

    return scan(x)


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> tuple[Column, Column]:
    """Generalised advantages and returns; the value after the end is 0."""
    after = F.concat(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.array(_zero()))
    delta = F.zip_with(F.zip_with(rewards, after, lambda r, v: r + gamma * v), values, lambda r, v: r - v)
    adv = decayed_suffix_sums(delta, gamma * lam)
    return adv, F.zip_with(adv, values, lambda a, v: a + v)


def discounted(rewards: Column, gamma: float) -> Column:
    """G_t = r_t + gamma * G_{t+1}."""
    return decayed_suffix_sums(rewards, gamma)


def reinforce_rewards(kl: Column, mask: Column, reward: Column, kl_coef: float) -> Column:
    """-coef * kl * mask per token, plus the reward at the last unmasked token; a fully masked row raises."""
    last = F.array_max(F.transform(mask, lambda m, i: F.when(m > 0, i)))
    checked = F.when(last.isNull(), F.raise_error(F.lit("fully masked sequence"))).otherwise(last)
    token = F.zip_with(kl, mask, lambda k, m: -kl_coef * k * m)
    return F.transform(token, lambda t, i: F.when(i == checked, t + reward).otherwise(t))


def ppo_rewards(kl: Column, reward: Column, kl_coef: float) -> Column:
    return F.transform(kl, lambda k, i: F.when(i == F.size(kl) - 1, -kl_coef * k + reward).otherwise(-kl_coef * k))


def broadcast_reward(kl: Column, reward: Column, kl_coef: float = 0.0) -> Column:
    """The scalar reward at every token, less the KL penalty."""
    return F.transform(kl, lambda k: reward - kl_coef * k)


def sequence_kl(old: Column, new: Column, mask: Column) -> Column:
    """The sequence's mean log-ratio at every token."""
    mean = masked_mean(F.zip_with(old, new, lambda o, n: o - n), mask)
    return F.array_repeat(mean, F.size(mask))


def off_policy_mask(old: Column, new: Column, mask: Column, advantages: Column, delta: float) -> Column:
    """0 for tokens with a negative advantage in a sequence whose mean KL is above ``delta``, else 1."""
    kl = masked_mean(F.zip_with(old, new, lambda o, n: o - n), mask)
    return F.transform(advantages, lambda a: F.when((a < 0) & (kl > delta), 0.0).otherwise(1.0))


def truncated_ratio(old: Column, rollout: Column, low: float, high: float) -> tuple[Column, Column]:
    raw = F.zip_with(old, rollout, lambda o, r: F.exp(o - r))
    return F.transform(raw, lambda r: clamp(r, low, high)), F.transform(raw, lambda r: ((r < low) | (r > high)).cast("double"))


def window_ratio(old: Column, rollout: Column, low: float, high: float) -> Column:
    """The ratio inside its bounds, else 0."""
    return F.zip_with(old, rollout, lambda o, r: F.when(F.exp(o - r).between(low, high), F.exp(o - r)).otherwise(0.0))


SAFE = 20.0


def importance_weights(train: Column, rollout: Column, mask: Column, level: str = "token", mode: str = "truncate", low: float = 0.5, high: float = 2.0) -> tuple[Column, Column]:
    """Weights and the modified mask; levels token, sequence, geometric; modes truncate, clip, mask."""
    diff = F.zip_with(train, rollout, lambda t, r: t - r)
    if level == "token":
        ratio = F.transform(diff, lambda d: F.exp(clamp(d, -SAFE, SAFE)))
    else:
        total = masked_sum(diff, mask) if level == "sequence" else masked_mean(diff, mask)
        ratio = F.array_repeat(F.exp(clamp(total, -SAFE, SAFE)), F.size(mask))
    if mode == "truncate":
        return F.zip_with(ratio, mask, lambda r, m: clamp(r, 0.0, high) * m), mask
    if mode == "clip":
        return F.zip_with(ratio, mask, lambda r, m: clamp(r, low, high) * m), mask
    if mode == "mask":
        return F.zip_with(ratio, mask, lambda r, m: r * m), F.zip_with(ratio, mask, lambda r, m: F.when(r.between(low, high), m).otherwise(0.0))
    raise ValueError(f"unknown mode {mode}")


def veto(train: Column, rollout: Column, mask: Column, threshold: float) -> Column:
    """1.0 unless an unmasked token's ratio is below ``threshold``."""
    bad = F.exists(F.arrays_zip(F.zip_with(train, rollout, lambda t, r: t - r).alias("d"), mask.alias("m")), lambda x: (x["d"] < F.log(F.lit(threshold))) & (x["m"] > 0))
    return F.when(bad, 0.0).otherwise(1.0)


def mismatch_metrics(train: Column, rollout: Column, mask: Column) -> dict[str, Column]:
    """Per-sequence mismatch of two engines' log-probs."""
    mt, mr = masked_mean(train, mask), masked_mean(rollout, mask)
    ratio = F.zip_with(train, rollout, lambda t, r: t - r)
    square = F.transform(ratio, lambda d: F.exp(2.0 * clamp(d, -SAFE, SAFE)))
    return {
        "training_log_ppl": -mt,
        "training_ppl": F.exp(-mt),
        "rollout_log_ppl": -mr,
        "rollout_ppl": F.exp(-mr),
        "kl": -masked_mean(ratio, mask),
        "k3_kl": masked_mean(F.transform(ratio, lambda d: F.exp(d) - d - 1.0), mask),
        "log_ppl_diff": mr - mt,
        "log_ppl_abs_diff": F.abs(mr - mt),
        "ppl_ratio": F.exp(mr - mt),
        "chi2_token": masked_mean(square, mask) - 1.0,
        "chi2_seq": F.exp(2.0 * clamp(masked_sum(ratio, mask), -SAFE, SAFE)) - 1.0,
    }


def distillation_penalty(advantages: Column, student: Column, teacher: Column, coef: float) -> Column:
    return F.zip_with(advantages, F.zip_with(student, teacher, lambda s, t: s - t), lambda a, k: a - coef * k)


def response_tail(x: Column, n: Column) -> Column:
    """The last ``n`` entries."""
    return F.when(n > 0, F.slice(x, -n, n)).otherwise(F.slice(x, 1, 0))


def shifted_mask(mask: Column, prompt_length: Column) -> Column:
    """The response mask on token positions: ``prompt_length - 1`` zeros before, one after."""
    zero = F.lit(0).cast("int")
    return F.concat(F.array_repeat(zero, prompt_length - 1), mask, F.array(zero))


def response_length_of_mask(mask: Column) -> Column:
    """Tokens from the first unmasked one to the end."""
    at = F.array_position(mask, F.lit(1))
    return F.when(at > 0, F.size(mask) - at + 1).otherwise(0)


def zigzag(x: Column, rank: int, size: int) -> Column:
    """Chunks ``rank`` and ``2 * size - 1 - rank`` of 2 * size equal chunks."""
    n = F.call_function("div", F.size(x), F.lit(2 * size)).cast("int")
    return F.concat(F.slice(x, n * rank + 1, n), F.slice(x, n * (2 * size - 1 - rank) + 1, n))
