"""Queries of per-token math: array expressions, one row per token out."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import tokens as T
from siltstone.operators import estimators as E
from siltstone.operators import metrics as M
from siltstone.plans import views as V
from siltstone.plans.book import Book

book = Book()
R = f"WITH {V.ROWS}"
c = F.col


def per_token(df, **arrays):
    """Rows (seq, pos, values) of arrays that lie side by side."""
    zipped = F.arrays_zip(*[a.alias(n) for n, a in arrays.items()])
    flat = df.select("seq", F.posexplode(zipped).alias("p", "x"))
    return flat.select("seq", c("p").cast("bigint").alias("pos"), *[(F.round(c(f"x.{n}"), 6) + F.lit(0.0)).alias(n) for n in arrays])


def r6(x):
    return F.round(x, 6) + F.lit(0.0)


def token_query(name, sql_columns, extra=""):
    return book.add(name, f"{R}{extra} SELECT seq, pos, {', '.join(f'CAST(round({x}, 6) + 0.0 AS DOUBLE) AS {n}' for n, x in sql_columns.items())} FROM {'z' if extra else 'r'}")


D = "(new - base)"
LOW = f"(exp(-{D}) - 1.0 + {D})"


@token_query("L01_kl_estimators", {"k1": D, "k2": f"{D} * {D} / 2.0", "k3": LOW, "low_var_kl": f"greatest(least({LOW}, 10.0), -10.0)"})
def l01(spark, d):
    q = V.sequences(spark, d)
    return per_token(q, **{k: T.approx_kl(c("new"), c("base"), k) for k in ("k1", "k2", "k3", "low_var_kl")})


RATIO = "exp(new - old)"
CLIP = f"greatest(least({RATIO}, 1.005), 0.998)"
PG = f"greatest(-{RATIO} * adv, -{CLIP} * adv)"


@token_query("L02_policy_loss", {"loss": f"CASE WHEN adv < 0 THEN least(-1.001 * adv, {PG}) ELSE {PG} END", "clipped": f"CAST(-{CLIP} * adv > -{RATIO} * adv AS INTEGER)"})
def l02(spark, d):
    q = V.sequences(spark, d)
    loss, clipped = T.policy_loss(F.zip_with("old", "new", lambda o, n: o - n), c("adv"), 0.002, 0.005, 1.001)
    return per_token(q, loss=loss, clipped=clipped)


@book.add("L03_ppo_token_rewards", f"{R} SELECT seq, pos, round(-0.1 * (old - new) + CASE WHEN pos = max(pos) OVER (PARTITION BY seq) THEN 1.0 ELSE 0.0 END, 6) + 0.0 AS reward FROM r")
def l03(spark, d):
    return per_token(V.sequences(spark, d), reward=T.ppo_rewards(F.zip_with("old", "new", lambda o, n: o - n), F.lit(1.0), 0.1))


@token_query("L05_distillation_penalty", {"adv": "adv - 0.5 * (old - base)"})
def l05(spark, d):
    return per_token(V.sequences(spark, d), adv=T.distillation_penalty(c("adv"), c("old"), c("base"), 0.5))


@book.add("L06_response_tail", f"{R}, n AS (SELECT seq, count(*) AS n FROM r GROUP BY seq) SELECT seq, pos - (n - 5) AS pos, round(base, 6) + 0.0 AS lp FROM r JOIN n USING (seq) WHERE pos >= n - 5")
def l06(spark, d):
    return per_token(V.sequences(spark, d), lp=T.response_tail(c("base"), F.least(F.lit(5), F.size("base"))))


X = "exp(old - base)"


@token_query("L07_truncated_ratio", {"weight": f"greatest(least({X}, 1.002), 0.999)", "clipped": f"CAST({X} < 0.999 OR {X} > 1.002 AS INTEGER)"})
def l07(spark, d):
    w, k = T.truncated_ratio(c("old"), c("base"), 0.999, 1.002)
    return per_token(V.sequences(spark, d), weight=w, clipped=k)


@token_query("L08_window_ratio", {"weight": f"CASE WHEN {X} BETWEEN 0.999 AND 1.002 THEN {X} ELSE 0.0 END"})
def l08(spark, d):
    return per_token(V.sequences(spark, d), weight=T.window_ratio(c("old"), c("base"), 0.999, 1.002))


SUMS = ", z AS (SELECT *, sum((old - base) * mask) OVER w AS sd, greatest(sum(mask) OVER w, 1) AS n FROM r WINDOW w AS (PARTITION BY seq))"


def mis(level, mode):
    x = {"token": "exp(old - base)", "sequence": "exp(sd)", "geometric": "exp(sd / n)"}[level]
    w = {"truncate": f"least(greatest({x}, 0.0), 1.004) * mask", "clip": f"least(greatest({x}, 0.998), 1.004) * mask", "mask": f"{x} * mask"}[mode]
    m = f"CASE WHEN {x} BETWEEN 0.998 AND 1.004 THEN mask ELSE 0 END" if mode == "mask" else "mask"

    @token_query(f"L09_weights_{level}_{mode}", {"weight": w, "kept": m}, SUMS)
    def query(spark, d):
        q = V.sequences(spark, d).withColumn("m", F.transform("mask", lambda v: v.cast("double")))
        weights, kept = T.importance_weights(c("old"), c("base"), c("m"), level, mode, 0.998, 1.004)
        return per_token(q, weight=weights, kept=kept)


for _level in ("token", "sequence", "geometric"):
    for _mode in ("truncate", "clip", "mask"):
        mis(_level, _mode)


@book.add("L09_veto", f"{R} SELECT seq, CASE WHEN bool_or(old - base < ln(0.996) AND mask > 0) THEN 0.0 ELSE 1.0 END::DOUBLE AS veto FROM r GROUP BY seq")
def l09_veto(spark, d):
    return V.sequences(spark, d).select("seq", T.veto(c("old"), c("base"), c("mask"), 0.996).alias("veto"))


V_CUT = "(val + greatest(least(-old / 3.0 - val, 0.05), -0.05))"


@token_query("L11_value_loss", {"loss": f"greatest(({V_CUT} - adv) * ({V_CUT} - adv), (-old / 3.0 - adv) * (-old / 3.0 - adv))", "clipped": "CAST(abs(-old / 3.0 - val) > 0.05 AS INTEGER)"})
def l11(spark, d):
    q = V.sequences(spark, d).withColumn("v", F.transform("old", lambda o: -o / 3.0))
    loss, clipped = T.value_loss(c("v"), c("val"), c("adv"), 0.05)
    return per_token(q, loss=loss, clipped=clipped)


@book.add("L12_sft_loss", f"{R} SELECT seq, round(-sum(new * mask) / greatest(sum(mask), 1), 6) + 0.0 AS loss FROM r GROUP BY seq")
def l12(spark, d):
    return V.sequences(spark, d).select("seq", r6(-T.masked_mean(c("new"), c("mask"))).alias("loss"))


@book.add(
    "L10_policy_loss_assembly",
    f"{R}, z AS (SELECT seq, mask, {PG} * least(greatest({X}, 0.5), 1.002) AS pg, (exp(-{D}) - 1.0 + {D}) AS kl FROM r), q AS (SELECT seq, sum(pg * mask) / greatest(sum(mask), 1) AS pg, sum(kl * mask) / greatest(sum(mask), 1) AS kl FROM z GROUP BY seq) SELECT round(sum(pg) / count(*), 6) AS pg_loss, round(sum(kl) / count(*), 6) AS kl_loss, round((sum(pg) + 0.1 * sum(kl)) / count(*), 6) AS loss FROM q",
)
def l10(spark, d):
    q = V.sequences(spark, d)
    pg, _ = T.policy_loss(F.zip_with("old", "new", lambda o, n: o - n), c("adv"), 0.002, 0.005)
    weight, _ = T.truncated_ratio(c("old"), c("base"), 0.5, 1.002)
    kl = T.approx_kl(c("new"), c("base"), "k3")
    n = F.count(F.lit(1))
    pg_sum, kl_sum = M.sample_mean_sum(F.zip_with(pg, weight, lambda a, b: a * b), c("mask")), M.sample_mean_sum(kl, c("mask"))
    return q.agg(r6(pg_sum / n).alias("pg_loss"), r6(kl_sum / n).alias("kl_loss"), r6((pg_sum + 0.1 * kl_sum) / n).alias("loss"))


FULL = ("pg_loss", "entropy_loss", "pg_clipfrac", "ppo_kl", "kl_loss", "logprob_abs_diff", "off_policy_fraction", "truncated_fraction", "rejected_fraction")
_W = "exp(old - base)"
_MEAN = "sum({x} * {m}) / greatest(sum({m}), 1)"


@book.add(
    "L10_policy_objective",
    f"""{R}, m AS (SELECT seq, sum((old - new) * mask) / greatest(sum(mask), 1) AS skl FROM r GROUP BY seq),
z AS (SELECT r.*, m.skl, CASE WHEN adv < 0 AND skl > -0.001 THEN 1.0 ELSE 0.0 END AS off_p, CAST({_W} < 0.9995 OR {_W} > 1.002 AS INTEGER) AS cut, CAST({_W} BETWEEN 0.9992 AND 1.01 AS INTEGER) AS keep FROM r JOIN m USING (seq)),
y AS (SELECT *, mask * keep AS k, {PG} * (1.0 - off_p) * greatest(least({_W}, 1.002), 0.9995) AS pg, CAST(-{CLIP} * adv > -{RATIO} * adv AS INTEGER) AS clipped, {LOW} AS kl FROM z),
q AS (SELECT seq, {_MEAN.format(x='pg', m='k')} AS pg_loss, {_MEAN.format(x='val', m='k')} AS entropy_loss, {_MEAN.format(x='clipped', m='k')} AS pg_clipfrac, {_MEAN.format(x='(old - new)', m='k')} AS ppo_kl, {_MEAN.format(x='kl', m='k')} AS kl_loss,
{_MEAN.format(x='abs(old - base)', m='k')} AS logprob_abs_diff, {_MEAN.format(x='off_p', m='mask')} AS off_policy_fraction, {_MEAN.format(x='cut', m='mask')} AS truncated_fraction, {_MEAN.format(x='(1.0 - keep)', m='mask')} AS rejected_fraction FROM y GROUP BY seq)
SELECT {", ".join(f"round(avg({x}), 6) + 0.0 AS {x}" for x in FULL)}, round(avg(pg_loss) - 0.01 * avg(entropy_loss) + 0.1 * avg(kl_loss), 6) + 0.0 AS loss FROM q""",
)
def l10_full(spark, d):
    """Every part of the objective: off-policy mask, truncated weights, rejection, entropy and KL terms, with the masks each figure needs."""
    q = V.sequences(spark, d).withColumns({"rollout": c("base"), "entropy": c("val")})
    out = E.policy_objective(q, 0.002, 0.005, delta=-0.001, truncate=(0.9995, 1.002), reject=(0.9992, 1.01), entropy_coef=0.01, kl_coef=0.1)
    return out.select(*[(r6(c(x)) + F.lit(0.0)).alias(x) for x in (*FULL, "loss")])


GAE_SQL = f"""WITH RECURSIVE {V.ROWS}, n AS (SELECT seq, max(pos) AS last FROM r GROUP BY seq),
d AS (SELECT r.seq, r.pos, r.val, n.last, adv + 0.99 * coalesce(lead(val) OVER (PARTITION BY r.seq ORDER BY r.pos), 0.0) - val AS delta FROM r JOIN n USING (seq)),
g AS (SELECT seq, pos, val, delta AS a FROM d WHERE pos = last UNION ALL SELECT d.seq, d.pos, d.val, d.delta + 0.99 * 0.95 * g.a FROM d JOIN g ON d.seq = g.seq AND d.pos = g.pos - 1)
SELECT seq, pos, round(a, 6) + 0.0 AS advantage, round(a + val, 6) + 0.0 AS ret FROM g"""


@book.add("W01_gae", GAE_SQL)
def w01(spark, d):
    adv, ret = T.gae(c("adv"), c("val"), 0.99, 0.95)
    q = V.sequences(spark, d).withColumn("a", adv)
    return per_token(q, advantage=c("a"), ret=F.zip_with("a", "val", lambda a, v: a + v))


@book.add(
    "W02_reinforce_returns",
    f"{R}, l AS (SELECT seq, max(CASE WHEN mask > 0 THEN pos END) AS last FROM r GROUP BY seq HAVING last IS NOT NULL), t AS (SELECT seq, pos, -0.1 * (old - new) * mask + CASE WHEN pos = last THEN 1.0 ELSE 0.0 END AS x FROM r JOIN l USING (seq)) SELECT seq, pos, round(sum(x * pow(0.9, pos)) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / pow(0.9, pos), 6) + 0.0 AS ret FROM t",
)
def w02(spark, d):
    q = V.sequences(spark, d).where(F.exists("mask", lambda m: m > 0))
    rewards = T.reinforce_rewards(F.zip_with("old", "new", lambda o, n: o - n), c("mask"), F.lit(1.0), 0.1)
    return per_token(q.withColumn("x", rewards), ret=T.discounted(c("x"), 0.9))


@token_query("W06_broadcast_reward", {"ret": "0.5 - 0.2 * (old - new)"})
def w06(spark, d):
    return per_token(V.sequences(spark, d), ret=T.broadcast_reward(F.zip_with("old", "new", lambda o, n: o - n), F.lit(0.5), 0.2))


@book.add("A19_masked_sample_mean", f"{R}, q AS (SELECT seq, sum(val * mask) / greatest(sum(mask), 1) AS m, sum(val * mask) AS t FROM r GROUP BY seq) SELECT round(sum(m), 6) AS sample_sum, round(sum(t), 6) AS token_sum FROM q")
def a19(spark, d):
    return V.sequences(spark, d).agg(r6(M.sample_mean_sum(c("val"), c("mask"))).alias("sample_sum"), r6(M.sample_mean_sum(c("val"), c("mask"), True)).alias("token_sum"))


@book.add("A20_batch_means", f"{R}, q AS (SELECT seq, sum(val * mask) / greatest(sum(mask), 1) AS v, sum(adv * mask) / greatest(sum(mask), 1) AS a, count(*) AS n FROM r GROUP BY seq) SELECT round(avg(v), 6) AS values, round(avg(a), 6) AS advantages, round(avg(n), 6) AS total_lengths FROM q")
def a20(spark, d):
    return V.sequences(spark, d).agg(r6(F.avg(T.masked_mean(c("val"), c("mask")))).alias("values"), r6(F.avg(T.masked_mean(c("adv"), c("mask")))).alias("advantages"), r6(F.avg(F.size("val"))).alias("total_lengths"))


@book.add(
    "A25_masked_whitening",
    f"{R}, m AS (SELECT avg(adv) AS mu, var_samp(adv) AS v FROM r WHERE mask > 0) SELECT seq, pos, round((adv - mu) / sqrt(v + 1e-8), 6) + 0.0 AS adv FROM r, m",
)
def a25(spark, d):
    return per_token(M.whiten(V.sequences(spark, d), "adv", "mask"), adv=c("whitened"))


@book.add("A26_masked_extremes", f"{R} SELECT seq, round(coalesce(min(CASE WHEN mask > 0 THEN val END), 0.0), 6) AS lo, round(coalesce(max(CASE WHEN mask > 0 THEN val END), 0.0), 6) AS hi, round(sum(val * mask), 6) + 0.0 AS total, round(sum(val * mask) / greatest(sum(mask), 1) + 1e-10, 6) + 0.0 AS mean FROM r GROUP BY seq")
def a26(spark, d):
    v, m = c("val"), c("mask")
    return V.sequences(spark, d).select("seq", r6(T.masked_min(v, m)).alias("lo"), r6(T.masked_max(v, m)).alias("hi"), r6(T.masked_sum(v, m)).alias("total"), r6(T.masked_mean(v, m) + 1e-10).alias("mean"))


MM = {
    "training_log_ppl": "-mt", "training_ppl": "exp(-mt)", "rollout_log_ppl": "-mr", "rollout_ppl": "exp(-mr)", "kl": "mr - mt", "k3_kl": "k3", "log_ppl_diff": "mr - mt", "log_ppl_abs_diff": "abs(mr - mt)", "ppl_ratio": "exp(mr - mt)",
    "chi2_token": "sq - 1.0", "chi2_seq": "exp(2.0 * greatest(least(sd, 20.0), -20.0)) - 1.0",
}


@book.add(
    "A27_mismatch_metrics",
    f"{R}, q AS (SELECT seq, sum(old * mask) / greatest(sum(mask), 1) AS mt, sum(base * mask) / greatest(sum(mask), 1) AS mr, sum((exp(old - base) - (old - base) - 1.0) * mask) / greatest(sum(mask), 1) AS k3, sum(exp(2.0 * (old - base)) * mask) / greatest(sum(mask), 1) AS sq, sum((old - base) * mask) AS sd FROM r GROUP BY seq) SELECT seq, {', '.join(f'round({x}, 6) + 0.0 AS {n}' for n, x in MM.items())} FROM q",
)
def a27(spark, d):
    return V.sequences(spark, d).select("seq", *[r6(x).alias(n) for n, x in T.mismatch_metrics(c("old"), c("base"), c("mask")).items()])


@book.add("A28_weights_to_mean_one", f"{R}, m AS (SELECT sum({X} * mask) / greatest(sum(mask), 1) AS mu FROM r) SELECT seq, pos, round(CASE WHEN mu > 1e-8 THEN {X} / mu ELSE {X} END, 6) AS weight FROM r, m")
def a28(spark, d):
    q = V.sequences(spark, d).withColumn("w", F.zip_with("old", "base", lambda a, b: F.exp(a - b)))
    mean = q.agg((F.sum(T.masked_sum(c("w"), c("mask"))) / F.greatest(F.sum(T.mask_total(c("mask"))), F.lit(1.0))).alias("mu"))
    return per_token(q.crossJoin(F.broadcast(mean)), weight=F.transform("w", lambda w: F.when(c("mu") > 1e-8, w / c("mu")).otherwise(w)))


@book.add("A38_sequence_kl", f"{R} SELECT seq, pos, round(sum((old - new) * mask) OVER w / greatest(sum(mask) OVER w, 1), 6) + 0.0 AS kl FROM r WINDOW w AS (PARTITION BY seq)")
def a38(spark, d):
    return per_token(V.sequences(spark, d), kl=T.sequence_kl(c("old"), c("new"), c("mask")))


SEQ_KL = "sum((old - new) * mask) OVER w / greatest(sum(mask) OVER w, 1)"


@book.add("F19_off_policy_mask", f"{R} SELECT seq, pos, CASE WHEN adv < 0 AND {SEQ_KL} > 0.001 THEN 0.0 ELSE 1.0 END::DOUBLE AS keep FROM r WINDOW w AS (PARTITION BY seq)")
def f19(spark, d):
    return per_token(V.sequences(spark, d), keep=T.off_policy_mask(c("old"), c("new"), c("mask"), c("adv"), 0.001))


@book.add(
    "F18_sequence_rejection",
    f"{R}, q AS (SELECT seq, sum(mask) AS n, exp(greatest(least(sum((old - base) * mask) / greatest(sum(mask), 1), 20.0), -20.0)) AS ratio, bool_or(adv > 0.44 AND mask > 0) AS protect, bool_or(old - base < ln(0.991) AND mask > 0) AS veto FROM r GROUP BY seq) SELECT seq, round(ratio, 6) AS ratio, n > 0 AND NOT protect AND (veto OR ratio < 0.998 OR ratio > 1.002) AS rejected FROM q",
)
def f18(spark, d):
    q = V.sequences(spark, d)
    diff = F.zip_with("old", "base", lambda a, b: a - b)
    ratio = F.exp(T.clamp(T.masked_mean(diff, c("mask")), -20.0, 20.0))
    protect = F.exists(F.zip_with("adv", "mask", lambda a, m: (a > 0.44) & (m > 0)), lambda x: x)
    vetoed = T.veto(c("old"), c("base"), c("mask"), 0.991) == 0.0
    return q.select("seq", r6(ratio).alias("ratio"), ((T.mask_total(c("mask")) > 0) & ~protect & (vetoed | (ratio < 0.998) | (ratio > 1.002))).alias("rejected"))


@book.add("W17_response_length_of_mask", f"{R}, q AS (SELECT seq, count(*) AS n, min(CASE WHEN mask = 1 THEN pos END) AS f FROM r GROUP BY seq) SELECT seq, CAST(coalesce(n - f, 0) AS BIGINT) AS n FROM q")
def w17(spark, d):
    return V.sequences(spark, d).select("seq", T.response_length_of_mask(c("mask")).alias("n"))


@book.add(
    "W18_masked_runs",
    f"{R}, x AS (SELECT seq, pos, mask, pos - row_number() OVER (PARTITION BY seq, mask ORDER BY pos) AS island FROM r) SELECT seq, min(pos) AS first, count(*) AS n FROM x WHERE mask = 1 GROUP BY seq, island",
)
def w18(spark, d):
    from pyspark.sql import Window

    flat = V.sequences(spark, d).select("seq", F.posexplode("mask").alias("pos", "mask"))
    island = c("pos") - F.row_number().over(Window.partitionBy("seq", "mask").orderBy("pos"))
    return flat.withColumn("island", island).where("mask = 1").groupBy("seq", "island").agg(F.min("pos").cast("bigint").alias("first"), F.count(F.lit(1)).alias("n")).drop("island")


@book.add("P29_shifted_mask", f"{R}, q AS (SELECT seq, pos + 3 AS pos, mask FROM r UNION ALL SELECT DISTINCT seq, unnest([0, 1, 2]), 0 FROM r UNION ALL SELECT seq, max(pos) + 4, 0 FROM r GROUP BY seq) SELECT seq, pos, CAST(mask AS DOUBLE) AS mask FROM q")
def p29(spark, d):
    return per_token(V.sequences(spark, d), mask=T.shifted_mask(c("mask"), F.lit(4)))


@book.add("P30_shifted_targets", f"{R} SELECT seq, pos - 1 AS pos, round(val, 6) AS target FROM r WHERE pos >= 1")
def p30(spark, d):
    return per_token(V.sequences(spark, d), target=F.slice("val", F.lit(2), F.size("val") - 1))


@book.add(
    "W15_zigzag_chunks",
    f"{R}, n AS (SELECT seq FROM r GROUP BY seq HAVING count(*) = 16) SELECT seq, CASE WHEN pos BETWEEN 4 AND 7 THEN pos - 4 ELSE pos - 4 END AS pos, round(val, 6) AS val FROM r WHERE seq IN (SELECT seq FROM n) AND (pos BETWEEN 4 AND 7 OR pos BETWEEN 8 AND 11)",
)
def w15(spark, d):
    return per_token(V.sequences(spark, d).where("size(val) = 16"), val=T.zigzag(c("val"), 1, 2))


@book.add("P08_effective_length", f"{R} SELECT seq, CAST(sum(mask) AS BIGINT) AS n FROM r GROUP BY seq")
def p08(spark, d):
    return V.sequences(spark, d).select("seq", T.effective_length(c("mask"), F.lit(0)).alias("n"))
