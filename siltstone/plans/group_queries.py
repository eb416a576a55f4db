"""Queries over sample groups and turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import groups as G
from siltstone.operators import metrics as M
from siltstone.operators import turns as T
from siltstone.plans import registry
from siltstone.plans import views as V
from siltstone.plans.book import Book
from siltstone.session import table

book = Book()
S, ST = f"WITH {V.SAMPLES}", f"WITH {V.SAMPLES}, {V.TURNS}"
KEY = ["group_index"]


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


STD = "coalesce(stddev_samp(reward) > 1e-6, false)"
LABEL = "printf('%.1f', arg_min(reward, sample_index))"


@book.add("F02_no_filter_keeps_all", f"{S} SELECT DISTINCT group_index, true AS keep, CAST(NULL AS VARCHAR) AS reason FROM s")
def f02(spark, d):
    return registry.decide(None, V.samples(spark, d), KEY)


@book.add("F03_reward_nonzero_std", f"{S} SELECT group_index, {STD} AS keep, CASE WHEN NOT {STD} THEN 'zero_std_' || {LABEL} END AS reason FROM s GROUP BY group_index")
def f03(spark, d):
    return G.nonzero_std(V.samples(spark, d), KEY, "reward", "sample_index")


VALID = """g AS (SELECT group_index, count(CASE WHEN event_type <> 'error' THEN reward END) AS n, stddev_pop(CASE WHEN event_type <> 'error' THEN reward END) AS sd FROM s GROUP BY group_index)"""


@book.add(
    "F04_valid_group_filter",
    f"{S}, {VALID} SELECT group_index, n >= 7 AND NOT coalesce(sd < 0.001, false) AS keep, CASE WHEN n < 7 THEN 'group_size_lt_min_' || n || '_7' WHEN sd < 0.001 THEN 'reward_std_lt_0.001' END AS reason FROM g",
)
def f04(spark, d):
    s = V.samples(spark, d).withColumn("removed", F.col("event_type") == "error")
    return G.valid_group(s, KEY, "reward", "removed", target=8, least=7)


@book.add(
    "F05_keep_by_last_real_turn",
    f"{ST}, l AS (SELECT user_id, max(turn_idx) AS turn_idx FROM t WHERE NOT removed GROUP BY user_id), k AS (SELECT t.user_id FROM t JOIN l USING (user_id, turn_idx) WHERE t.reward > 0.5) SELECT user_id, turn_idx, reward FROM t WHERE user_id IN (SELECT user_id FROM k)",
)
def f05(spark, d):
    t = V.turns(spark, d)
    last = T.last_real_turn(t, ["user_id"], "turn_idx", "removed")
    good = t.join(last, ["user_id", "turn_idx"]).where("reward > 0.5").select("user_id")
    return t.join(good, "user_id", "left_semi").select("user_id", "turn_idx", "reward")


@book.add("F06_drop_reason_counts", f"{S}, x AS (SELECT {STD} AS keep, {LABEL} AS l FROM s GROUP BY group_index) SELECT 'rollout/dynamic_filter/drop_zero_std_' || l AS metric, count(*) AS n FROM x WHERE NOT keep GROUP BY l")
def f06(spark, d):
    return G.drop_counts(f03(spark, d))


@book.add("F07_buffer_fifo", f"{S} SELECT sample_index, reward FROM s ORDER BY sample_index LIMIT 1000")
def f07(spark, d):
    return G.head_rows(V.samples(spark, d), "sample_index", 1000).select("sample_index", "reward")


@book.add("F08_zero_masks_of_removed", f"{S} SELECT sample_index, CASE WHEN status = 'aborted' THEN 0 ELSE response_length END AS mask_sum, CAST(status = 'truncated' AS INTEGER) AS truncated FROM s")
def f08(spark, d):
    from siltstone.functions.shaping import training_columns

    rows = training_columns(V.samples(spark, d).withColumn("remove_sample", F.col("status") == "aborted"))
    return rows.select("sample_index", F.aggregate("loss_mask", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("mask_sum"), "truncated")


@book.add("F10_complete_groups", "SELECT user_id, count(*) AS n_items FROM events GROUP BY user_id HAVING count(*) >= 64")
def f10(spark, d):
    return G.complete_groups(table(spark, d, "events"), ["user_id"], 64)


@book.add("F11_complete_valid_groups", "SELECT user_id, count(*) AS n_items, count(CASE WHEN event_type <> 'error' THEN 1 END) AS n_valid FROM events GROUP BY user_id HAVING count(*) >= 40 AND n_valid >= 40")
def f11(spark, d):
    e = table(spark, d, "events").withColumn("last", F.when(F.col("event_type") == "error", "  ").otherwise(F.col("event_type")))
    return G.complete_groups(e, ["user_id"], 40, "last")


ABORTED = "(SELECT DISTINCT group_index FROM s WHERE status = 'aborted')"


@book.add("F12_groups_without_aborted", f"{S} SELECT sample_index, group_index IN {ABORTED} AS requeued FROM s")
def f12(spark, d):
    kept, again = G.without_aborted(V.samples(spark, d), KEY, "status")
    return kept.select("sample_index", F.lit(False).alias("requeued")).unionByName(again.select("sample_index", F.lit(True).alias("requeued")))


@book.add("F13_trim_to_batch", f"{S} SELECT sample_index FROM s ORDER BY sample_index LIMIT (SELECT count(*) // 768 * 768 FROM s)")
def f13(spark, d):
    return G.trim_to_multiple(V.samples(spark, d), "sample_index", 768).select("sample_index")


@book.add("F14_head_tail_subsample", f"{S}, n AS (SELECT count(*) AS n, CAST(floor(count(*) * 0.1) AS BIGINT) AS r FROM s), x AS (SELECT sample_index, row_number() OVER (ORDER BY sample_index) AS rn FROM s) SELECT sample_index FROM x, n WHERE rn <= r // 2 OR rn > n - (r - r // 2)")
def f14(spark, d):
    return G.head_and_tail(V.samples(spark, d), "sample_index", 0.1).select("sample_index")


U = "((sample_index * 7919 + 104729) % 1000003) / 1000003.0"


@book.add(
    "F15_coverage_rejection",
    f"{S} SELECT sample_index, CASE WHEN status = 'aborted' THEN false WHEN raw_reward = 1 THEN {U} <= least(greatest((value / 500.0 - 0.05) / 0.1, 0.0), 1.0) ELSE true END AS keep FROM s",
)
def f15(spark, d):
    from siltstone.functions.shaping import coverage_keep
    from siltstone.operators.ordering import mix_key

    s = V.samples(spark, d)
    keep = coverage_keep(F.col("value") / 500.0, F.col("raw_reward") == 1, F.col("status") == "aborted", mix_key(F.col("sample_index"), 0) / 1000003.0, 0.05, 0.1)
    return s.select("sample_index", keep.alias("keep"))


FINAL = """f AS (SELECT *, CASE WHEN removed THEN 0.0 ELSE reward END AS v, row_number() OVER w = 1 AS first FROM t WINDOW w AS (PARTITION BY user_id ORDER BY turn_idx)),
m AS (SELECT *, max(CASE WHEN first OR NOT removed THEN v END) OVER (PARTITION BY user_id ORDER BY turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM f)"""


@book.add("F16_finalise_positive", f"{ST}, {FINAL} SELECT user_id, turn_idx, removed OR coalesce(NOT first AND NOT removed AND top > 0 AND v <= 0, false) AS final_removed FROM m")
def f16(spark, d):
    return T.finalise(V.turns(spark, d), ["user_id"], "turn_idx", "reward", "removed").select("user_id", "turn_idx", "final_removed")


@book.add("W04_finalise_improve", f"{ST}, {FINAL} SELECT user_id, turn_idx, removed OR coalesce(NOT first AND NOT removed AND top > 0 AND v <= top, false) AS final_removed FROM m")
def w04(spark, d):
    return T.finalise(V.turns(spark, d), ["user_id"], "turn_idx", "reward", "removed", "improve").select("user_id", "turn_idx", "final_removed")


@book.add("F17_mark_removed", f"{S} SELECT sample_index, CASE WHEN status = 'aborted' THEN 0.0 ELSE reward END AS reward, CASE WHEN status = 'aborted' THEN 'model_abort' END AS reason FROM s")
def f17(spark, d):
    s = V.samples(spark, d)
    gone = F.col("status") == "aborted"
    return s.select("sample_index", F.when(gone, 0.0).otherwise(F.col("reward")).alias("reward"), F.when(gone, "model_abort").alias("reason"))


@book.add("F26_needs_reward", "SELECT sample_index, count(*) AS n FROM samples WHERE reward IS NULL AND status <> 'aborted' GROUP BY sample_index")
def f26(spark, d):
    return table(spark, d, "samples").where("reward IS NULL AND status <> 'aborted'").groupBy("sample_index").agg(F.count(F.lit(1)).alias("n"))


@book.add("F27_correct_only", f"{S} SELECT sample_index, response_length FROM s WHERE raw_reward = 1")
def f27(spark, d):
    return V.samples(spark, d).where("raw_reward = 1").select("sample_index", "response_length")


@book.add("A01_group_lists", f"{S} SELECT group_index, string_agg(CAST(sample_index AS VARCHAR), ',' ORDER BY sample_index) AS members FROM s GROUP BY group_index")
def a01(spark, d):
    return V.samples(spark, d).groupBy("group_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list("sample_index")), lambda x: x.cast("string")), ",").alias("members"))


@book.add("A02_statistics", f"{S} SELECT rollout_id, round(avg(value), 6) AS mean, median(value) AS median, max(value) AS max, min(value) AS min FROM s GROUP BY rollout_id")
def a02(spark, d):
    out = V.samples(spark, d).groupBy("rollout_id").agg(*M.statistics(F.col("value")))
    return out.withColumns({"mean": r6(F.col("mean"))})


PASS = "CASE WHEN n - c < {k} THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1.0 - list_product(list_transform(range(CAST(n - c + 1 AS BIGINT), CAST(n + 1 AS BIGINT)), lambda i: 1.0 - {k} / i)) END"


@book.add(
    "A03_pass_at_k",
    f"{S}, g AS (SELECT group_index, count(*) AS n, count(CASE WHEN raw_reward = 1 THEN 1 END) AS c FROM s GROUP BY group_index HAVING count(*) = 8) "
    + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS k, round(avg({PASS.format(k=k)}), 6) AS pass_rate FROM g" for k in (1, 2, 4, 8)),
)
def a03(spark, d):
    return G.pass_rates(V.samples(spark, d), KEY, F.col("raw_reward") == 1, 8).withColumn("pass_rate", r6(F.col("pass_rate")))


NORM = "reward - avg(reward) OVER w"
W = "WINDOW w AS (PARTITION BY group_index)"


@book.add("A04_group_reward_norm", f"{S} SELECT sample_index, round(({NORM}) / (stddev_samp(reward) OVER w + 1e-6), 6) + 0.0 AS norm_reward FROM s {W}")
def a04(spark, d):
    return G.normalise(V.samples(spark, d), KEY, "reward").select("sample_index", r6(F.col("norm_reward")).alias("norm_reward"))


@book.add("A04_group_reward_rloo", f"{S} SELECT sample_index, round(CASE WHEN count(*) OVER w > 1 THEN ({NORM}) * count(*) OVER w / (count(*) OVER w - 1) ELSE 0.0 END, 6) + 0.0 AS norm_reward FROM s {W}")
def a04_rloo(spark, d):
    return G.normalise(V.samples(spark, d), KEY, "reward", "rloo").select("sample_index", r6(F.col("norm_reward")).alias("norm_reward"))


@book.add("A04_group_reward_centred", f"{S} SELECT sample_index, round({NORM}, 6) + 0.0 AS norm_reward FROM s {W}")
def a04_centred(spark, d):
    return G.normalise(V.samples(spark, d), KEY, "reward", "grpo", std=False).select("sample_index", r6(F.col("norm_reward")).alias("norm_reward"))


LIVE = "CASE WHEN NOT removed THEN reward END"


@book.add(
    "A05_turn_reward_norm",
    f"{ST} SELECT user_id, turn_idx, round(coalesce(({LIVE} - avg({LIVE}) OVER w) / (coalesce(stddev_samp({LIVE}) OVER w, 0.0) + 1e-6), 0.0), 6) + 0.0 AS norm_reward FROM t WINDOW w AS (PARTITION BY user_id // 8, turn_idx)",
)
def a05(spark, d):
    t = V.turns(spark, d).withColumn("grp", F.floor(F.col("user_id") / 8))
    return G.normalise_turns(t, ["grp", "turn_idx"], "reward", "removed").select("user_id", "turn_idx", r6(F.col("norm_reward")).alias("norm_reward"))


UNIT = "CASE WHEN r BETWEEN 0 AND 1 THEN r END"


@book.add(
    "A06_unit_reward_norm",
    f"{S}, u AS (SELECT group_index, sample_index, CASE WHEN value > 200 THEN 2.0 ELSE reward END AS r FROM s) SELECT sample_index, round(CASE WHEN {UNIT} IS NULL OR max({UNIT}) OVER w = 0 THEN r WHEN stddev_pop({UNIT}) OVER w < 1e-8 THEN 0.0 ELSE (r - avg({UNIT}) OVER w) / (stddev_pop({UNIT}) OVER w + 1e-8) END, 6) + 0.0 AS norm_reward FROM u {W}",
)
def a06(spark, d):
    s = V.samples(spark, d).withColumn("r", F.when(F.col("value") > 200, 2.0).otherwise(F.col("reward")))
    return G.normalise_unit_rewards(s, KEY, "r").select("sample_index", r6(F.col("norm_reward")).alias("norm_reward"))


@book.add("A07_zero_variance_groups", f"{S}, g AS (SELECT group_index, min(reward) AS lo, max(reward) AS hi FROM s GROUP BY group_index HAVING lo = hi) SELECT 'zero_std/count_' || printf('%.1f', lo) AS metric, count(*) AS n FROM g GROUP BY lo")
def a07(spark, d):
    return G.zero_variance_counts(V.samples(spark, d), KEY, "reward")


@book.add("W05_leave_one_out", f"{S} SELECT sample_index, round(CASE WHEN count(*) OVER w > 1 THEN (sum(reward) OVER w - reward) / (count(*) OVER w - 1) ELSE 0.0 END, 6) AS baseline FROM s {W}")
def w05(spark, d):
    return G.leave_one_out_baseline(V.samples(spark, d), KEY, "reward").select("sample_index", r6(F.col("baseline")).alias("baseline"))


@book.add(
    "W03_multi_turn_fold",
    f"{ST} SELECT user_id, turn_idx, round(sum(CASE WHEN removed THEN 0.0 ELSE reward END * pow(0.5, turn_idx)) OVER (PARTITION BY user_id ORDER BY turn_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / pow(0.5, turn_idx), 6) AS multi_turn_reward FROM t",
)
def w03(spark, d):
    return T.folded_rewards(V.turns(spark, d), ["user_id"], "turn_idx", "reward", "removed", 0.5).select("user_id", "turn_idx", r6(F.col("multi_turn_reward")).alias("multi_turn_reward"))


FAST = ", ".join(f"round(avg(CAST(reward > 0.4 AND speedup >= {t} AS INTEGER)), 6) AS fast_at_{str(t).replace('.', '_')}" for t in T.THRESHOLDS)


@book.add("A15_turn_metrics", f"{ST} SELECT turn_idx, round(avg(CAST(reward > 0.4 AS INTEGER)), 6) AS correctness, round(avg(CAST(NOT removed AS INTEGER)), 6) AS compilation, round(avg(speedup), 6) AS speedup, {FAST} FROM t GROUP BY turn_idx")
def a15(spark, d):
    out = T.turn_metrics(V.turns(spark, d), "turn_idx", F.col("reward") > 0.4, ~F.col("removed"), F.col("speedup"))
    return out.select("turn_idx", *[r6(F.col(c)).alias(c) for c in out.columns if c != "turn_idx"])


BEST = ", ".join(f"round(avg(b{k}_ok), 6) AS best_by_turn_{k}_correctness, round(avg(b{k}_built), 6) AS best_by_turn_{k}_compilation, round(avg(b{k}_speed), 6) AS best_by_turn_{k}_speedup" for k in (1, 2, 3))
PER = ", ".join(f"max(CASE WHEN turn_idx < {k} THEN CAST(ok AS INTEGER) END) AS b{k}_ok, max(CASE WHEN turn_idx < {k} THEN CAST(built AS INTEGER) END) AS b{k}_built, max(CASE WHEN turn_idx < {k} THEN speedup END) AS b{k}_speed" for k in (1, 2, 3))


@book.add(
    "A16_trajectory_metrics",
    f"{ST}, o AS (SELECT *, reward > 0.4 AS ok, NOT removed AS built FROM t), q AS (SELECT user_id, arg_min(ok, turn_idx) AS f, arg_max(ok, turn_idx) AS l, {PER} FROM o GROUP BY user_id) SELECT round(avg(CAST(f AS INTEGER)), 6) AS first_turn_correct_rate, round(avg(CAST(l AS INTEGER)), 6) AS last_turn_correct_rate, count(CASE WHEN NOT f AND l THEN 1 END) AS improved_samples, count(CASE WHEN f AND NOT l THEN 1 END) AS regressed_samples, count(CASE WHEN NOT f AND l THEN 1 END) - count(CASE WHEN f AND NOT l THEN 1 END) AS net_improvement, {BEST} FROM q",
)
def a16(spark, d):
    out = T.trajectory_metrics(V.turns(spark, d), ["user_id"], "turn_idx", F.col("reward") > 0.4, ~F.col("removed"), F.col("speedup"))
    return out.select(*[(r6(F.col(c)) if t == "double" else F.col(c)).alias(c) for c, t in out.dtypes])


@book.add(
    "W07_prefix_best",
    f"{ST} SELECT user_id, turn_idx, max(speedup) OVER w AS best, bool_or(reward > 0.4) OVER w AS any_correct, first_value(reward) OVER w AS first_reward FROM t WINDOW w AS (PARTITION BY user_id ORDER BY turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
def w07(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("turn_idx").rowsBetween(Window.unboundedPreceding, 0)
    return V.turns(spark, d).select("user_id", "turn_idx", F.max("speedup").over(w).alias("best"), F.bool_or(F.col("reward") > 0.4).over(w).alias("any_correct"), F.first("reward").over(w).alias("first_reward"))


@book.add("G01_regroup_by_turn", f"{ST} SELECT user_id // 8 AS grp, turn_idx, count(*) AS n, string_agg(CAST(sample_index AS VARCHAR), ',' ORDER BY sample_index) AS members FROM t GROUP BY ALL")
def g01(spark, d):
    t = V.turns(spark, d).withColumn("grp", F.floor(F.col("user_id") / 8))
    return T.regroup_by_turn(t, "grp", "turn_idx", "sample_index").select("grp", "turn_idx", "n", F.array_join(F.transform("samples", lambda x: x.cast("string")), ",").alias("members"))


@book.add(
    "J14_turn_spine",
    f"{ST}, k AS (SELECT DISTINCT user_id FROM t), sp AS (SELECT user_id, x AS turn_idx FROM k, (SELECT unnest(range((SELECT max(turn_idx) + 1 FROM t))) AS x)) SELECT sp.user_id, CAST(sp.turn_idx AS BIGINT) AS turn_idx, t.sample_index IS NULL AS is_pad_turn, coalesce(t.reward, 0.0) AS reward FROM sp LEFT JOIN t ON sp.user_id = t.user_id AND sp.turn_idx = t.turn_idx",
)
def j14(spark, d):
    """Padded to the longest trajectory."""
    t = V.turns(spark, d)
    n = (t.agg(F.max("turn_idx")).first()[0] or 0) + 1
    return T.pad_turns(t, ["user_id"], "turn_idx", n, {"reward": F.lit(0.0)}).select("user_id", "turn_idx", "is_pad_turn", "reward")


@book.add("J10_group_stats_on_rows", f"{S} SELECT sample_index, max(reward) OVER w AS best, count(*) OVER w AS n FROM s {W}")
def j10(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("group_index")
    return V.samples(spark, d).select("sample_index", F.max("reward").over(w).alias("best"), F.count(F.lit(1)).over(w).alias("n"))
