"""Queries of batch statistics and row expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import answers as A
from siltstone.functions import shaping as H
from siltstone.functions import text as X
from siltstone.operators import metrics as M
from siltstone.operators import ordering as O
from siltstone.operators.cumulative import interpolated
from siltstone.plans import views as V
from siltstone.plans.book import Book
from siltstone.session import table

book = Book()
S = f"WITH {V.SAMPLES}"
c = F.col


def r6(x):
    return F.round(x, 6) + F.lit(0.0)


@book.add("A08_mean_of_ratios", "SELECT l_suppkey, round(avg(CASE WHEN l_tax > 0 THEN l_discount / l_tax ELSE 0.0 END), 6) AS accept_rate FROM lineitem GROUP BY l_suppkey")
def a08(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(r6(F.avg(M.ratio(c("l_discount"), c("l_tax")))).alias("accept_rate"))


@book.add("A09_ratio_of_sums", "SELECT l_returnflag, round(sum(l_discount) / sum(l_quantity), 6) AS hit_rate, round(sum(l_discount) / count(*), 6) AS per_sample FROM lineitem GROUP BY l_returnflag")
def a09(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag")
    return g.agg(r6(M.ratio(F.sum("l_discount"), F.sum("l_quantity"))).alias("hit_rate"), r6(F.sum("l_discount") / F.count(F.lit(1))).alias("per_sample"))


@book.add("A10_category_fractions", "SELECT 'error_cat/' || event_type AS metric, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM events GROUP BY event_type")
def a10(spark, d):
    return M.category_fractions(table(spark, d, "events"), "event_type").withColumn("fraction", r6(c("fraction")))


@book.add("A11_rollout_summary", f"{S} SELECT rollout_id, round(avg(response_length), 6) AS mean, CAST(median(response_length) AS DOUBLE) AS median, max(response_length) AS max, min(response_length) AS min, round(avg(CAST(status = 'truncated' AS INTEGER)), 6) AS truncated_ratio FROM s GROUP BY rollout_id")
def a11(spark, d):
    g = V.samples(spark, d).groupBy("rollout_id")
    return g.agg(*M.statistics(c("response_length")), F.avg((c("status") == "truncated").cast("double")).alias("truncated_ratio")).withColumns({"mean": r6(c("mean")), "truncated_ratio": r6(c("truncated_ratio"))})


@book.add("A12_eval_summary", f"{S} SELECT event_type AS dataset, round(avg(reward), 6) AS mean_reward, round(avg(CAST(status = 'truncated' AS INTEGER)), 6) AS truncated_ratio, count(*) AS n FROM s GROUP BY event_type")
def a12(spark, d):
    g = V.samples(spark, d).groupBy(c("event_type").alias("dataset"))
    return g.agg(r6(F.avg("reward")).alias("mean_reward"), r6(F.avg((c("status") == "truncated").cast("double"))).alias("truncated_ratio"), F.count(F.lit(1)).alias("n"))


PASS = {1: "1.0 - (n - k) / n", 2: "1.0 - (n - k) / n * (n - k - 1) / (n - 1)", 4: "1.0 - (n - k) / n * (n - k - 1) / (n - 1) * (n - k - 2) / (n - 2) * (n - k - 3) / (n - 3)"}


@book.add(
    "A12_eval_pass_rates",
    f"{S}, g AS (SELECT rollout_id, group_index, CAST(count(*) AS DOUBLE) AS n, CAST(sum(raw_reward) AS DOUBLE) AS k FROM s GROUP BY ALL) SELECT rollout_id AS dataset, "
    + ", ".join(f"round(avg(CASE WHEN n >= {k} THEN CASE WHEN n - k < {k} THEN 1.0 ELSE {x} END END), 6) AS pass_at_{k}" for k, x in PASS.items())
    + " FROM g GROUP BY rollout_id",
)
def a12p(spark, d):
    s = V.samples(spark, d).withColumn("dataset", c("rollout_id"))
    out = M.pass_rates(s, "dataset", "group_index", c("raw_reward") == 1, list(PASS))
    return out.select("dataset", *[r6(c(f"pass_at_{k}")).alias(f"pass_at_{k}") for k in PASS])


@book.add("A11_repetition_fraction")
def a11r(spark, d):
    """Share of texts per source that compress more than tenfold over their last 10,000 characters, as far as they are longer than that."""
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.groupBy(F.lower(F.trim("source")).alias("source")).agg(r6(F.avg(A.arrow("boolean", X.has_repetition, c("text")).cast("double"))).alias("repetition_fraction"), F.count(F.lit(1)).alias("n"))


_CHECK = "CASE event_id % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' END"


@book.add(
    "A14_run_rates",
    f"SELECT user_id, round(avg(CAST(event_type = 'error' AS INTEGER)), 6) AS masked_fraction, round(avg(CASE WHEN value > 100 THEN CAST(event_type = 'error' AS INTEGER) END), 6) AS correct_masked_fraction, round(avg(CASE WHEN {_CHECK} IS NOT NULL THEN CAST({_CHECK} = 'passed' AS INTEGER) END), 6) AS precheck_pass_rate, round(avg(value / 10), 6) AS model_time_mean, round(sum(value / 10), 6) AS model_time_sum FROM events GROUP BY user_id",
)
def a14r(spark, d):
    k = F.pmod("event_id", F.lit(3))
    out = M.run_rates(table(spark, d, "events"), c("event_type") == "error", c("value") > 100, F.when(k == 0, "passed").when(k == 1, "failed"), {"model_time": c("value") / 10}, ["user_id"])
    return out.select("user_id", *[r6(c(x)).alias(x) for x in out.columns if x != "user_id"])


@book.add(
    "A13_throughput",
    f"{S}, m AS (SELECT max(response_length) AS longest, sum(response_length) AS tokens FROM s), t AS (SELECT avg(value / 10.0) AS tail FROM s, m WHERE response_length = longest) SELECT round(tokens / 60.0 / 8, 6) AS tokens_per_gpu_per_sec, round(longest / 60.0, 6) AS longest_sample_tokens_per_sec, round(tail, 6) AS longest_sample_non_generation_time, round(longest / (60.0 - tail), 6) AS longest_sample_tokens_per_sec_without_non_generation FROM m, t",
)
def a13(spark, d):
    out = M.throughput(V.samples(spark, d).withColumn("other", c("value") / 10.0), "response_length", "other", 60.0, 8)
    return out.select(*[r6(c(x)).alias(x) for x in out.columns])


@book.add(
    "A14_map_metrics",
    "WITH m AS (SELECT 'discount' AS key, l_discount AS value FROM lineitem UNION ALL SELECT 'tax', l_tax FROM lineitem WHERE l_tax > 0.02 UNION ALL SELECT 'returned', CAST(l_returnflag = 'R' AS DOUBLE) FROM lineitem) SELECT key, round(avg(value), 6) AS mean, CASE WHEN key <> 'returned' THEN min(value) + 0.0 END AS min, CASE WHEN key <> 'returned' THEN max(value) END AS max FROM m GROUP BY key",
)
def a14(spark, d):
    values = F.map_from_arrays(F.array(F.lit("discount"), F.lit("tax"), F.lit("returned")), F.array(c("l_discount"), F.when(c("l_tax") > 0.02, c("l_tax")), (c("l_returnflag") == "R").cast("double")))
    out = M.map_metrics(table(spark, d, "lineitem").select(values.alias("m")), "m", ["returned"])
    return out.withColumns({"mean": r6(c("mean")), "min": c("min") + F.lit(0.0)})


@book.add("A17_buffer_meta", "SELECT count(*) AS n_items, count(DISTINCT user_id) AS n_groups, round(count(*) / count(DISTINCT user_id), 6) AS mean_size, round(avg(value), 6) AS mean_reward FROM events")
def a17(spark, d):
    per = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    return per.agg(F.sum("n").alias("n_items"), F.count(F.lit(1)).alias("n_groups"), r6(F.avg("n")).alias("mean_size"), r6(F.sum("s") / F.sum("n")).alias("mean_reward"))


@book.add("A18_weighted_mean", "WITH p AS (SELECT user_id, avg(value) AS m, count(*) AS n FROM events GROUP BY user_id) SELECT round(sum(m * n) / sum(n), 6) AS mean FROM p")
def a18(spark, d):
    parts = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"))
    return parts.agg(r6(M.weighted_mean(parts, "m", "n")).alias("mean"))


@book.add("A21_multi_turn_lengths", f"{S} SELECT round(avg(response_length), 6) AS raw_mean, max(response_length) AS raw_max, min(response_length) AS raw_min, round(avg(CASE WHEN status = 'aborted' THEN 0 ELSE response_length END), 6) AS masked_mean, round(avg(CAST(response_length >= 100 AS INTEGER)), 6) AS clip_ratio FROM s")
def a21(spark, d):
    masked = F.when(c("status") == "aborted", 0).otherwise(c("response_length"))
    return V.samples(spark, d).agg(r6(F.avg("response_length")).alias("raw_mean"), F.max("response_length").alias("raw_max"), F.min("response_length").alias("raw_min"), r6(F.avg(masked)).alias("masked_mean"), r6(F.avg((c("response_length") >= 100).cast("double"))).alias("clip_ratio"))


@book.add(
    "A22_length_histogram",
    f"{S}, b AS (SELECT CAST(greatest(ceil(response_length * 10 / 200.0), 1) AS INTEGER) AS bucket, count(*) AS n FROM s GROUP BY 1) SELECT bucket, round(n / (SELECT count(*) FROM s), 6) AS fraction FROM b WHERE bucket <= 10",
)
def a22(spark, d):
    return M.histogram(V.samples(spark, d), c("response_length"), 200.0, 10).withColumn("fraction", r6(c("fraction")))


@book.add("A23_mean_of_rank_means", f"{S}, p AS (SELECT sample_index % 8 AS rank, avg(reward) AS m FROM s GROUP BY 1) SELECT round(avg(m), 6) AS reward FROM p")
def a23(spark, d):
    return V.samples(spark, d).groupBy(F.pmod("sample_index", F.lit(8))).agg(F.avg("reward").alias("m")).agg(r6(F.avg("m")).alias("reward"))


@book.add("A24_loss_reduction", "SELECT event_type AS metric, round(sum(value) / count(*), 6) AS value FROM events GROUP BY event_type")
def a24(spark, d):
    parts = table(spark, d, "events").groupBy("event_type", F.pmod("event_id", F.lit(16)).alias("part")).agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n"))
    return parts.groupBy(c("event_type").alias("metric")).agg(r6(F.sum("v") / F.sum("n")).alias("value"))


@book.add(
    "A32_request_stats",
    "WITH o AS (SELECT * FROM request_results QUALIFY row_number() OVER (PARTITION BY replay_round, line_number ORDER BY ingested_at) = 1) SELECT replay_round, count(*) AS n, CAST(sum(CAST(ok AS INTEGER)) AS BIGINT) AS n_ok, round(quantile_cont(CASE WHEN ok AND NOT isnan(latency_ms) THEN latency_ms END, 0.5), 6) AS p50, round(quantile_cont(CASE WHEN ok AND NOT isnan(latency_ms) THEN latency_ms END, 0.95), 6) AS p95, round(quantile_cont(CASE WHEN ok AND NOT isnan(latency_ms) THEN latency_ms END, 0.99), 6) AS p99 FROM o GROUP BY replay_round",
)
def a32(spark, d):
    """Exact interpolated percentiles from value counts, so a round may hold any number of requests."""
    rows = table(spark, d, "request_results").dropDuplicates(["replay_round", "line_number"])
    counts = rows.groupBy("replay_round").agg(F.count(F.lit(1)).alias("n"), F.sum(c("ok").cast("bigint")).alias("n_ok"))
    values = rows.where(c("ok") & c("latency_ms").isNotNull() & ~F.isnan("latency_ms")).groupBy("replay_round", "latency_ms").agg(F.count(F.lit(1)).alias("times"))
    p = interpolated(values, ["replay_round"], "latency_ms", "times", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return counts.join(p, "replay_round", "left").select("replay_round", "n", "n_ok", *[r6(c(x)).alias(x) for x in ("p50", "p95", "p99")])


@book.add("A32_status_histogram", "WITH o AS (SELECT DISTINCT replay_round, line_number, status_code FROM request_results) SELECT status_code, count(*) AS n FROM o GROUP BY status_code")
def a32h(spark, d):
    return table(spark, d, "request_results").select("replay_round", "line_number", "status_code").distinct().groupBy("status_code").agg(F.count(F.lit(1)).alias("n"))


@book.add(
    "A33_forward_flops",
    f"{S} SELECT rollout_id, sum(4 * (2.0 * n * 64 * (64 + 2 * 32) + 2.0 * n * 64 * 64 + 6.0 * n * 64 * 256 + 4.0 * n * n * 64 / 2.0) + 2.0 * n * 64 * 1000) AS flops FROM (SELECT rollout_id, CAST(response_length AS DOUBLE) AS n FROM s) GROUP BY rollout_id",
)
def a33(spark, d):
    n = c("response_length").cast("double")
    return V.samples(spark, d).groupBy("rollout_id").agg(F.sum(M.forward_flops(n, 64, 4, 256, 8, 4, 8, 1000)).alias("flops"))


@book.add(
    "A33_expert_flops",
    f"{S}, w AS (SELECT rollout_id, CAST(response_length AS DOUBLE) AS n FROM s), l AS (SELECT rollout_id, n, 2.0 * n * 32 * (64 + 4 * (16 + 8)) + 2.0 * n * (24 * (64 + 4 * (16 + 12)) + 64 * 8) + 2.0 * 4 * n * n * (16 + 8) / 2 + 4 * n * n * 12 + 2.0 * n * 64 * 64 AS att FROM w) SELECT rollout_id, sum(6 * att + 2 * (2.0 * n * 64 * 256 * 3) + 4 * (2.0 * n * 64 * (48 * 2 + 40) * 3) + 2.0 * n * 64 * 1000) AS flops FROM l GROUP BY rollout_id",
)
def a33x(spark, d):
    """Two dense and four expert layers, with low-rank attention."""
    n = c("response_length").cast("double")
    flops = M.forward_flops(n, 64, 6, 256, 4, 2, 32, 1000, M.Experts(48, 2, 40, (0, 1, 1, 0, 1, 1)), M.LowRank(24, 16, 8, 12, 32))
    return V.samples(spark, d).groupBy("rollout_id").agg(F.sum(flops).alias("flops"))


@book.add("A34_perf_ratios", f"{S} SELECT rollout_id, round(CASE WHEN sum(value) > 0 THEN sum(response_length) / sum(value) ELSE 0.0 END, 6) AS tok_per_s, round(CASE WHEN sum(value) > 0 THEN sum(CASE WHEN status = 'aborted' THEN value ELSE 0 END) / sum(value) ELSE 0.0 END, 6) AS wait_ratio FROM s GROUP BY rollout_id")
def a34(spark, d):
    t = F.sum("value")
    return V.samples(spark, d).groupBy("rollout_id").agg(r6(M.ratio(F.sum("response_length"), t)).alias("tok_per_s"), r6(M.ratio(F.sum(F.when(c("status") == "aborted", c("value")).otherwise(0)), t)).alias("wait_ratio"))


@book.add("A37_named_timers", "SELECT event_type AS name, round(sum(value), 6) AS seconds FROM events GROUP BY event_type")
def a37(spark, d):
    return table(spark, d, "events").groupBy(c("event_type").alias("name")).agg(r6(F.sum("value")).alias("seconds"))


@book.add("A40_correct_only_lengths", f"{S}, k AS (SELECT * FROM s WHERE raw_reward = 1), b AS (SELECT CAST(greatest(ceil(response_length * 5 / 200.0), 1) AS INTEGER) AS bucket, count(*) AS n FROM k GROUP BY 1) SELECT bucket, round(n / (SELECT count(*) FROM k), 6) AS fraction FROM b WHERE bucket <= 5")
def a40(spark, d):
    return M.histogram(V.samples(spark, d).where("raw_reward = 1"), c("response_length"), 200.0, 5).withColumn("fraction", r6(c("fraction")))


@book.add("A40_correct_entropy", f"WITH {V.ROWS}, q AS (SELECT seq, sum(-new * mask) / greatest(sum(mask), 1) AS x FROM r GROUP BY seq HAVING min(mask) = 1) SELECT count(*) AS n_correct, round(coalesce(sum(x), 0.0), 5) AS correct_entropy FROM q")
def a40e(spark, d):
    """Sum over the correct rows of their mean negative log-prob, 0 if none is correct."""
    right = V.sequences(spark, d).where(F.array_min("mask") == 1)
    total = M.sample_mean_sum(F.transform("new", lambda x: -x), c("mask"))
    return right.agg(F.count(F.lit(1)).alias("n_correct"), F.round(F.coalesce(total, F.lit(0.0)), 5).alias("correct_entropy"))


@book.add("A41_request_time", "SELECT user_id, round(sum(coalesce(CASE WHEN event_type <> 'error' THEN value END, 0) + coalesce(CASE WHEN event_type = 'click' THEN value / 2 END, 0)), 6) AS seconds FROM events GROUP BY user_id")
def a41(spark, d):
    model, tool = F.when(c("event_type") != "error", c("value")), F.when(c("event_type") == "click", c("value") / 2)
    return table(spark, d, "events").groupBy("user_id").agg(r6(F.sum(F.coalesce(model, F.lit(0)) + F.coalesce(tool, F.lit(0)))).alias("seconds"))


@book.add("F24_periodic_action", "SELECT event_id, (event_id + 1) % 10 = 0 OR (event_id + 1) % 25 = 0 OR event_id = 99 AS due FROM events")
def f24(spark, d):
    return table(spark, d, "events").select("event_id", H.periodic(c("event_id"), 10, 25, 100).alias("due"))


@book.add("F25_retryable_status", "SELECT status_code, count(*) AS n FROM request_results WHERE coalesce(status_code = 429 OR status_code >= 500, false) GROUP BY status_code")
def f25(spark, d):
    return table(spark, d, "request_results").where(H.retryable(c("status_code"))).groupBy("status_code").agg(F.count(F.lit(1)).alias("n"))


@book.add("P07_reward_projection", f"{S} SELECT sample_index, CAST(raw_reward AS DOUBLE) AS reward FROM s")
def p07(spark, d):
    s = V.samples(spark, d).withColumn("detail", F.create_map(F.lit("acc"), c("raw_reward").cast("double"), F.lit("score"), c("reward")))
    return s.select("sample_index", c("detail")["acc"].alias("reward"))


@book.add("P09_finish_status", "SELECT event_id, CASE event_type WHEN 'view' THEN 'truncated' WHEN 'error' THEN 'aborted' ELSE 'completed' END AS status FROM events")
def p09(spark, d):
    finish = F.when(c("event_type") == "view", "length").when(c("event_type") == "error", "abort").otherwise("stop")
    return table(spark, d, "events").select("event_id", H.status_of(finish).alias("status"))


@book.add("P10_accumulated_counters", "SELECT o_custkey, CAST(sum(l_quantity) AS DOUBLE) AS drafted, round(CASE WHEN sum(l_quantity) > 0 THEN sum(l_discount) / sum(l_quantity) ELSE 0.0 END, 6) AS rate FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey")
def p10(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), c("l_orderkey") == c("o_orderkey"))
    return j.groupBy("o_custkey").agg(F.sum("l_quantity").alias("drafted"), r6(M.ratio(F.sum("l_discount"), F.sum("l_quantity"))).alias("rate"))


@book.add("P11_training_columns", f"{S} SELECT sample_index, CAST(status = 'truncated' AS INTEGER) AS truncated, CAST(response_length AS INTEGER) AS mask_size, CASE WHEN status = 'aborted' THEN 0 ELSE response_length END AS mask_sum FROM s")
def p11(spark, d):
    rows = H.training_columns(V.samples(spark, d).withColumn("remove_sample", c("status") == "aborted"))
    return rows.select("sample_index", "truncated", F.size("loss_mask").alias("mask_size"), F.aggregate("loss_mask", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("mask_sum"))


@book.add("P12_rollout_step_metadata", "SELECT event_id, '{\"rollout_step\":7}' AS metadata FROM events")
def p12(spark, d):
    return table(spark, d, "events").select("event_id", F.to_json(F.struct(F.lit(7).alias("rollout_step"))).alias("metadata"))


@book.add("P13_step_formula", "SELECT event_id, event_id * (8 * 32) // 512 AS step FROM events")
def p13(spark, d):
    return table(spark, d, "events").select("event_id", H.rollout_step(c("event_id"), 8, 32, 512).alias("step"))


@book.add("P14_eval_metadata", "SELECT event_id, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN 'dapo' ELSE 'math' END AS rm_type FROM events")
def p14(spark, d):
    own = F.create_map(F.lit("kind"), c("event_type"), F.lit("rm_type"), F.lit("old"))
    over = F.when(F.pmod("event_id", F.lit(2)) == 0, F.create_map(F.lit("rm_type"), F.lit("dapo"))).otherwise(F.from_json(F.lit("{}"), "map<string,string>"))
    m = H.eval_metadata(own, F.lit("math"), over)
    return table(spark, d, "events").select("event_id", m["kind"].alias("kind"), m["rm_type"].alias("rm_type"))


@book.add("P15_config_precedence", "SELECT dataset_name, coalesce(rm_type, 'math') AS rm_type, coalesce(n_samples_per_eval_prompt, 4) AS n_samples, coalesce(top_p, 0.95) AS top_p, coalesce(max_response_len, 4096) AS max_response_len FROM eval_datasets")
def p15(spark, d):
    defaults = {"rm_type": "math", "n_samples_per_eval_prompt": 4, "top_p": 0.95, "max_response_len": 4096}
    t = table(spark, d, "eval_datasets")
    col = {k: F.coalesce(c(k), F.lit(v)) for k, v in defaults.items()}
    return t.select("dataset_name", col["rm_type"].alias("rm_type"), col["n_samples_per_eval_prompt"].alias("n_samples"), col["top_p"].alias("top_p"), col["max_response_len"].alias("max_response_len"))


@book.add("P17_result_rows", "SELECT sample_index, coalesce(response_length, length(response), 0) AS n, coalesce(status, 'pending') AS status FROM samples")
def p17(spark, d):
    return table(spark, d, "samples").select("sample_index", F.coalesce(c("response_length").cast("bigint"), F.length("response").cast("bigint"), F.lit(0)).alias("n"), F.coalesce("status", F.lit("pending")).alias("status"))


@book.add("P23_coverage_ratios", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_quantity > 0 THEN round(l_linenumber / l_quantity + 1e-9, 2) ELSE 0.0 END AS coverage FROM lineitem")
def p23(spark, d):
    cover = F.when(c("l_quantity") > 0, F.round(c("l_linenumber") / c("l_quantity") + 1e-9, 2)).otherwise(0.0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", cover.alias("coverage"))


@book.add("P24_attribute_whitelist", "SELECT event_id, CASE WHEN event_type <> 'view' THEN 2 ELSE 1 END AS n FROM events")
def p24(spark, d):
    attrs = F.create_map(F.lit("kind"), c("event_type"), F.lit("finish"), F.when(c("event_type") != "view", c("event_type")), F.lit("secret"), F.lit("x"))
    return table(spark, d, "events").select("event_id", F.size(H.present(attrs, ["kind", "finish"])).alias("n"))


@book.add("P25_source_inference", "SELECT doc_id, coalesce(source, project_key, 'x') AS origin FROM documents")
def p25(spark, d):
    m = F.create_map(F.lit("origin"), c("source"), F.lit("data_Source"), F.coalesce("project_key", F.lit("x")))
    return table(spark, d, "documents").select("doc_id", H.source_of(m, ["origin", "set"]).alias("origin"))


@book.add("P33_metric_prefix", "SELECT 'rollout/' || event_type AS metric, count(*) AS value FROM events GROUP BY event_type")
def p33(spark, d):
    return table(spark, d, "events").groupBy(H.prefixed(c("event_type"), "rollout/").alias("metric")).agg(F.count(F.lit(1)).alias("value"))


@book.add("F20_partial_rollout_mask", f"{S} SELECT sample_index, response_length AS new_tokens, response_length + 3 AS total FROM s")
def f20(spark, d):
    m = H.partial_rollout_mask(F.lit(3), c("response_length"))
    return V.samples(spark, d).select("sample_index", F.aggregate(m, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("new_tokens"), F.size(m).cast("bigint").alias("total"))


@book.add("O19_dynamic_batch_size", "SELECT greatest(count(*) // 24 * 24, 24) AS size FROM events")
def o19(spark, d):
    n = F.count(F.lit(1))
    return table(spark, d, "events").agg(F.greatest(F.call_function("div", n, F.lit(24)) * 24, F.lit(24)).alias("size"))


@book.add("O02_curriculum_level", "WITH x AS (SELECT doc_id, n_chars / 1000.0 AS s FROM documents) SELECT doc_id, CASE WHEN s <= 2.5 THEN 'L0' WHEN s <= 4 THEN 'L1' WHEN s <= 5.5 THEN 'L2' WHEN s <= 7.5 THEN 'L3' WHEN s <= 10.5 THEN 'L4' ELSE 'L5' END AS level FROM x")
def o02(spark, d):
    return table(spark, d, "documents").select("doc_id", O.level(c("n_chars") / 1000.0).alias("level"))


@book.add("O03_curriculum_stage", "SELECT event_id, CASE WHEN event_id < 100 THEN 0 WHEN event_id < 200 THEN 1 ELSE 2 END AS stage FROM events")
def o03(spark, d):
    return table(spark, d, "events").select("event_id", O.stage(c("event_id"), [100, 200]).alias("stage"))


@book.add("O05_level_histogram", "WITH x AS (SELECT n_chars / 1000.0 AS s FROM documents) SELECT CASE WHEN s <= 2.5 THEN 'L0' WHEN s <= 4 THEN 'L1' WHEN s <= 5.5 THEN 'L2' WHEN s <= 7.5 THEN 'L3' WHEN s <= 10.5 THEN 'L4' ELSE 'L5' END AS level, count(*) AS n FROM x GROUP BY 1")
def o05(spark, d):
    return table(spark, d, "documents").groupBy(O.level(c("n_chars") / 1000.0).alias("level")).agg(F.count(F.lit(1)).alias("n"))
