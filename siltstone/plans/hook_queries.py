"""Queries of dispatchers, data sources and extension points."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from siltstone.functions import masks as K
from siltstone.functions import tokens as T
from siltstone.operators import estimators as E
from siltstone.operators import groups as G
from siltstone.plans import registry
from siltstone.plans import views as V
from siltstone.plans.book import Book
from siltstone.session import scratch_path, table
from siltstone.sources import records as R
from siltstone.streaming import buffer as B

book = Book()
c = F.col
S, RW = f"WITH {V.SAMPLES}", f"WITH {V.ROWS}"


def per_token(df, array):
    flat = df.select("seq", F.posexplode(array).alias("p", "x"))
    return flat.select("seq", c("p").cast("bigint").alias("pos"), (F.round("x", 6) + F.lit(0.0)).alias("adv"))


def batch(spark, d):
    return V.sequences(spark, d).withColumn("reward", F.lit(0.5)).withColumn("kl", F.zip_with("old", "new", lambda o, n: o - n))


for _name in ("grpo", "gspo", "rloo", "trloo"):

    def _flat(spark, d, name=_name):
        return per_token(E.advantages(batch(spark, d), name, 0.2, kl=c("kl")), c("advantages"))

    book.add(f"L04_advantages_{_name}", f"{RW} SELECT seq, pos, 0.5::DOUBLE AS adv FROM r")(_flat)


@book.add("L04_advantages_baseline", f"{RW} SELECT seq, pos, round(0.5 - 0.2 * (old - new), 6) + 0.0 AS adv FROM r")
def l04b(spark, d):
    return per_token(E.advantages(batch(spark, d), "reinforce_plus_plus_baseline", 0.2, kl=c("kl")), c("advantages"))


@book.add("L04_advantages_reinforce", f"{RW}, l AS (SELECT seq, max(CASE WHEN mask > 0 THEN pos END) AS last FROM r GROUP BY seq HAVING last IS NOT NULL) SELECT seq, pos, round(sum(-0.2 * (old - new) * mask + CASE WHEN pos = last THEN 0.5 ELSE 0.0 END) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) + 0.0 AS adv FROM r JOIN l USING (seq)")
def l04r(spark, d):
    rows = batch(spark, d).where(F.exists("mask", lambda m: m > 0))
    return per_token(E.advantages(rows, "reinforce_plus_plus", 0.2, kl=c("kl")), c("advantages"))


@book.add(
    "L04_advantages_ppo",
    f"{RW}, n AS (SELECT seq, max(pos) AS last FROM r GROUP BY seq), t AS (SELECT r.seq, pos, -0.2 * (old - new) + CASE WHEN pos = last THEN 0.5 ELSE 0.0 END + coalesce(lead(val) OVER (PARTITION BY r.seq ORDER BY pos), 0.0) - val AS delta FROM r JOIN n USING (seq)) SELECT seq, pos, round(sum(delta) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) + 0.0 AS adv FROM t",
)
def l04p(spark, d):
    return per_token(E.advantages(batch(spark, d), "ppo", 0.2, kl=c("kl")), c("advantages"))


@book.add("L13_loss_dispatch", f"{RW}, q AS (SELECT seq, sum(-new * mask) AS t, sum(mask) AS n FROM r GROUP BY seq) SELECT 'samples' AS per, round(sum(t / greatest(n, 1)) / count(*), 6) AS loss FROM q UNION ALL SELECT 'tokens', round(sum(t) / sum(n), 6) FROM q")
def l13(spark, d):
    q = V.sequences(spark, d)
    both = [E.loss(q, "sft", p).select(F.lit(n).alias("per"), F.round("loss", 6).alias("loss")) for n, p in (("samples", False), ("tokens", True))]
    return both[0].unionByName(both[1])


CHAT = "SELECT item_id, CAST(length(coalesce(item_prompt, '')) + length(coalesce(item_label, '')) + 61 AS INTEGER) AS n_tokens, CAST(length(coalesce(item_label, '')) + 11 AS INTEGER) AS n_learned FROM eval_items"
_PAD = len("<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n")
CHAT = CHAT.replace("61", str(_PAD))


def chats(spark, d, f):
    """Masks of the evaluation items as two-message conversations."""

    def run(p: pd.Series, a: pd.Series) -> pd.DataFrame:
        rows = [f([{"role": "user", "content": x}, {"role": "assistant", "content": y}]) for x, y in zip(p, a)]
        return pd.DataFrame(rows, columns=["n_tokens", "n_learned"])

    udf = F.pandas_udf(run, "n_tokens int, n_learned int")
    return table(spark, d, "eval_items").select("item_id", udf(F.coalesce("item_prompt", F.lit("")), F.coalesce("item_label", F.lit(""))).alias("x")).select("item_id", "x.*")


@book.add("M02_mask_prefixed", CHAT)
def m02(spark, d):
    return chats(spark, d, lambda m: (lambda r: (len(r[0]), sum(r[1])))(K.by_prefixed_message(m)))


@book.add("M05_mask_dispatch", CHAT)
def m05(spark, d):
    return chats(spark, d, lambda m: (lambda r: (len(r[0]), sum(r[1])))(K.loss_mask("single_response", m)))


@book.add("M06_header_length", "SELECT CAST(0 AS INTEGER) AS plain, CAST(length('<|tools|>[1]<|end|>') + 1 AS INTEGER) AS with_tools")
def m06(spark, d):
    return spark.createDataFrame([(K.header_length(), K.header_length(tools=[1]))], "plain int, with_tools int")


@book.add("M08_supervised_samples", "SELECT item_id, CAST(length(coalesce(item_prompt, '')) + length(coalesce(item_label, '')) + %d AS INTEGER) AS n_tokens, CAST(length(coalesce(item_label, '')) + 11 AS INTEGER) AS n_learned FROM eval_items" % _PAD)
def m08(spark, d):
    return chats(spark, d, lambda m: (lambda s: (len(s["tokens"]), sum(s["loss_mask"])))(K.supervised_sample(m)))


@book.add("W12_prefix_sum_mask", "SELECT item_id, CAST(length(coalesce(item_prompt, '')) + length(coalesce(item_label, '')) + %d AS INTEGER) AS n_tokens, CAST(length(coalesce(item_label, '')) + 11 AS INTEGER) AS n_learned FROM eval_items" % _PAD)
def w12(spark, d):
    return chats(spark, d, lambda m: (lambda r: (len(r[0]), sum(r[1])))(K.by_offsets(m, lambda t: [(ord(x), i, i + 1) for i, x in enumerate(t)], "\0")))


@book.add("U09_required_keys", "SELECT count(*) AS n FROM events")
def u09(spark, d):
    return R.require(table(spark, d, "events"), ["event_id", "user_id"]).agg(F.count(F.lit(1)).alias("n"))


@book.add("S21_buffer_write_and_read", "SELECT event_id // 9 AS instance_id, count(*) AS n_items FROM events GROUP BY 1 HAVING count(*) >= 9")
def s21(spark, d):
    """Items are appended to the stream's folder in several writes; complete groups are read from its output."""
    path = scratch_path(spark, "inbox")
    items = table(spark, d, "events").select(F.floor(c("event_id") / 9).alias("instance_id"), c("event_id").alias("item_id"), "value")
    for k in range(3):
        items.where(F.pmod("item_id", F.lit(3)) == k).write.mode("append").parquet(path)
    return B.run_to_end(B.complete_groups(B.file_stream(spark, path), 9), B.OUT, "inbox-out").select("instance_id", "n_items")


@book.add("S22_drained_groups", "SELECT event_id // 9 AS instance_id, count(*) AS n_items, CAST(1 AS INTEGER) AS read FROM events GROUP BY 1 HAVING count(*) >= 9")
def s22(spark, d):
    """Reads that drain: each gives the groups that were completed since the last one, and none twice."""
    inbox, out, cursor = (scratch_path(spark, x) for x in ("drain-inbox", "drain-groups", "drain-cursor"))
    items = table(spark, d, "events").select(F.floor(c("event_id") / 9).alias("instance_id"), c("event_id").alias("item_id"), "value")
    items.write.parquet(inbox)
    B.run_to_end(B.complete_groups(B.file_stream(spark, inbox), 9), B.OUT, out=out)
    reads = [B.drain(spark, out, cursor).withColumn("read", F.lit(k)) for k in (1, 2)]
    return reads[0].unionByName(reads[1]).select("instance_id", "n_items", "read")


@registry.register("rollout", "from_events")
def _rollout(spark, config, rollout_id, evaluation=False):
    s = V.samples(spark, config["dir"])
    return s.where((c("rollout_id") == rollout_id) & (c("status") != "aborted")) if evaluation else s.where(c("rollout_id") == rollout_id)


@book.add("H01_rollout_function", f"{S} SELECT sample_index, reward FROM s WHERE rollout_id = 5")
def h01(spark, d):
    return registry.get("rollout", "from_events")(spark, {"dir": d}, 5).select("sample_index", "reward")


@book.add("H17_evaluation_function", f"{S} SELECT sample_index, reward FROM s WHERE rollout_id = 5 AND status <> 'aborted'")
def h17(spark, d):
    return registry.get("rollout", "from_events")(spark, {"dir": d}, 5, evaluation=True).select("sample_index", "reward")


@registry.register("generate", "echo_twice")
def _generate(rows):
    def run(parts):
        for p in parts:
            yield pd.concat([p.assign(attempt=0), p.assign(attempt=1)])

    return rows.mapInPandas(run, "p_partkey bigint, attempt int")


@book.add("H02_generate_function", "SELECT p_partkey, CAST(a AS INTEGER) AS attempt FROM part, (SELECT unnest([0, 1]) AS a)")
def h02(spark, d):
    return registry.get("generate", "echo_twice")(table(spark, d, "part").select("p_partkey"))


@registry.register("reward", "short_is_good")
def _reward(response, label):
    return F.when(F.length(response) < 10, 1.0).otherwise(0.0)


@book.add("H03_reward_function", "SELECT item_id, CASE WHEN length(item_label) < 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM eval_items")
def h03(spark, d):
    return table(spark, d, "eval_items").select("item_id", registry.get("reward", "short_is_good")(F.concat(F.coalesce("item_label", F.lit("xxxxxxxxxx")), F.lit("1234567")), F.lit("")).alias("reward"))


@registry.register("buffer_filter", "first")
def _first(rows, n):
    kept = G.head_rows(rows, "sample_index", n)
    return kept, rows.join(kept.select("sample_index"), "sample_index", "left_anti")


@book.add("H05_buffer_filter", f"{S} SELECT sample_index < 700 AS selected, count(*) AS n FROM s GROUP BY 1")
def h05(spark, d):
    taken, left = registry.get("buffer_filter", "first")(V.samples(spark, d).select("sample_index"), 700)
    both = taken.withColumn("selected", F.lit(True)).unionByName(left.withColumn("selected", F.lit(False)))
    return both.groupBy("selected").agg(F.count(F.lit(1)).alias("n"))


@registry.register("sample_filter", "too_long")
def _too_long(samples):
    return F.col("response_length") > 150


@registry.register("data_postprocess", "only_gains")
def _only_gains(rows):
    return rows.withColumn("mask", F.zip_with("mask", "adv", lambda m, a: F.when(a < 0, 0).otherwise(m)))


@registry.register("importance", "at_most_one")
def _at_most_one(train, rollout, mask):
    return F.zip_with(train, rollout, lambda a, b: F.least(F.exp(a - b), F.lit(1.0))), mask


@registry.register("loss_reducer", "worst")
def _worst(x, mask):
    return F.max(T.masked_sum(x, mask))


@registry.register("log", "written_elsewhere")
def _written_elsewhere(metrics):
    return True


@book.add("H06_sample_filter", f"{S} SELECT sample_index, response_length > 150 AS remove_sample FROM s")
def h06(spark, d):
    s = V.samples(spark, d)
    return s.select("sample_index", registry.get("sample_filter", "too_long")(s).alias("remove_sample"))


@book.add("H08_data_postprocess", f"{RW} SELECT seq, CAST(sum(CASE WHEN adv < 0 THEN 0 ELSE mask END) AS BIGINT) AS n FROM r GROUP BY seq")
def h08(spark, d):
    return registry.get("data_postprocess", "only_gains")(V.sequences(spark, d)).select("seq", F.aggregate("mask", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n"))


@book.add("H09_loss_function", f"{RW}, q AS (SELECT seq, sum(val * val * mask) / greatest(sum(mask), 1) AS x FROM r GROUP BY seq) SELECT round(avg(x), 6) AS loss FROM q")
def h09(spark, d):
    return E.loss(V.sequences(spark, d), "own", custom=lambda df: F.transform("val", lambda v: v * v)).select(F.round("loss", 6).alias("loss"))


@book.add("H10_importance_function", f"{RW} SELECT seq, round(sum(least(exp(old - base), 1.0) * mask), 5) AS total FROM r GROUP BY seq")
def h10(spark, d):
    w, m = registry.get("importance", "at_most_one")(c("old"), c("base"), c("mask"))
    return V.sequences(spark, d).select("seq", F.round(T.masked_sum(w, m), 5).alias("total"))


@book.add("H11_loss_reducer", f"{RW}, q AS (SELECT seq, sum(val * mask) AS x FROM r GROUP BY seq) SELECT round(max(x), 6) AS worst FROM q")
def h11(spark, d):
    reducer = registry.get("loss_reducer", "worst")
    return V.sequences(spark, d).agg(F.round(reducer(c("val"), c("mask")), 6).alias("worst"))


@book.add("H12_advantage_function", f"{RW} SELECT seq, pos, round(-val, 6) + 0.0 AS adv FROM r")
def h12(spark, d):
    own = lambda df: df.withColumn("advantages", F.transform("val", lambda v: -v))
    return per_token(E.advantages(batch(spark, d), "custom", custom=own), c("advantages"))


@book.add("H10_importance_in_objective", f"{RW}, z AS (SELECT seq, mask, greatest(-exp(new - old) * adv, -greatest(least(exp(new - old), 1.2), 0.8) * adv) * least(exp(old - base), 1.0) AS x FROM r), q AS (SELECT seq, sum(x * mask) AS x FROM z GROUP BY seq) SELECT round(max(x) / count(*), 6) + 0.0 AS pg_loss FROM q")
def h10o(spark, d):
    """A custom importance function and reducer inside the policy objective."""
    q = V.sequences(spark, d).withColumns({"rollout": c("base"), "entropy": c("val")})
    out = E.policy_objective(q, 0.2, 0.2, importance=registry.get("importance", "at_most_one"), reducer=registry.get("loss_reducer", "worst"))
    return out.select((F.round("pg_loss", 6) + F.lit(0.0)).alias("pg_loss"))


@book.add("H07_all_samples_callback", f"{S} SELECT status, count(*) AS seen FROM s GROUP BY status")
def h07(spark, d):
    """The callback sees every sample, those too that a filter drops from training; here it writes them to a table."""
    path = scratch_path(spark, "all-samples")

    @registry.register("all_samples", "keep_copy")
    def keep_copy(samples):
        samples.select("sample_index", "status").write.parquet(path)

    kept = registry.process_samples(V.samples(spark, d), keep=c("status") == "completed", callback=registry.get("all_samples", "keep_copy"))
    assert "status" in kept.columns
    return spark.read.parquet(path).groupBy("status").agg(F.count(F.lit(1)).alias("seen"))


@book.add("H15_log_hook", "SELECT 'default' AS log, round(avg(value), 6) AS mean FROM events")
def h15(spark, d):
    """A hook that returns true skips the default log; without one the default sink gets the metrics."""
    path = scratch_path(spark, "default-log")
    metrics = table(spark, d, "events").agg(F.round(F.avg("value"), 6).alias("mean"))
    sink = lambda m: m.write.mode("append").parquet(path)
    registry.log(metrics, sink, hook=registry.get("log", "written_elsewhere"))
    registry.log(metrics, sink)
    return spark.read.schema(metrics.schema).parquet(path).select(F.lit("default").alias("log"), "mean")


@book.add("H16_data_source", "WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY ((p_partkey + 42) * 7919 + 104729) % 1000003, p_partkey) AS rn FROM part) SELECT p_partkey FROM p WHERE rn > 20 AND rn <= 50")
def h16(spark, d):
    rows = table(spark, d, "part").select("p_partkey")
    source = E.PromptSource(spark, rows, "p_partkey")
    source.get(20)
    path = scratch_path(spark, "cursor")
    source.save(path, 1)
    again = E.PromptSource(spark, rows, "p_partkey")
    again.load(path, 1)
    return again.get(30)


@book.add("H18_generator_registry", "SELECT 'doubler' AS task_type, CAST(sum(p_size) * 2 AS BIGINT) AS total FROM part")
def h18(spark, d):
    registry.register("generator", "doubler")(lambda rows: rows.withColumn("p_size", c("p_size") * 2))
    out = registry.get("generator", "doubler")(table(spark, d, "part"))
    return out.agg(F.sum("p_size").alias("total")).select(F.lit("doubler").alias("task_type"), "total")


@book.add("H19_config_override", "SELECT 'tower' AS name, CAST(8 AS INTEGER) AS n, CAST(0.5 AS DOUBLE) AS top_p")
def h19(spark, d):
    got = registry.override({"name": "tower", "n": 8}, {"n": 4, "top_p": None}, {"top_p": 0.5, "n": 1}, ["name", "n", "top_p"])
    return spark.createDataFrame([(got["name"], got["n"], got["top_p"])], "name string, n int, top_p double")
