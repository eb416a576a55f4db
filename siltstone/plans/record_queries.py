"""Queries of sources, sinks, row records and extension points."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import shaping as H
from siltstone.functions.masks import segments
from siltstone.operators import groups as G
from siltstone.operators.ordering import positions, repeated_input
from siltstone.plans import registry
from siltstone.plans import views as V
from siltstone.plans.book import Book
from siltstone.session import scratch_path, table
from siltstone.sources import records as R

book = Book()
c = F.col
S = f"WITH {V.SAMPLES}"
EVENT = "event_id bigint, user_id bigint, event_type string, value double"


def json_lines(df, spark, label):
    """The rows as JSON lines, with blank and broken lines among them."""
    path = scratch_path(spark, label) + ".jsonl"
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    bad = spark.createDataFrame([("",), ("   ",), ('{"event_id": 1, "user',), ("not json",)], "value string")
    rows.unionByName(bad).write.text(path)
    return path


@book.add("S01_jsonl_scan", "SELECT event_id, user_id, event_type, value FROM events")
def s01(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return R.read(spark, json_lines(e, spark, "s01"), EVENT)


@book.add("S02_parquet_scan", "SELECT p_partkey, p_name FROM part")
def s02(spark, d):
    return R.read(spark, f"{d}/part.parquet").select("p_partkey", "p_name")


@book.add("S03_read_errors", "SELECT 'missing' AS kind, true AS refused UNION ALL SELECT 'suffix', true UNION ALL SELECT 'slice', true")
def s03(spark, d):
    def refused(f):
        try:
            f()
        except (FileNotFoundError, ValueError):
            return True
        return False

    rows = [
        ("missing", refused(lambda: R.read(spark, f"{d}/nothing.parquet"))),
        ("suffix", refused(lambda: R.read(spark, f"{d}/part.*"))),
        ("slice", refused(lambda: R.parse_path("x.parquet@[-5:10]"))),
    ]
    return spark.createDataFrame(rows, "kind string, refused boolean")


@book.add("S04_path_slice", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 40 OFFSET 10")
def s04(spark, d):
    return R.read(spark, f"{d}/part.parquet@[10:50]", order="p_partkey").select("p_partkey", "p_name")


@book.add("S05_column_binding", "SELECT prompt, label, json_extract_string(metadata, '$.rm_type') AS rm_type FROM samples")
def s05(spark, d):
    bound = R.bind(table(spark, d, "samples"), "prompt", "label", "metadata")
    return bound.select("prompt", "label", c("metadata")["rm_type"].alias("rm_type"))


@book.add("S06_rollout_dump", f"{S} SELECT sample_index, reward FROM s WHERE rollout_id = 3")
def s06(spark, d):
    path = scratch_path(spark, "dump")
    s = V.samples(spark, d)
    for i in (2, 3):
        R.write_dump(s.where(c("rollout_id") == i).drop("rollout_id"), path, i)
    R.write_dump(s.where("rollout_id = 4").drop("rollout_id"), path, 3, evaluation=True)
    return R.read_dump(spark, path, 3).select("sample_index", "reward")


@book.add("S07_rollout_source_subsample", f"{S}, k AS (SELECT sample_index, row_number() OVER (ORDER BY sample_index) AS rn, count(*) OVER () AS n FROM s WHERE rollout_id = 2) SELECT sample_index FROM k WHERE rn <= CAST(floor(n * 0.25) AS BIGINT) // 2 OR rn > n - (CAST(floor(n * 0.25) AS BIGINT) - CAST(floor(n * 0.25) AS BIGINT) // 2)")
def s07(spark, d):
    path = scratch_path(spark, "dump")
    R.write_dump(V.samples(spark, d).where("rollout_id = 2").drop("rollout_id"), path, 2)
    return G.head_and_tail(R.read_dump(spark, path, 2), "sample_index", 0.25).select("sample_index")


@book.add("S08_rank_dump", f"{S} SELECT sample_index % 4 AS rank, count(*) AS n FROM s GROUP BY 1")
def s08(spark, d):
    path = scratch_path(spark, "ranks")
    s = V.samples(spark, d)
    R.write_ranks(s.withColumn("rank", F.pmod("sample_index", F.lit(4))).drop("rollout_id"), path, 1)
    return spark.read.parquet(path).groupBy(c("rank").cast("bigint").alias("rank")).agg(F.count(F.lit(1)).alias("n"))


@book.add("S09_source_cursor", "SELECT CAST(64 AS BIGINT) AS sample_offset, CAST(1 AS BIGINT) AS epoch_id, 'x' AS tag")
def s09(spark, d):
    path = scratch_path(spark, "state")
    for i, (off, ep) in enumerate([(32, 0), (64, 1), (96, 1)]):
        R.save_state(spark, path, rollout_id=i, sample_offset=off, epoch_id=ep, group_index=off, sample_index=off * 4, metadata={"tag": "x"})
    got = R.load_state(spark, path, 1)
    return spark.createDataFrame([(got["sample_offset"], got["epoch_id"], got["metadata"]["tag"])], "sample_offset bigint, epoch_id bigint, tag string")


@book.add("S10_reload_same_shuffle", "SELECT p_partkey, row_number() OVER (ORDER BY ((p_partkey + 45) * 7919 + 104729) % 1000003, p_partkey) - 1 AS pos FROM part")
def s10(spark, d):
    from siltstone.operators.ordering import mix_key

    path = scratch_path(spark, "state")
    R.save_state(spark, path, rollout_id=7, sample_offset=0, epoch_id=3, group_index=0, sample_index=0, metadata={})
    epoch = R.load_state(spark, path, 7)["epoch_id"]
    p = table(spark, d, "part").select("p_partkey").withColumn("k", mix_key(c("p_partkey"), 42 + epoch))
    return positions(p, ["k", "p_partkey"]).select("p_partkey", "pos")


@book.add("S11_map_to_jsonl", "SELECT item_id, item_prompt AS prompt, coalesce(item_label, '') AS label FROM eval_items")
def s11(spark, d):
    path = scratch_path(spark, "hub") + ".jsonl"
    table(spark, d, "eval_items").select("item_id", c("item_prompt").alias("prompt"), F.coalesce("item_label", F.lit("")).alias("label")).write.json(path)
    return R.read(spark, path, "item_id bigint, prompt string, label string")


@book.add("S12_role_checked_parquet", "SELECT item_id, CAST(2 AS INTEGER) AS n, 'assistant' AS last_role FROM eval_items")
def s12(spark, d):
    path = scratch_path(spark, "sft") + ".parquet"
    turn = lambda r, x: F.struct(F.lit(r).alias("role"), F.coalesce(x, F.lit("")).alias("content"))
    rows = table(spark, d, "eval_items").select("item_id", F.array(turn("user", c("item_prompt")), turn("assistant", c("item_label"))).alias("messages"))
    R.role_checked(rows, "messages").write.parquet(path)
    return R.read(spark, path).select("item_id", F.size("messages").alias("n"), F.element_at("messages", -1)["role"].alias("last_role"))


@book.add("S13_task_list", "SELECT s_suppkey AS index, '{\"name\":\"' || s_name || '\"}' AS metadata FROM supplier")
def s13(spark, d):
    path = scratch_path(spark, "tasks") + ".jsonl"
    table(spark, d, "supplier").select(c("s_suppkey").alias("index"), F.to_json(F.struct(c("s_name").alias("name"))).alias("metadata")).write.json(path)
    return R.read(spark, path, "index bigint, metadata string")


@book.add("S14_default_instance_ids", "SELECT message_id, coalesce(sample_index, message_id) AS instance_id FROM message_rows")
def s14(spark, d):
    return table(spark, d, "message_rows").select("message_id", F.coalesce("sample_index", "message_id").alias("instance_id"))


@book.add(
    "S14_repeated_input",
    "WITH m AS (SELECT message_id, max(sample_index) AS sample_index FROM message_rows GROUP BY message_id), t AS (SELECT message_id, coalesce(sample_index, message_id) AS instance_id, CAST(r AS INTEGER) AS repeat_idx FROM m, (SELECT unnest([0, 1, 2]) AS r)) SELECT *, row_number() OVER (ORDER BY repeat_idx, ((message_id + repeat_idx + 42) * 7919 + 104729) % 1000003, message_id) - 1 AS pos FROM t",
)
def s14r(spark, d):
    m = table(spark, d, "message_rows").groupBy("message_id").agg(F.max("sample_index").alias("instance_id"))
    return repeated_input(m, "message_id", "instance_id", 3, 42)


@book.add("S15_corpus", "SELECT doc_id AS id, coalesce(title, '') || chr(10) || coalesce(text, '') AS contents FROM documents")
def s15(spark, d):
    path = scratch_path(spark, "corpus") + ".jsonl"
    docs = table(spark, d, "documents")
    docs.select(c("doc_id").alias("id"), F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("contents")).write.json(path)
    return R.read(spark, path, "id bigint, contents string")


@book.add("S17_trace_file", "SELECT p_partkey AS tid, p_name AS name, p_retailprice AS dur FROM part")
def s17(spark, d):
    path = scratch_path(spark, "trace")
    event = F.struct(F.lit("kernel").alias("cat"), F.lit("X").alias("ph"), c("p_name").alias("name"), F.lit(0.0).alias("ts"), c("p_retailprice").alias("dur"), c("p_partkey").alias("tid"))
    parts = table(spark, d, "part").groupBy(F.pmod("p_partkey", F.lit(4)).alias("rank")).agg(F.collect_list(event).alias("traceEvents"))
    parts.select("traceEvents").repartition(4).write.option("compression", "gzip").json(path)
    return R.read_trace(spark, path).select("tid", "name", "dur")


@book.add("S18_cached_result", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def s18(spark, d):
    cache = scratch_path(spark, "cache")
    build = lambda p: p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    R.cached(spark, f"{d}/part.parquet", cache, build)
    return R.cached(spark, f"{d}/part.parquet", cache, build)


@book.add("S19_request_log", "SELECT CAST(r AS INTEGER) AS replay_round, event_id AS line_number, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN 'invalid request line' END AS error, CASE WHEN event_type <> 'error' THEN event_type END AS model FROM events, (SELECT unnest([0, 1]) AS r)")
def s19(spark, d):
    path = scratch_path(spark, "requests")
    body = F.to_json(F.struct(c("event_type").alias("model"), F.array(F.struct(F.lit("user").alias("role"), F.lit("x").alias("content"))).alias("messages")))
    line = F.concat(c("event_id").cast("string"), F.lit("\t"), F.when(c("event_type") == "error", F.lit('{"model": ')).otherwise(body))
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    return R.read_requests(spark, path, 2).select("replay_round", "line_number", "ok", "error", "model")


@book.add("S20_input_error_rows", "SELECT count(*) AS n_errors FROM events WHERE event_type = 'error'")
def s20(spark, d):
    return s19(spark, d).where("NOT ok AND replay_round = 0").agg(F.count(F.lit(1)).alias("n_errors"))


@book.add("S23_required_columns", "SELECT sample_index, status FROM samples")
def s23(spark, d):
    return R.require(table(spark, d, "samples"), ["sample_index", "status", "reward"]).select("sample_index", "status")


@book.add("S28_eval_sources", "SELECT d.dataset_name, count(i.item_id) AS n_items, count(i.item_id) * coalesce(any_value(d.n_samples_per_eval_prompt), 1) AS n_samples FROM eval_datasets d LEFT JOIN eval_items i USING (dataset_path) GROUP BY d.dataset_name")
def s28(spark, d):
    """Every set of the config with its items, in one join."""
    sets, items = table(spark, d, "eval_datasets"), table(spark, d, "eval_items")
    sizes = items.groupBy("dataset_path").agg(F.count("item_id").alias("n_items"))
    joined = sets.join(sizes, "dataset_path", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    return joined.select("dataset_name", "n_items", (c("n_items") * F.coalesce("n_samples_per_eval_prompt", F.lit(1))).alias("n_samples"))


@book.add("S29_metric_sink", "SELECT CAST(1 AS BIGINT) AS step, 'loss' AS metric, 0.5::DOUBLE AS value UNION ALL SELECT 2, 'loss', 0.25 UNION ALL SELECT 2, 'kl', 0.125")
def s29(spark, d):
    path = scratch_path(spark, "metrics")
    R.append_metrics(spark, path, 1, {"loss": 0.5})
    R.append_metrics(spark, path, 2, {"loss": 0.25, "kl": 0.125})
    return spark.read.parquet(path)


@book.add("S31_shuffle_by_rank", f"{S} SELECT sample_index % 4 AS rank, count(*) AS n, CAST(sum(response_length) AS BIGINT) AS tokens FROM s GROUP BY 1")
def s31(spark, d):
    s = V.samples(spark, d).withColumn("rank", F.pmod("sample_index", F.lit(4)))
    return s.repartitionByRange(4, "rank").groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.sum("response_length").alias("tokens"))


@book.add("P01_string_to_conversation", "SELECT item_id, 'user' AS role, item_prompt AS content FROM eval_items")
def p01(spark, d):
    return table(spark, d, "eval_items").select("item_id", H.as_conversation(c("item_prompt"))[0].alias("m")).select("item_id", "m.role", "m.content")


@book.add("P03_tools_column", "SELECT item_id, '[{\"name\":\"search\"}]' AS tools FROM eval_items")
def p03(spark, d):
    rows = table(spark, d, "eval_items").withColumn("tools", F.lit('[{"name":"search"}]'))
    return R.bind(rows.withColumnRenamed("item_id", "label"), "item_prompt", "label", None, "tools").select(c("label").alias("item_id"), c("metadata")["tools"].alias("tools"))


@book.add("P06_record_round_trip", "SELECT sample_index, response_length, weight_version FROM samples")
def p06(spark, d):
    rec = H.record(table(spark, d, "samples"), ["sample_index", "status"])
    x = F.from_json("extra", "response_length int, weight_version string")
    return rec.select("sample_index", x["response_length"].alias("response_length"), x["weight_version"].alias("weight_version"))


@book.add("P16_dataset_list", "SELECT 'a' AS name, 'x' AS path UNION ALL SELECT 'b', 'y'")
def p16(spark, d):
    shapes = [{"a": "x", "b": {"path": "y"}}, [{"name": "a", "path": "x"}, {"name": "b", "path": "y"}], ["a", "x", "b", "y"]]
    lists = [registry.dataset_list(s) for s in shapes]
    if not lists[0] == lists[1] == lists[2]:
        raise AssertionError(lists)
    return spark.createDataFrame([(x["name"], x["path"]) for x in lists[0]], "name string, path string")


@book.add("P18_buffer_record", f"{S} SELECT sample_index, CASE WHEN status = 'truncated' THEN 'truncated' ELSE 'completed' END AS status, reward FROM s")
def p18(spark, d):
    finish = F.when(c("status") == "truncated", "length").otherwise("stop")
    return V.samples(spark, d).select("sample_index", H.status_of(finish).alias("status"), "reward")


@book.add("P19_worker_records", "SELECT user_id AS uid, CAST(sum(CASE WHEN event_type IN ('purchase', 'click') THEN 1 ELSE 0 END) AS BIGINT) AS round_number, count(*) AS n_messages, arg_max(event_type, event_id) AS finish_reason FROM events GROUP BY user_id")
def p19(spark, d):
    """A worker's record per instance: rounds are the assistant's messages, the rest stands in the extra fields."""
    turn = F.struct("event_id", F.when(c("event_type").isin("purchase", "click"), "assistant").otherwise("user").alias("role"), c("event_type").alias("content"))
    chats = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(turn)).alias("messages"))
    return chats.select(c("user_id").alias("uid"), F.size(F.filter("messages", lambda m: m["role"] == "assistant")).cast("bigint").alias("round_number"), F.size("messages").cast("bigint").alias("n_messages"), F.element_at("messages", -1)["content"].alias("finish_reason"))


@book.add("P20_payload_normalised", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'base' ELSE event_type END AS model, CASE WHEN event_id % 2 = 0 THEN 'true' END AS stream, CASE WHEN event_id % 2 = 0 THEN 'x' END AS options, 'forced' AS forced, 'false' AS off, CAST(NULL AS VARCHAR) AS off_options FROM events")
def p20(spark, d):
    """Payloads as they are replayed: with a default model and inherited streaming, and with a forced model and no streaming."""
    even = F.pmod("event_id", F.lit(2)) == 0
    raw = F.to_json(F.struct(F.when(c("event_type") == "view", " ").otherwise(c("event_type")).alias("model"), F.when(even, True).alias("stream"), F.when(even, "x").alias("stream_options")))
    x = F.from_json(raw, "map<string,string>")
    rows = table(spark, d, "events").select("event_id", H.normalised_payload(x, None, "base").alias("a"), H.normalised_payload(x, "forced", "base", "false").alias("b"))
    return rows.select("event_id", c("a")["model"].alias("model"), c("a")["stream"].alias("stream"), c("a")["stream_options"].alias("options"), c("b")["model"].alias("forced"), c("b")["stream"].alias("off"), c("b")["stream_options"].alias("off_options"))


@book.add("P26_per_turn_tokens", "SELECT event_id, CAST(5 + event_id % 4 AS INTEGER) AS n_tokens, CAST(event_id % 4 AS INTEGER) AS n_response FROM events")
def p26(spark, d):
    prompt, answer = F.array_repeat(F.lit(7), 5), F.array_repeat(F.lit(9), F.pmod("event_id", F.lit(4)).cast("int"))
    return table(spark, d, "events").select("event_id", F.size(F.concat(prompt, answer)).alias("n_tokens"), F.size(answer).alias("n_response"))


@book.add("P27_segment_append", "SELECT user_id, CAST(count(*) AS INTEGER) AS n, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS learned, round(sum(CASE WHEN event_type <> 'error' THEN -value / 500.0 ELSE 0.0 END), 6) AS lp FROM events GROUP BY user_id")
def p27(spark, d):
    """Segments appended to a user's conversation: the model's count, tools' and users' don't; sums need no order."""
    model = c("event_type") != "error"
    lp = F.when(model, -c("value") / 500.0).otherwise(0.0)
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum(model.cast("bigint")).alias("learned"), F.round(F.sum(lp), 6).alias("lp"))


@book.add("P35_turn_log", f"{S}, {V.TURNS} SELECT user_id, turn_idx, reward, response_length, CASE WHEN removed THEN 'abort' ELSE 'stop' END AS finish FROM t")
def p35(spark, d):
    return V.turns(spark, d).select("user_id", "turn_idx", "reward", "response_length", F.when(c("removed"), "abort").otherwise("stop").alias("finish"))


@book.add("P36_sft_answer", "SELECT item_id, 'Answer: \\boxed{' || coalesce(item_label, '') || '}' AS content FROM eval_items")
def p36(spark, d):
    return table(spark, d, "eval_items").select("item_id", F.concat(F.lit("Answer: \\boxed{"), F.coalesce("item_label", F.lit("")), F.lit("}")).alias("content"))


@book.add("F01_long_prompts", "SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '')) <= 200")
def f01(spark, d):
    from siltstone.operators.retrieval import terms

    return table(spark, d, "documents").where(F.size(terms(c("text"))) <= 200).where("text IS NOT NULL").select("doc_id")


@book.add("F09_all_samples_hook", f"{S} SELECT status, count(*) AS n FROM s GROUP BY status")
def f09(spark, d):
    seen = scratch_path(spark, "all")
    s = V.samples(spark, d)
    s.write.parquet(seen)
    return spark.read.parquet(seen).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@book.add("G02_group_scores", f"{S} SELECT group_index, sample_index, row_number() OVER (PARTITION BY group_index ORDER BY value DESC, sample_index) AS place FROM s")
def g02(spark, d):
    import pandas as pd

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["value", "sample_index"], ascending=[False, True])
        return pdf.assign(place=range(1, len(pdf) + 1))[["group_index", "sample_index", "place"]]

    return V.samples(spark, d).select("group_index", "sample_index", "value").groupBy("group_index").applyInPandas(score, "group_index bigint, sample_index bigint, place bigint")


@book.add("G04_repeat_seeds", "SELECT event_id, 1234 + event_id % 8 AS seed FROM events")
def g04(spark, d):
    return table(spark, d, "events").select("event_id", (F.pmod("event_id", F.lit(8)) + 1234).alias("seed"))


@book.add(
    "G06_conversation_segments",
    "WITH e AS (SELECT user_id, event_id, event_type, event_type IN ('purchase', 'click') AS learn FROM events), l AS (SELECT *, CASE WHEN lag(learn) OVER (PARTITION BY user_id ORDER BY event_id) = learn THEN 0 ELSE 1 END AS new FROM e), r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS BIGINT) AS segment FROM l) SELECT user_id, segment, bool_and(learn) AS learn, count(*) AS n_messages, string_agg(event_type, '' ORDER BY event_id) AS text FROM r GROUP BY user_id, segment",
)
def g06(spark, d):
    rows = table(spark, d, "events").withColumn("role", F.when(c("event_type").isin("purchase", "click"), "assistant").otherwise("user"))
    return segments(rows, ["user_id"], "event_id", "role", "event_type")


@registry.register("reward_postprocess", "centred")
def _centred(samples):
    return G.normalise(samples, ["group_index"], "reward", "grpo", std=False)


@registry.register("group_filter", "mixed")
def _mixed(samples):
    return samples.groupBy("group_index").agg((F.max("reward") > F.min("reward")).alias("keep"))


@book.add("H04_named_group_filter", f"{S} SELECT group_index, max(reward) > min(reward) AS keep, CAST(NULL AS VARCHAR) AS reason FROM s GROUP BY group_index")
def h04(spark, d):
    return registry.decide(registry.get("group_filter", "mixed"), V.samples(spark, d), ["group_index"])


@book.add("H13_named_reward_hook", f"{S} SELECT sample_index, round(reward - avg(reward) OVER (PARTITION BY group_index), 6) + 0.0 AS norm_reward FROM s")
def h13(spark, d):
    out = registry.get("reward_postprocess", "centred")(V.samples(spark, d))
    return out.select("sample_index", (F.round("norm_reward", 6) + F.lit(0.0)).alias("norm_reward"))


@book.add("H14_hook_by_path", f"{S} SELECT sample_index, CAST(response_length AS INTEGER) AS n FROM s")
def h14(spark, d):
    convert = registry.get("convert", "siltstone.functions.shaping.training_columns")
    return convert(V.samples(spark, d).withColumn("remove_sample", F.lit(False))).select("sample_index", F.size("loss_mask").alias("n"))
