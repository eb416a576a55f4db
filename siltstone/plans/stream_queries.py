"""Queries of streams with keyed state, run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import traces as S
from siltstone.plans import views as V
from siltstone.plans.book import Book
from siltstone.session import scratch_path, table
from siltstone.streaming import buffer as B

book = Book()
c = F.col


def _groups(spark, d, size):
    items = B.file_stream(spark, f"{d}/events.parquet").select(F.floor(c("event_id") / 9).alias("instance_id"), c("event_id").alias("item_id"), "value")
    return B.run_to_end(B.complete_groups(items, size), B.OUT, "groups")


@book.add("T01_group_completion", "SELECT event_id // 9 AS instance_id, count(*) AS n_items, round(sum(value), 6) AS total FROM events GROUP BY 1 HAVING count(*) >= 9")
def t01(spark, d):
    return _groups(spark, d, 9).select("instance_id", "n_items", F.round("total", 6).alias("total"))


@book.add("T02_transform_on_emit", "SELECT event_id // 9 AS instance_id, round(avg(value), 6) AS mean FROM events GROUP BY 1 HAVING count(*) >= 9")
def t02(spark, d):
    return _groups(spark, d, 9).select("instance_id", F.round(c("total") / c("n_items"), 6).alias("mean"))


@book.add("T03_delta_statistics", "WITH g AS (SELECT count(*) AS n, sum(value) AS t FROM events GROUP BY event_id // 9 HAVING count(*) >= 9) SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_items, avg(n) AS mean_size, round(sum(t) / sum(n), 6) AS mean_value FROM g")
def t03(spark, d):
    return B.batch_statistics(_groups(spark, d, 9)).withColumn("mean_value", F.round("mean_value", 6))


@book.add("T05_ready_count", "WITH g AS (SELECT count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 64) SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS ready FROM g")
def t05(spark, d):
    return B.ready_count(table(spark, d, "events"), "user_id", 64)


@book.add("T08_drain_without_aborted", f"WITH {V.SAMPLES}, g AS (SELECT group_index FROM s GROUP BY group_index HAVING count(*) >= 8 AND NOT bool_or(status = 'aborted')) SELECT group_index FROM g ORDER BY group_index LIMIT 64")
def t08(spark, d):
    s = V.samples(spark, d)
    ready = s.groupBy("group_index").agg(F.count(F.lit(1)).alias("n"), F.bool_or(c("status") == "aborted").alias("bad"))
    return ready.where("n >= 8 AND NOT bad").orderBy("group_index").limit(64).select("group_index")


@book.add("T08_requeued_groups", "SELECT event_id // 8 AS instance_id, count(*) AS n_items, CAST(CASE WHEN bool_or(event_type = 'error') THEN 2 ELSE 1 END AS BIGINT) AS attempts FROM events GROUP BY 1 HAVING count(*) >= 8")
def t08r(spark, d):
    """A stream's consumer: groups with an aborted sample go back to the queue and come out on their second attempt."""
    inbox = scratch_path(spark, "requeue-inbox")
    items = table(spark, d, "events").select(F.floor(c("event_id") / 8).alias("instance_id"), c("event_id").alias("item_id"), (c("event_type") == "error").cast("double").alias("value"))
    items.write.parquet(inbox)
    return B.requeue(items, 8, inbox, lambda rows: rows.withColumn("value", F.lit(0.0)))


@book.add("T11_partial_rollouts_kept", f"WITH {V.SAMPLES} SELECT sample_index, rollout_id AS start_rollout_id FROM s WHERE status = 'aborted'")
def t11(spark, d):
    return V.samples(spark, d).where("status = 'aborted'").select("sample_index", c("rollout_id").alias("start_rollout_id"))


@book.add("T12_trace_events", "SELECT event_type AS name, count(*) AS n, count(DISTINCT user_id) AS n_traces FROM events GROUP BY event_type")
def t12(spark, d):
    return table(spark, d, "events").groupBy(c("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_traces"))


@book.add(
    "T15_slow_requests",
    "WITH x AS (SELECT user_id, event_id AS seq, event_id // 100 AS step, value FROM events), y AS (SELECT *, max(value) OVER (PARTITION BY user_id, step // 10 ORDER BY step, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM x) SELECT seq, value > coalesce(top, 0.0) + 5.0 AS slow FROM y",
)
def t15(spark, d):
    rows = table(spark, d, "events").select("user_id", c("event_id").alias("seq"), F.floor(c("event_id") / 100).alias("step"), "value")
    return B.slow_requests(rows, "user_id", "step", "value", 10, 5.0).select("seq", "slow")


_IDS = "user_id AS trace_id, event_id AS sample_id, event_id // 8 AS group_id, event_id % 4 AS attempt, CASE WHEN event_id % 3 = 0 THEN event_id - 1 END AS parent_span_id"


@book.add("T16_trace_context", f"SELECT event_id, 1 AS version, {_IDS} FROM events")
def t16(spark, d):
    """The context's ids through a JSON payload and back, as it crosses a process boundary."""
    e = table(spark, d, "events")
    ids = {"trace_id": c("user_id"), "sample_id": c("event_id"), "group_id": F.floor(c("event_id") / 8), "attempt": F.pmod("event_id", F.lit(4)), "parent_span_id": F.when(F.pmod("event_id", F.lit(3)) == 0, c("event_id") - 1)}
    return S.import_context(e.select("event_id", S.export_context(ids).alias("payload")), "payload").drop("payload")


@book.add("T12_attempts", "SELECT user_id AS trace_id, event_id, CAST(sum(CAST(event_type = 'error' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS before FROM events")
def t12a(spark, d):
    """Each failed event starts the trace's next attempt."""
    e = table(spark, d, "events").withColumn("failed", (c("event_type") == "error").cast("bigint"))
    return S.attempts(e, ["user_id"], "event_id", "failed").select(c("user_id").alias("trace_id"), "event_id", F.when(c("_first"), F.lit(None)).otherwise(c("attempt")).cast("bigint").alias("before"))


@book.add("T04_timed_out_groups", "SELECT event_id // 9 AS instance_id, count(*) AS n_items, count(*) >= 9 AS finished FROM events GROUP BY 1")
def t04(spark, d):
    """Groups that stay incomplete come out unfinished once the watermark has passed them."""
    items = table(spark, d, "events").select(F.floor(c("event_id") / 9).alias("instance_id"), c("event_id").alias("item_id"), "value", c("ts").cast("timestamp").alias("event_time"))
    inbox, out, state = (scratch_path(spark, x) for x in ("timeout-inbox", "timeout-groups", "timeout-state"))
    items.write.parquet(inbox)
    schema = "instance_id bigint, item_id bigint, value double, event_time timestamp"
    stream = spark.readStream.schema(schema).parquet(inbox).withWatermark("event_time", "1 day")
    groups = B.timed_out_groups(stream, 9, "2 days")
    B.run_to_end(groups, B.OUT, out=out, state=state)
    for year in (2250, 2251):  # rows of no group, which move the watermark on
        spark.createDataFrame([(None, None, None)], "instance_id bigint, item_id bigint, value double").withColumn("event_time", F.lit(f"{year}-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(inbox)
        B.run_to_end(groups, B.OUT, out=out, state=state)
    return spark.read.schema(B.OUT).parquet(out).select("instance_id", "n_items", "finished")
