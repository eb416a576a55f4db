"""Completing sample groups from a stream, with keyed state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.session import scratch_path

OUT = "instance_id bigint, n_items bigint, total double, finished boolean"


def complete_groups(items: DataFrame, size: int, timeout_ms: int | None = None) -> DataFrame:
    """Stream of items (instance_id, item_id, value) to groups: a group comes out, and its state is dropped, once it has ``size`` items.

    With a timeout, a group that got no item for that long comes out unfinished. Items are counted once per ``item_id``.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[str, float] = json.loads(state.get[0]) if state.exists else {}
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"instance_id": [key[0]], "n_items": [len(held)], "total": [float(sum(held.values()))], "finished": [False]})
            return
        for p in parts:
            held.update(zip(map(str, p["item_id"]), p["value"].astype(float)))
        if len(held) >= size:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"instance_id": [key[0]], "n_items": [len(held)], "total": [float(sum(held.values()))], "finished": [True]})
            return
        state.update((json.dumps(held),))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)

    kind = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return items.groupBy("instance_id").applyInPandasWithState(step, OUT, "held string", "append", kind)


def timed_out_groups(items: DataFrame, size: int, idle: str) -> DataFrame:
    """As ``complete_groups``, by event time: a group whose last item is ``idle`` behind the watermark comes out unfinished.

    ``items`` is a stream (instance_id, item_id, value, event_time) with a watermark on ``event_time``; rows without an instance only move it.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last = (json.loads(state.get[0]) if state.exists else ({}, 0.0))
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"instance_id": [key[0]], "n_items": [len(held)], "total": [float(sum(held.values()))], "finished": [False]})
            return
        for p in parts:
            held.update(zip(map(str, p["item_id"]), p["value"].astype(float)))
            last = max(last, p["event_time"].max().timestamp())
        if key[0] is None or key[0] != key[0]:
            return
        if len(held) >= size:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"instance_id": [key[0]], "n_items": [len(held)], "total": [float(sum(held.values()))], "finished": [True]})
            return
        state.update((json.dumps((held, last)),))
        state.setTimeoutTimestamp(max(int((last + wait) * 1000), state.getCurrentWatermarkMs() + 1))

    wait = pd.Timedelta(idle).total_seconds()
    return items.groupBy("instance_id").applyInPandasWithState(step, OUT, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def requeue(items: DataFrame, size: int, inbox: str, again: Callable[[DataFrame], DataFrame], rounds: int = 10) -> DataFrame:
    """Groups of the inbox once all their items are good; ``value`` is 1 for an aborted item, else 0.

    A complete group with an aborted item goes back: ``again`` makes its items anew, and they are appended to the inbox, which the same
    stream reads on. Gives (instance_id, n_items, attempts), by index; a group that is still bad after ``rounds`` stays out.
    """
    spark = items.sparkSession
    out, state = scratch_path(spark, "requeue-groups"), scratch_path(spark, "requeue-state")
    for _ in range(rounds):
        groups = run_to_end(complete_groups(file_stream(spark, inbox), size), OUT, out=out, state=state)
        tries = groups.groupBy("instance_id").agg(F.count(F.lit(1)).alias("attempts"), F.min("total").alias("aborted"), F.max("n_items").alias("n_items"))
        bad = tries.where("aborted > 0").select("instance_id")
        if bad.isEmpty():
            break
        again(items.join(bad, "instance_id", "left_semi")).select(*items.columns).write.mode("append").parquet(inbox)
    return tries.where("aborted = 0").select("instance_id", "n_items", "attempts").orderBy("instance_id")


def drain(spark: SparkSession, out: str, cursor: str) -> DataFrame:
    """The groups in the output folder ``out`` that no read with this ``cursor`` has given yet; the cursor is a table of files read.

    The cursor moves before the rows are given, so a failed reader loses a read rather than getting groups twice.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(out).select("path")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cursor)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        files = files.join(spark.read.schema("path string").parquet(cursor), "path", "left_anti")
    new = [r["path"] for r in files.toLocalIterator()]
    spark.createDataFrame([(p,) for p in new], "path string").write.mode("append").parquet(cursor)
    return spark.read.schema(OUT).parquet(*new) if new else spark.createDataFrame([], OUT)


def run_to_end(stream: DataFrame, schema: str, label: str = "stream", out: str | None = None, state: str | None = None) -> DataFrame:
    """Run a streaming plan over what is there and return its output table; with the same ``out`` and ``state`` a later run goes on."""
    spark = stream.sparkSession
    out, state = out or scratch_path(spark, label), state or scratch_path(spark, label + "-state")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(out)


def file_stream(spark, path: str) -> DataFrame:
    """A Parquet file or folder as a stream (a single file has to be named by a pattern)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_file = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]" if is_file else path)


def batch_statistics(groups: DataFrame) -> DataFrame:
    """Totals between two reads: groups, items, mean size and mean value."""
    return groups.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("n_items"), F.lit(0)).alias("n_items"), F.coalesce(F.avg("n_items"), F.lit(0.0)).alias("mean_size"), F.coalesce(F.sum("total") / F.sum("n_items"), F.lit(0.0)).alias("mean_value"))


def ready_count(items: DataFrame, key: str, size: int) -> DataFrame:
    """Items in complete groups."""
    return items.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= size).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("ready"))


def slow_requests(requests: DataFrame, key: str, step: str, seconds: str, window: int, delta: float) -> DataFrame:
    """Requests slower than the running maximum of their step window by more than ``delta``; they don't raise it silently: it is raised after the comparison.

    The order is (``step``, seq). A plain window: step windows are small and many, so no group goes to Python.
    """
    before = Window.partitionBy(key, F.floor(F.col(step) / window)).orderBy(step, "seq").rowsBetween(Window.unboundedPreceding, -1)
    return requests.withColumn("slow", F.col(seconds) > F.coalesce(F.max(seconds).over(before), F.lit(0.0)) + delta)
