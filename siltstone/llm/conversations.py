"""Rebuilding conversations from message rows with keyed streaming state.

The rows are read as a stream in batches of bounded size. Each message is parsed once (speaker, place, blank, calls tools), then kept in keyed
state (RocksDB, on disk): a session of its conversation, held open until the event-time watermark has passed the session's last message by
``gap``. Late arrivals up to ``delay`` behind the newest event join their session; closed sessions leave the state while the stream goes on.
A run over a bounded table ends with a closing row, which is written once the table is read to its end and moves the watermark past every
session that is still open. Messages that came later than the watermark allows are counted, and then taken from the table into a last
session of their own. The closed sessions of a conversation are put together, ordered and checked, and only intact conversations come out.

Only ids, places and flags are kept in state, never the texts, so the state of a long conversation stays small.

Defined cases: rows without a conversation are dropped; metadata that is null, blank, not a JSON object or cut off, an unknown or missing
speaker, or a missing place break the conversation; a message delivered twice under one id counts once (its first readable copy by
arrival); null contents are blank; a conversation whose messages are more than ``gap`` apart has several sessions and is still one;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import scratch_path

# The names of the four speakers.
SPEAKERS = {
    "system": ["system"],
    "user": ["user", "human"],
    "assistant": ["assistant", "gpt", "bot", "model", "ai"],
    "tool": ["tool", "function", "observation"],
}
CODES = {"system": 0, "user": 1, "assistant": 2, "tool": 3}
NAMES = {v: k for k, v in CODES.items()}
BLANK = r"[\s\p{Z}\p{C}]+"
TURNS = "sample_index bigint, turn_no int, message_id bigint, role string"
#: Bound of a micro-batch.
BATCH = {"maxBytesPerTrigger": str(64 << 30)}
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
COLUMNS = ["message_id", "sample_index", "message_content", "metadata", "created_at", "ingested_at"]


def parsed(rows: DataFrame) -> DataFrame:
    """One small record per message row: speaker code, place (0-based index or parent), flags."""
    m = F.col("_m")
    nested = F.col("_m")["message"]
    role = F.lower(F.trim(F.coalesce(m["role"], m["from"], F.get_json_object(nested, "$.role"))))
    code: Column = F.lit(None).cast("tinyint")
    for who, names in SPEAKERS.items():
        code = F.when(role.isin(names), F.lit(CODES[who]).cast("tinyint")).otherwise(code)
    zero = F.coalesce(m["turn_idx"], F.get_json_object(m["extra_info"], "$.turn_idx"))
    index = F.coalesce(F.expr("try_cast(_zero AS BIGINT)"), F.expr("try_cast(trim(_m['turn']) AS BIGINT)") - 1)
    calls = F.coalesce(~F.trim(m["tool_calls"]).isin("", "[]", "null", "{}"), F.lit(False))
    return (
        rows.withColumn("_m", F.from_json("metadata", "map<string,string>"))
        .withColumn("_zero", F.trim(zero))
        .select(
            "sample_index",
            F.coalesce("created_at", "ingested_at", F.lit("1970-01-01").cast("timestamp")).alias("event_time"),
            F.struct(
                F.col("message_id").alias("id"),
                F.coalesce("ingested_at", "created_at").alias("at"),
                code.alias("speaker"),
                index.alias("place"),
                F.expr("try_cast(_m['parent_id'] AS BIGINT)").alias("parent"),
                F.coalesce(F.map_contains_key("_m", F.lit("parent_id")), F.lit(False)).alias("linked"),
                (F.regexp_replace(F.coalesce("message_content", F.lit("")), BLANK, "") == "").alias("blank"),
                calls.alias("calls"),
            ).alias("message"),
        )
    )


def order(messages: list[tuple]) -> list[tuple] | None:
    """The messages (id, speaker, place, parent, linked, blank, calls) in the order spoken, or None if they aren't intact."""
    if any(m[1] is None for m in messages):
        return None
    if all(m[4] for m in messages):
        after = {m[3]: m for m in messages}
        if len(after) < len(messages) or None not in after:
            return None
        line, at = [], None
        while at in after:
            line.append(after.pop(at))
            at = line[-1][0]
        if after or at is None:
            return None
    elif any(m[4] or m[2] is None for m in messages):
        return None
    else:
        line = sorted(messages, key=lambda m: m[2])
        if any(m[2] != i for i, m in enumerate(line)):
            return None
    kinds = ["reply" if m[1] == 2 and not m[6] else m[1] for m in line]
    said = kinds[1:] if kinds[0] == 0 else kinds
    if not said or said[0] != 1 or said[-1] != "reply":
        return None
    if any(a == b and a in (1, "reply") for a, b in zip(kinds, kinds[1:])):
        return None
    if any(m[5] and k in (1, "reply") for k, m in zip(kinds, line)):
        return None
    return line


def _validate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(1)
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        flat, ends, keys = lists.flatten(), lists.offsets.to_pylist(), b.column(0).to_pylist()
        base = ends[0]
        names = ["id", "at", "speaker", "place", "parent", "linked", "blank", "calls"]
        cols = [flat.field(flat.type.get_field_index(n)) for n in names]
        cols[1] = cols[1].cast(pa.int64(), safe=False)
        rows = list(zip(*[c.to_pylist() for c in cols]))
        out: tuple[list, list, list, list] = ([], [], [], [])
        for i, key in enumerate(keys):
            first: dict = {}
            for r in rows[ends[i] - base : ends[i + 1] - base]:
                rank = (r[2] is None, r[1] is None, r[1] or 0)
                if r[0] not in first or rank < first[r[0]][0]:
                    first[r[0]] = (rank, (r[0], *r[2:]))
            line = order([m for _, m in first.values()])
            for turn, m in enumerate(line or ()):
                for to, v in zip(out, (key, turn, m[0], NAMES[m[1]])):
                    to.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names=["sample_index", "turn_no", "message_id", "role"])


def sessions(messages: DataFrame, delay: str = "10 days", gap: str = "2 days") -> DataFrame:
    """Streaming plan from message rows to the messages of closed sessions (append mode: each session once, on closing).

    ``messages`` is a stream of the message columns and a boolean ``closing``; a closing row belongs to no conversation and only moves
    the watermark.
    """
    known = messages.where("sample_index IS NOT NULL OR closing")
    return (
        parsed(known)
        .withWatermark("event_time", delay)
        .groupBy("sample_index", F.session_window("event_time", gap))
        .agg(F.collect_list("message").alias("messages"))
        .select("sample_index", "messages")  # no filter on the key here: it would be pushed below the watermark and drop closing rows
    )


def conversations(closed: DataFrame) -> DataFrame:
    """The turns of intact conversations, from all their closed sessions."""
    whole = closed.where("sample_index IS NOT NULL").groupBy("sample_index").agg(F.flatten(F.collect_list("messages")).alias("messages"))
    return whole.mapInArrow(_validate, TURNS)


def _stream_path(spark: SparkSession, path: str) -> str:
    """A single file has to be named by a pattern: a stream takes a plain path for a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_file = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    return f"{path[:-1]}[{path[-1]}]" if is_file else path


def too_late(spark: SparkSession, path: str, closed: DataFrame) -> DataFrame:
    """The messages of the table that no closed session holds, as sessions (each delivered copy counts)."""
    kept = closed.where("sample_index IS NOT NULL").select("sample_index", F.explode("messages").alias("m")).select("sample_index", F.col("m.id").alias("_id"), F.col("m.at").alias("_at"))
    rows = parsed(spark.read.parquet(path).select(*COLUMNS).where("sample_index IS NOT NULL"))
    same = (rows["sample_index"] == kept["sample_index"]) & rows["message.id"].eqNullSafe(kept["_id"]) & rows["message.at"].eqNullSafe(kept["_at"])
    return rows.join(kept, same, "left_anti").groupBy("sample_index").agg(F.collect_list("message").alias("messages"))


def rebuild(spark: SparkSession, path: str, delay: str = "10 days", gap: str = "2 days", batch: dict[str, str] | None = None) -> DataFrame:
    """Run the stream over the Parquet table at ``path`` to its end and return the turns of all intact conversations.

    ``batch`` bounds a micro-batch, in options of the file source.
    """
    schema = spark.read.parquet(path).select(*COLUMNS).schema
    stream = spark.readStream.schema(schema).options(**(batch or BATCH)).parquet(_stream_path(spark, path)).withColumn("closing", F.lit(False))
    end, out, state = scratch_path(spark, "closing"), scratch_path(spark, "sessions"), scratch_path(spark, "conversations-state")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(end)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    closing = spark.readStream.schema(schema).parquet(end).withColumn("closing", F.lit(True))
    plan = sessions(stream.unionByName(closing), delay, gap)

    def run() -> None:
        plan.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).outputMode("append").start().awaitTermination()

    provider = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run()  # all batches of the table; sessions that the watermark has passed close on the way
        last = {f.name: F.lit("9990-01-01").cast("timestamp") if f.name == "created_at" else F.lit(None).cast(f.dataType) for f in schema}
        spark.range(1).select(*[c.alias(n) for n, c in last.items()]).coalesce(1).write.mode("append").parquet(end)
        run()  # the closing row
    finally:
        spark.conf.unset(PROVIDER) if provider is None else spark.conf.set(PROVIDER, provider)
    closed = spark.read.schema(plan.schema).parquet(out)
    kept = closed.where("sample_index IS NOT NULL").agg(F.coalesce(F.sum(F.size("messages")), F.lit(0))).first()[0]
    if kept < spark.read.parquet(path).where("sample_index IS NOT NULL").count():
        closed = closed.unionByName(too_late(spark, path, closed))
    return conversations(closed)
