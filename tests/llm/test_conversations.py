import json
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from siltstone.llm.conversations import order, rebuild, sessions

T0 = datetime(2031, 1, 1)
SCHEMA = "message_id bigint, group_index bigint, sample_index bigint, message_content string, created_at timestamp, ingested_at timestamp, metadata string, message string"


def run(spark, tmp_path, rows):
    df = spark.createDataFrame([(m, 1, s, c, T0 + timedelta(seconds=i), T0 + timedelta(seconds=i, days=late), md, "clash") for i, (m, s, c, md, late) in enumerate(rows)], SCHEMA)
    path = str(tmp_path / "message_rows.parquet")
    df.write.parquet(path)
    return sorted((r["sample_index"], r["turn_no"], r["message_id"], r["role"]) for r in rebuild(spark, path).collect())


def j(**x):
    return json.dumps(x)


def test_layouts_and_breaks(spark, tmp_path):
    rows = [
        (11, 1, "hi", j(role="USER", turn_idx=0), 0),
        (12, 1, "yes", j(role="assistant", turn_idx=1), 3),
        (12, 1, "yes", j(turn_idx=1, role="assistant"), 4),  # delivered twice
        (22, 2, "a", j(**{"from": "gpt", "turn": "3"}), 0),
        (21, 2, "q", j(**{"from": "human", "turn": "2"}), 0),
        (20, 2, "s", j(**{"from": "system", "turn": "1"}), 0),
        (32, 3, "", j(role="assistant", parent_id=31, tool_calls=[{"name": "x"}]), 0),
        (33, 3, None, j(role="tool", parent_id=32), 0),
        (34, 3, "done", j(role="assistant", parent_id=33), 0),
        (31, 3, "q", j(role="user", parent_id=None), 0),
        (41, 4, "q", j(role="user", turn_idx=0), 0),  # a message is missing
        (42, 4, "a", j(role="assistant", turn_idx=2), 0),
        (51, 5, "q", '{"role": ', 0),  # unreadable
        (52, 5, "a", j(role="assistant", turn_idx=1), 0),
        (61, 6, "q", j(role="user", turn_idx=0), 0),  # blank reply
        (62, 6, " ​", j(role="assistant", turn_idx=1), 0),
        (71, 7, "q", j(message={"role": "User"}, extra_info={"turn_idx": 0}), 0),
        (72, 7, "a", j(message={"role": "speaker_3"}, extra_info={"turn_idx": 1}), 0),
        (81, None, "stray", j(role="user", turn_idx=0), 0),
    ]
    got = run(spark, tmp_path, rows)
    assert got == [(1, 0, 11, "user"), (1, 1, 12, "assistant"), (2, 0, 20, "system"), (2, 1, 21, "user"), (2, 2, 22, "assistant"), (3, 0, 31, "user"), (3, 1, 32, "assistant"), (3, 2, 33, "tool"), (3, 3, 34, "assistant")]


def test_empty(spark, tmp_path):
    path = str(tmp_path / "message_rows.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert rebuild(spark, path).count() == 0


def m(i, speaker, place, blank=False, calls=False):
    return (i, speaker, place, None, False, blank, calls)


def test_order_rules():
    assert order([m(1, 1, 0), m(2, 2, 1)]) is not None
    assert order([m(1, 1, 0), m(2, 1, 1), m(3, 2, 2)]) is None  # two user messages
    assert order([m(1, 1, 0), m(2, 2, 1), m(3, 2, 2)]) is None  # two replies
    assert order([m(1, 1, 0), m(2, 2, 1, calls=True)]) is None  # ends with a call
    assert order([m(1, 1, 0), m(2, 2, 0)]) is None  # one place twice
    assert order([m(1, 0, 0)]) is None
    cycle = [(1, 1, None, 2, True, False, False), (2, 2, None, 1, True, False, False)]
    assert order(cycle) is None


def test_pause_longer_than_the_gap(spark, tmp_path):
    at = lambda days: T0 + timedelta(days=days)
    rows = [(1, 1, 1, "q", at(0), at(0), j(role="user", turn_idx=0), ""), (2, 1, 1, "a", at(0), at(0), j(role="assistant", turn_idx=1), "")]
    rows += [(3, 1, 1, "q", at(5), at(5), j(role="user", turn_idx=2), ""), (4, 1, 1, "a", at(30), at(30), j(role="assistant", turn_idx=3), "")]
    rows += [(5, 1, 2, "q", at(0), at(0), j(role="user", turn_idx=0), ""), (6, 1, 2, "a", at(0), at(0), j(role="assistant", turn_idx=1), ""), (7, 1, 2, "q", at(9), at(9), j(role="user", turn_idx=2), "")]
    path = str(tmp_path / "message_rows.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    got = sorted((r["sample_index"], r["turn_no"], r["message_id"]) for r in rebuild(spark, path).collect())
    assert got == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 4)]


def files(spark, tmp_path, parts):
    """One file per part, read in this order at one file a batch."""
    path = tmp_path / "message_rows.parquet"
    path.mkdir()
    for n, rows in enumerate(parts):
        df = spark.createDataFrame([(m, 1, s, "x", at, at + timedelta(days=late), md, "") for m, s, at, late, md in rows], SCHEMA)
        df.coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
        (part,) = (tmp_path / f"part{n}").glob("*.parquet")
        target = path / f"{n}.parquet"
        part.rename(target)
        os.utime(target, (1_900_000_000 + n, 1_900_000_000 + n))
    return str(path)


def at(days):
    return T0 + timedelta(days=days)


def user(n):
    return j(role="user", turn_idx=n)


def reply(n):
    return j(role="assistant", turn_idx=n)


def test_several_batches(spark, tmp_path):
    parts = [
        [(1, 1, at(0), 0, user(0)), (3, 2, at(0), 0, user(0))],
        [(2, 1, at(0.1), 0, reply(1)), (5, 3, at(1), 0, user(0))],
        [(6, 3, at(1), 0, reply(1)), (7, 4, at(30), 0, user(0))],  # the watermark passes the first days
        [(8, 4, at(30), 0, reply(1)), (4, 2, at(0.2), 29, reply(1))],  # too late for its session
    ]
    path = files(spark, tmp_path, parts)
    got = sorted((r["sample_index"], r["turn_no"], r["message_id"]) for r in rebuild(spark, path, batch={"maxFilesPerTrigger": "1"}).collect())
    assert got == [(1, 0, 1), (1, 1, 2), (2, 0, 3), (2, 1, 4), (3, 0, 5), (3, 1, 6), (4, 0, 7), (4, 1, 8)]


def test_sessions_close_on_the_way(spark, tmp_path):
    parts = [[(1, 1, at(0), 0, user(0)), (2, 1, at(0), 0, reply(1))], [(3, 2, at(40), 0, user(0))], [(4, 2, at(40), 0, reply(1))]]
    path = files(spark, tmp_path, parts)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("closing", F.lit(False))
    out = str(tmp_path / "out")
    sessions(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert [r["sample_index"] for r in spark.read.parquet(out).collect()] == [1]  # the second conversation is still open
