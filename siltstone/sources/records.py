"""Record files: JSON lines and Parquet, path slices, bound columns, dumps and state tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = re.compile(r"(.*)@\[(\d*):(\d*)\]")


def parse_path(path: str) -> tuple[str, slice | None]:
    """``file@[a:b]`` as a path and a slice; negative bounds are refused."""
    if not path.endswith("]") or "@[" not in path:
        return path, None
    m = SLICE.fullmatch(path)
    if not m:
        raise ValueError(f"bad slice in {path}")
    low, high = (int(x) if x else None for x in m.group(2, 3))
    return m.group(1), slice(low, high)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(at)
    return found is not None and len(found) > 0


def read(spark: SparkSession, path: str, schema: T.StructType | str | None = None, order: str | None = None) -> DataFrame:
    """A record file by its suffix. Blank and malformed JSON lines are skipped; a slice needs the ``order`` it counts in."""
    path, part = parse_path(path)
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if path.endswith(".jsonl") or path.endswith(".json"):
        reader = spark.read.schema(schema) if schema else spark.read
        df = reader.option("mode", "DROPMALFORMED").json(path)
    elif path.endswith(".parquet"):
        df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    else:
        raise ValueError(f"unsupported file type: {path}")
    if part is None:
        return df
    if order is None:
        raise ValueError("a slice needs an order")
    df = df.orderBy(order).offset(part.start or 0)
    return df if part.stop is None else df.limit(max(part.stop - (part.start or 0), 0))


def bind(df: DataFrame, prompt: str, label: str | None = None, metadata: str | None = None, tools: str | None = None) -> DataFrame:
    """Configured columns under their fixed names; tools (JSON text) join the metadata."""
    meta = F.coalesce(F.col(metadata), F.lit("{}")) if metadata else F.lit("{}")
    parsed = F.from_json(meta, "map<string,string>")
    if tools:
        parsed = F.map_concat(F.map_filter(parsed, lambda k, v: k != "tools"), F.create_map(F.lit("tools"), F.col(tools)))
    return df.select(F.col(prompt).alias("prompt"), (F.col(label) if label else F.lit(None).cast("string")).alias("label"), parsed.alias("metadata"))


def write_dump(rows: DataFrame, path: str, rollout_id: int, evaluation: bool = False) -> None:
    """One rollout's rows, in a folder of its id and kind; written again it is replaced."""
    marked = rows.withColumns({"rollout_id": F.lit(rollout_id), "is_eval": F.lit(evaluation)})
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("rollout_id", "is_eval").parquet(path)


def read_dump(spark: SparkSession, path: str, rollout_id: int, evaluation: bool = False) -> DataFrame:
    return spark.read.parquet(path).where((F.col("rollout_id") == rollout_id) & (F.col("is_eval") == evaluation))


def write_ranks(rows: DataFrame, path: str, rollout_id: int, rank: str = "rank") -> None:
    rows.withColumn("rollout_id", F.lit(rollout_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("rollout_id", rank).parquet(path)


STATE = "rollout_id bigint, sample_offset bigint, epoch_id bigint, group_index bigint, sample_index bigint, metadata map<string,string>"


def save_state(spark: SparkSession, path: str, **state) -> None:
    """A source's cursor after one rollout."""
    row = [tuple(state.get(f.split()[0]) for f in STATE.split(", "))]
    spark.createDataFrame(row, STATE).coalesce(1).write.mode("append").parquet(path)


def load_state(spark: SparkSession, path: str, rollout_id: int) -> dict | None:
    rows = spark.read.schema(STATE).parquet(path).where(F.col("rollout_id") == rollout_id).orderBy(F.desc("sample_offset")).limit(1).collect()
    return rows[0].asDict() if rows else None


REQUEST = "model string, stream boolean, messages array<struct<role:string,content:string>>, max_tokens int"


def read_requests(spark: SparkSession, path: str, rounds: int = 1) -> DataFrame:
    """A request log for each replay round; lines that aren't requests stay as error rows. Lines are numbered by a leading tab field."""
    lines = spark.read.text(path).select(F.split("value", "\t", 2).alias("x")).select(F.col("x")[0].cast("bigint").alias("line_number"), F.col("x")[1].alias("body"))
    parsed = lines.withColumn("r", F.from_json("body", REQUEST + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull() | F.col("r.messages").isNull()
    return parsed.select(
        F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("replay_round"),
        "line_number",
        (~bad).alias("ok"),
        F.when(bad, F.lit("invalid request line")).alias("error"),
        F.when(~bad, F.col("r.model")).alias("model"),
        F.when(~bad, F.coalesce("r.stream", F.lit(False))).alias("stream"),
        F.when(~bad, F.size("r.messages")).alias("n_messages"),
    )


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Events of a (gzipped) profiler trace file."""
    event = "struct<cat:string,ph:string,name:string,ts:double,dur:double,tid:bigint>"
    return spark.read.option("multiLine", True).schema(f"traceEvents array<{event}>").json(path).select(F.explode("traceEvents").alias("e")).select("e.*")


def cached(spark: SparkSession, source: str, cache: str, build) -> DataFrame:
    """A materialised result, built again when a source file is newer."""

    def newest(path: str) -> int:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return max((s.getModificationTime() for s in fs.listStatus(at)), default=0) if fs.exists(at) else -1

    if newest(cache) < newest(source) or newest(cache) < 0:
        build(spark.read.parquet(source)).write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def append_metrics(spark: SparkSession, path: str, step: int, metrics: dict[str, float]) -> None:
    spark.createDataFrame([(step, k, float(v)) for k, v in metrics.items()], "step bigint, metric string, value double").coalesce(1).write.mode("append").parquet(path)


def role_checked(df: DataFrame, messages: str, roles=("system", "user", "assistant", "tool")) -> DataFrame:
    """Messages as (role, content); an unknown role is an error."""

    def one(m):
        known = m["role"].isin(list(roles))
        return F.struct(F.when(known, m["role"]).otherwise(F.raise_error(F.concat(F.lit("unknown role "), m["role"])).cast("string")).alias("role"), m["content"].alias("content"))

    return df.withColumn(messages, F.transform(messages, one))


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
