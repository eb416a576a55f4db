"""Sessions, table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, memory: str = "12g", name: str = "siltstone") -> SparkSession:
    """A local session with the settings the plans are tuned for."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the cluster sets it.

    Only an unset value (tests, local mode) is replaced by a temporary folder, which is then also the session's checkpoint folder.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or _OWN.get(spark.sparkContext.applicationId)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        conf = "file://" + own
        _OWN[spark.sparkContext.applicationId] = conf
        spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")


_OWN: dict[str, str] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/siltstone/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that no later plan reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base = os.path.join(shared_dir(spark), "siltstone")
    for frame in frames:
        for file in frame.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if "/siltstone/" in folder and base.split("://")[-1] in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
