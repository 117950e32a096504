"""Session factory and the small runtime helpers that every module shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

REPO_ROOT = str(Path(__file__).resolve().parent.parent)


def build_session(app: str = "ticketloom", cores: str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session with the settings the engine assumes: UTC, adaptive execution, Arrow."""
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]")
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started from."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if REPO_ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (REPO_ROOT, known) if p)
    # large arrays are mapped, so that freeing them gives their memory back at once
    env.setdefault("MALLOC_MMAP_THRESHOLD_", "1048576")
    env.setdefault("MALLOC_TRIM_THRESHOLD_", "8388608")
    env.setdefault("MALLOC_ARENA_MAX", "2")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # rows hold whole texts
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8388608")
    # shuffle files go when the query that wrote them ends, not when the driver next collects garbage
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage.

    The cluster names it in ``spark.checkpoint.dir`` (or by ``setCheckpointDir``). Where neither is set, a session of
    one machine gets a folder of its own; a cluster has none that all can see, which is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ticketloom-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/ticketloom/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table through Hadoop's own file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_table(frame: DataFrame) -> None:
    """Remove the scratch table that materialise() returned (or those that ``frame`` is a union of), once nothing reads it any more."""
    for path in {file.rpartition("/")[0] for file in frame.inputFiles()}:
        drop_path(frame.sparkSession, path)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
