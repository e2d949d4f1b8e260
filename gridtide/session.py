"""Session settings, lineage cuts and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_bases: set[str] = set()


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A session for local runs; on a cluster the submitter's own session is used as it is."""
    builder = (
        SparkSession.builder.master(master)
        .appName("gridtide")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`.

    Only a local session may fall back to a folder of this machine.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return os.path.dirname(current)
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="gridtide-")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` out through a reliable checkpoint and go on from the written rows."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in this application's part of it, which goes when the application ends."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    base = f"{shared_dir(spark).rstrip('/')}/gridtide-{spark.sparkContext.applicationId}"
    if base not in _bases:
        folder = spark._jvm.org.apache.hadoop.fs.Path(base)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _bases.add(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and go on from the file, of which later steps read what they need."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
