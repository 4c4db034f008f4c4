"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path under ``spark.checkpoint.dir``, deleted when the driver ends.

    A temporary folder stands in only where that is unset and the master is local;
    elsewhere each executor would write to its own disk, so an unset folder raises.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = context._jsc.sc().getCheckpointDir()
        if not known.isDefined():
            if context.master.split("[")[0] != "local":
                raise ValueError(f"spark.checkpoint.dir is unset; with master {context.master} it must name a shared folder")
            context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='vellumflow-')}")
            known = context._jsc.sc().getCheckpointDir()
        base = known.get()
    path = f"{base.rstrip('/')}/vellumflow-tables/{context.applicationId}/{kind}-{uuid.uuid4().hex}"
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written as Parquet and read back, without its lineage."""
    path = scratch_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
