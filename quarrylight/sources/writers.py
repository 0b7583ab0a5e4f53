"""Sinks: exports, the append-only trace, and snapshots by version."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def export_log(activities: DataFrame, path: str, kind: str = "json") -> None:
    """An activity feed as JSON lines or CSV (maps as JSON text)."""
    flat = activities.select(*(F.to_json(c).alias(c) if t.startswith(("map", "struct", "array")) and kind == "csv" else F.col(c) for c, t in activities.dtypes))
    writer = flat.write.mode("errorifexists")
    writer.csv(path, header=True) if kind == "csv" else writer.json(path)


def append_trace(trace: DataFrame, path: str) -> None:
    """Trace rows are only ever added."""
    trace.write.mode("append").partitionBy("kind").parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors see: spark.checkpoint.dir, or a temporary one in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quarrylight-")
    return folder


def computed_once(df: DataFrame) -> DataFrame:
    """df, kept in the shared folder, for a plan that reads it several times."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def write_version(snapshot: DataFrame, folder: str, version: int) -> str:
    """Write a new version beside the old ones: a path is never overwritten while it is read."""
    path = f"{folder}/v{version:010d}"
    snapshot.write.mode("errorifexists").parquet(path)
    return path


def read_version(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/v{version:010d}")
