"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, from `spark.checkpoint.dir`.

    Only a local session may fall back to a temporary folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="panelloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}/{name}"


def store(frame: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts the lineage and lets later scans prune columns."""
    path = new_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def store_observed(
    frame: DataFrame, name: str, metrics: dict[str, Column]
) -> tuple[DataFrame, dict[str, int]]:
    """`store`, with counts taken during the write instead of by another pass."""
    seen = Observation(name)
    stored = store(frame.observe(seen, *[m.alias(k) for k, m in metrics.items()]), name)
    return stored, {k: v or 0 for k, v in seen.get.items()}
