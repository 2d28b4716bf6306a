"""Cutting lineage, and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """Only a local master may do without one in ``spark.checkpoint.dir``."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="loomgraph-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def work_folder(spark: SparkSession) -> str:
    """The URL of a new folder beside the checkpoints."""
    at = checkpoint_dir(spark)
    at = at if "://" in at else "file:///" + at.removeprefix("file:").lstrip("/")
    return f"{at.rstrip('/')}/{uuid.uuid4().hex}"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffles of what runs inside are deleted as soon as it ends."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder; the shuffles that led to it are deleted at once."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    with freed(spark):
        return df.select("*").checkpoint()  # a plan of its own: that of df would look for its shuffles later on
