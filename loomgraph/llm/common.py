"""Materialisation and column helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one is set only where the session names none and its master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = Path(tempfile.gettempdir(), f"loomgraph-{spark.sparkContext.applicationId}").as_uri()
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


# the default codec holds a page twice in buffers outside of the heap, and pages of long texts are large
_WRITE = {"compression": "zstd", "parquet.block.size": 1 << 25, "parquet.page.size.row.check.min": 10}


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: its lineage ends there, so a lost
    executor costs only its running tasks.  The files go when the session's file system closes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**_WRITE).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def row_key(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> list[Column]:
    """Columns that tell rows apart even if ids are null or repeat: the id, and a hash of the text."""
    return [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
