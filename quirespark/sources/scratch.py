"""Paths for intermediate tables in the folder that all executors and the driver see."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakSet

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_stored: WeakSet = WeakSet()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset a local master gets a temporary folder, one an application; a cluster has no folder that all could see, which is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="quirespark-")
        base = _own[context.applicationId]
    return f"{base.rstrip('/')}/quirespark/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df` as a table written in the shared folder, so that what reads them more than once computes them once; a table written so before is taken as it is.

    Joins with it sort and merge. Spark would judge by the size of its files whether to broadcast it, and paths and tags,
    of which most are alike, take some fifty times as much in memory; and what is made of it is often more than it is.
    """
    if df in _stored:
        return df
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path).hint("merge")
    _stored.add(out)
    return out
