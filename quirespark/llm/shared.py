"""What the operators share: the cluster's shared folder, written tables, Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: spark.checkpoint.dir. Where that is unset a local master gets a temporary one, one an application; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="quirespark-")
        path = _own[context.applicationId]
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quirespark/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and host that Spark would take it by, for readers outside Spark: without a scheme they would take it for a local one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return re.sub("^file:/+", "file:///", whole)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df` as a table written in the shared folder: lineage is cut and a lost executor costs nothing that was done before.

    The shuffle files of the job that wrote the table are of no further use and go with it.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_order(df: DataFrame, struct: str) -> list[Column]:
    """The columns of `df`, as fields of `struct`, that can be sorted by."""
    return [F.col(f"{struct}.`{f.name}`") for f in df.schema if not re.search("map<|variant", f.dataType.simpleString())]


def rows_kept(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `docs`, all columns, whose id and text `kept` names: (_kept_id, _kept_raw: xxhash64 of the text, _times: how many rows of `docs` share both).

    Of such rows one stays: the first by the other columns, in so far as these have an order.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col(f"`{id_col}`").alias("_id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("_raw"))
    rows = rows.join(kept, F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_raw") == F.col("_kept_raw")))
    nth = F.row_number().over(Window.partitionBy("_id", "_raw").orderBy(*with_order(docs, "_doc")))
    repeated = rows.where("_times > 1").withColumn("_nth", nth).where("_nth = 1")
    return rows.where("_times = 1").select("_doc.*").unionByName(repeated.select("_doc.*"))


def id_and_text(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Only the two columns an operator needs (and `more`), under names of its own, so that clashing extra columns never matter."""
    return df.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"), *more)


def texts_of(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits (the public splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Memo(dict):
    """A dict that fills itself by `make` and starts afresh at `most` entries, so that its memory is bounded."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value
