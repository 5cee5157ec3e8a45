"""Numbers rows in the order of keys, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written


def numbered(df: DataFrame, keys: list[str | Column], name: str) -> DataFrame:
    """The rows of `df`, written in the order of `keys` (nulls first), with `pos`: their number from 0. Keys may repeat; such rows stand next to each other in any order.

    Rows are dealt out by ranges and numbered in each; what is before a range is added from the ranges' counts, one for each
    partition, which go to the driver and back.
    """
    at = F.monotonically_increasing_id()
    placed = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", at), name)
    part = F.shiftright("_at", 33).cast("int")
    counts = sorted((r["_p"], r["count"]) for r in placed.groupBy(part.alias("_p")).count().collect())
    starts = [(p, sum(n for _, n in counts[:k])) for k, (p, _) in enumerate(counts)]
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "_p int, _before long"))  # one row a partition
    return placed.withColumn("_p", part).join(offsets, "_p").withColumn("pos", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_before", "_at")
