"""The operation log as a stream: last-writer-wins state kept by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path


def element_state(events: DataFrame) -> DataFrame:
    """Streaming or batch: the last value and the number of operations of each (doc_id, element). Late rows change a value only if they are later by (ts, event_id)."""
    k = F.get_json_object("props", "$.k").cast("long")
    sets = events.where("event_type IN ('view', 'click')").select(F.col("user_id").alias("doc_id"), (k % 7).alias("element"), "value", F.struct("ts", "event_id").alias("at"))
    return sets.groupBy("doc_id", "element").agg(F.max_by("value", "at").alias("value"), F.count("*").alias("operations"))


def streamed_state(spark: SparkSession, path: str) -> DataFrame:
    """Runs all events at `path` through a stream to its end and returns the state.

    Each batch adds the elements it changed, under its number: a batch that runs again replaces its own rows. The state
    is each element's row of its last batch, so no batch writes more than it changed.
    """
    out, mark = scratch_path(spark, "stream-state"), scratch_path(spark, "stream-checkpoint")
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)  # path may be a pattern

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    changes = element_state(events)
    keep(spark.createDataFrame([], changes.schema), -1)  # so that there is a table even without events
    query = changes.writeStream.outputMode("update").option("checkpointLocation", mark).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    last = spark.read.parquet(out).groupBy("doc_id", "element").agg(F.max_by(F.struct("value", "operations"), "batch").alias("x"))
    return last.select("doc_id", "element", "x.value", "x.operations")
