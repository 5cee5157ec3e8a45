"""The stand-in tables and the adapters that give them the shape of document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paragraphs(documents: DataFrame) -> DataFrame:
    """One row per line of a document's text, in order; a null text has no paragraphs."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))


def oplog(events: DataFrame) -> DataFrame:
    """The event table as an operation log: a user is a document, seq its order by (ts, event_id), element one of seven by the payload's k.

    view and click set a text, purchase sets a style, signup and error are controls or envelopes, as the query says.
    """
    from pyspark.sql import Window

    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("user_id").alias("doc_id"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"),
        (k % 7).alias("element"),
        F.col("event_type").alias("op"),
        "value",
        "ts",
        "event_id",
    )
