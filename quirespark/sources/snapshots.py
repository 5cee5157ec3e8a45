"""Snapshots beside packages and logs: what was saved, with hashes, and whether it still holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packages import fingerprints

SCHEMA = "doc_id string, package_sha256 string, saved_at timestamp, op_count long, part_sha256 map<string,string>, part_fingerprints map<string,string>, pending array<string>"


def _hashes(parts: DataFrame) -> DataFrame:
    """(doc_id, package_sha256, part_sha256): a hash of each part, and one of all paths and hashes in their order."""
    rows = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part_path", F.sha2("content", 256).alias("h")))).alias("p"))
    whole = F.sha2(F.array_join(F.transform("p", lambda x: F.concat(x["part_path"], F.lit("\n"), x["h"])), "\n"), 256)
    return rows.select("doc_id", whole.alias("package_sha256"), F.map_from_entries("p").alias("part_sha256"))


def snapshots(parts: DataFrame, nodes: DataFrame, log: DataFrame, saved_at: str) -> DataFrame:
    """A row of SCHEMA for every package: hashes of its parts, fingerprints of its trees, how many operations its log has and the ids of those made here (source swift in the format's words) that no import has settled."""
    prints = fingerprints(nodes).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("part_path", "fingerprint")))).alias("part_fingerprints"))
    ops = log.groupBy("doc_id").agg(F.count("*").alias("op_count"), F.transform(F.array_sort(F.collect_list(F.when(F.col("source") == "swift", F.struct("seq", "op_id")))), lambda x: x["op_id"]).alias("pending"))
    rows = _hashes(parts).join(prints, "doc_id", "left").join(ops, "doc_id", "left")
    return rows.select(
        "doc_id", "package_sha256", F.lit(saved_at).cast("timestamp").alias("saved_at"), F.coalesce("op_count", F.lit(0)).cast("long").alias("op_count"), "part_sha256", "part_fingerprints", F.coalesce("pending", F.array().cast("array<string>")).alias("pending")
    )


def write_snapshots(rows: DataFrame, path: str) -> None:
    """One JSON object a package."""
    rows.write.mode("overwrite").json(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def checked(saved: DataFrame, parts: DataFrame, log: DataFrame) -> DataFrame:
    """(doc_id, state, changed, tail): whether a package is as it was saved (same), was changed from outside (changed, with the paths of parts that differ, are new or gone), or has no snapshot (new) or no package any more (gone); tail counts the operations since."""
    now = _hashes(parts).select("doc_id", F.col("package_sha256").alias("_now"), F.col("part_sha256").alias("_parts"))
    ops = log.groupBy("doc_id").agg(F.count("*").alias("_ops"))
    both = saved.join(now, "doc_id", "full_outer").join(ops, "doc_id", "left")
    state = F.when(F.col("package_sha256").isNull(), "new").when(F.col("_now").isNull(), "gone").when(F.col("package_sha256") == F.col("_now"), "same").otherwise("changed")
    paths = F.array_sort(F.array_union(F.map_keys("part_sha256"), F.map_keys("_parts")))
    differ = F.filter(paths, lambda p: ~F.try_element_at(F.col("part_sha256"), p).eqNullSafe(F.try_element_at(F.col("_parts"), p)))
    return both.select("doc_id", state.alias("state"), F.when(state == "changed", differ).otherwise(F.array().cast("array<string>")).alias("changed"), (F.coalesce("_ops", F.lit(0)) - F.coalesce("op_count", F.lit(0))).alias("tail"))
