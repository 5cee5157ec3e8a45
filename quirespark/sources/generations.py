"""Packages, their logs and their snapshots saved together: commits that are there as a whole or not at all.

A store is a folder. Each commit writes its tables under a name of its own, then one manifest with the next number: the
commit is there once the manifest is, and a writer that dies before leaves files that nothing names. Manifests are
renamed into place, which fails where the number is taken, so of two writers one goes first. The other looks at what the
commits since its reading hold: documents of others are no conflict, and it takes the next number; a document that both
changed is one. The file system must refuse to rename onto a file that exists (HDFS, ABFS and local ones do, S3 does not).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import snapshots as N
from .packages import xml_nodes

TABLES = ("documents", "parts", "log", "snapshots")
MANIFEST = "commit long, id string, full boolean"


class Conflict(RuntimeError):
    """Another writer changed a document since it was read."""


def _files(spark: SparkSession, root: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration()), jvm


def manifests(spark: SparkSession, root: str) -> list[tuple[int, str, bool]]:
    """(commit, id, full) of every commit, in order; compaction bounds how many of them a reading needs."""
    files, jvm = _files(spark, root)
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/commits")
    if not files.util().exists(folder):
        return []
    return sorted(tuple(r) for r in spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(f"{root}/commits/*.json").collect()) if files.util().listStatus(folder) else []


def head(spark: SparkSession, root: str) -> int:
    """The number of the last commit, 0 where there is none."""
    return max((n for n, _, _ in manifests(spark, root)), default=0)


def _publish(spark: SparkSession, root: str, number: int, id_: str, full: bool) -> bool:
    """Whether the manifest got its number."""
    files, jvm = _files(spark, root)
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    fs = at("x").getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at("commits"))
    fs.mkdirs(at("open"))
    out = fs.create(at(f"open/{id_}.json"), True)
    try:
        out.write(bytearray(json.dumps({"commit": number, "id": id_, "full": full}).encode()))
    finally:
        out.close()
    none = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(at(f"open/{id_}.json"), at(f"commits/{number:020d}.json"), none)
        return True
    except Exception as e:
        if "FileAlreadyExistsException" in str(e):
            return False
        raise


def commit(spark: SparkSession, root: str, parts: DataFrame, log: DataFrame, expected: int, saved_at: str, removed: DataFrame | None = None, full: bool = False, step: Callable[[str], None] = lambda name: None) -> int:
    """Saves documents with all their parts and their logs, and returns the commit's number.

    expected is the commit that the writer has read. removed(doc_id) are documents that go. log is as read_oplog gives it,
    without payload being looked into. full: these are all documents, so that no reading looks further back; then any commit since is a conflict.
    Of a document saved, the parts and log are those given, none of before. step is called with each thing that is done
    (tests stop there). A null doc_id is a document like others.
    """
    id_ = uuid.uuid4().hex
    to = lambda name: f"{root}/data/{id_}/{name}"
    parts.withColumn("commit_id", F.lit(id_)).write.parquet(to("parts"))
    step("parts")
    log.withColumn("commit_id", F.lit(id_)).write.parquet(to("log"))
    step("log")
    parts, log = spark.read.parquet(to("parts")).drop("commit_id"), spark.read.parquet(to("log")).drop("commit_id")
    N.snapshots(parts, xml_nodes(parts, dealt=True), log, saved_at).withColumn("commit_id", F.lit(id_)).write.parquet(to("snapshots"))
    step("snapshots")
    documents = parts.select("doc_id", F.lit(True).alias("here"))
    if removed is not None:
        documents = documents.unionByName(removed.select("doc_id", F.lit(False).alias("here")))
    documents.groupBy("doc_id").agg(F.bool_or("here").alias("here")).withColumn("commit_id", F.lit(id_)).write.parquet(to("documents"))
    step("documents")
    own = spark.read.parquet(to("documents"))
    while True:
        since = [(n, other) for n, other, _ in manifests(spark, root) if n > expected]
        if since:
            theirs = spark.read.parquet(*(f"{root}/data/{other}/documents" for _, other in since)).select(F.col("doc_id").alias("_d")).distinct()
            if full or not own.join(theirs, F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi").isEmpty():
                raise Conflict(f"commits after {expected} changed documents of this one")
            expected = max(n for n, _ in since)
        if _publish(spark, root, expected + 1, id_, full):
            step("manifest")
            return expected + 1


def read(spark: SparkSession, root: str, number: int | None = None) -> dict[str, DataFrame]:
    """parts, log, snapshots and documents as of a commit, the last one if none is named; documents is (doc_id, commit), each with the commit that it is from. A store without a commit is an error."""
    known = [m for m in manifests(spark, root) if number is None or m[0] <= number]
    if not known or (number is not None and known[-1][0] != number):
        raise ValueError(f"{root} has no commit {number if number is not None else ''}".rstrip())
    first = max((k for k, m in enumerate(known) if m[2]), default=0)
    known = known[first:]
    order = F.create_map(*(F.lit(x) for n, id_, _ in known for x in (id_, n)))
    rows = lambda name: spark.read.parquet(*(f"{root}/data/{id_}/{name}" for _, id_, _ in known))
    documents = rows("documents").withColumn("commit", F.element_at(order, F.col("commit_id")).cast("long"))
    documents = documents.groupBy("doc_id").agg(F.max_by(F.struct("commit", "commit_id", "here"), "commit").alias("x")).where("x.here").select("doc_id", "x.commit", "x.commit_id")
    now = documents.select(F.col("doc_id").alias("_d"), F.col("commit_id").alias("_c"))
    of = lambda name: rows(name).join(now, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("commit_id") == F.col("_c")), "left_semi").drop("commit_id")
    return {"documents": documents.drop("commit_id")} | {name: of(name) for name in TABLES[1:]}


def compact(spark: SparkSession, root: str, saved_at: str) -> int:
    """A commit of all documents as they are now, from which readings start."""
    at = head(spark, root)
    now = read(spark, root, at)
    return commit(spark, root, now["parts"], now["log"], at, saved_at, full=True)
