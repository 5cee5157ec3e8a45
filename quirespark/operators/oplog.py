"""An append-only log of operations: replay, undo and redo, blame, time travel, conflicts.

Rows are oplog(doc_id, seq, element, op, value, ts). Values are last-writer-wins by (doc_id, element), so a replay is one
partial aggregation; structural replay per document is in `operators.replay`.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def materialized(log: DataFrame) -> DataFrame:
    """The state after all of `log`: the value of the last operation on each element."""
    return log.groupBy("doc_id", "element").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def at_index(log: DataFrame, n: int) -> DataFrame:
    """The state after each document's first n operations."""
    return materialized(log.where(F.col("seq") <= n))


def at_time(log: DataFrame, when: str) -> DataFrame:
    """The state of the operations stamped at or before `when`; stamps need not rise with seq."""
    return materialized(log.where(F.col("ts") <= F.lit(when).cast("timestamp")))


def active(log: DataFrame, controls: DataFrame) -> DataFrame:
    """The operations that take part in a replay: all but those whose last control is an undo.

    controls(doc_id, target, seq, kind) with kind undo or redo; one before its target, and a redo whose target is not undone then, counts for nothing.
    """
    ops = log.select("doc_id", F.col("seq").alias("target"))
    valid = controls.join(ops, ["doc_id", "target"]).where("seq > target")
    state = valid.groupBy("doc_id", "target").agg(F.max_by("kind", "seq").alias("last"))
    undone = state.where("last = 'undo'").select("doc_id", F.col("target").alias("seq"))
    return log.join(undone, ["doc_id", "seq"], "left_anti")


def blame(log: DataFrame) -> DataFrame:
    """The last operation that touched each element."""
    return log.groupBy("doc_id", "element").agg(F.max_by(F.struct("seq", "op", "ts"), "seq").alias("x")).select("doc_id", "element", "x.seq", "x.op")


def previous_values(log: DataFrame) -> DataFrame:
    """Each operation with the value it replaced."""
    return log.withColumn("previous", F.lag("value").over(Window.partitionBy("doc_id", "element").orderBy("seq")))


def first_definitions(log: DataFrame, name: str) -> DataFrame:
    """A name is defined by its first operation; later ones change nothing."""
    return log.groupBy("doc_id", name).agg(F.min_by("value", "seq").alias("value"), F.min("seq").alias("seq"))


def conflicts(local: DataFrame, outside: DataFrame) -> DataFrame:
    """Outside operations on elements with pending local ones, each with the first of these."""
    first = local.groupBy("doc_id", "element").agg(F.min("seq").alias("local_seq"))
    return outside.join(first, ["doc_id", "element"]).select("doc_id", "element", F.col("seq").alias("outside_seq"), "local_seq")


def resolved(local: DataFrame, outside: DataFrame, policy: str) -> DataFrame:
    """The outside operations that are let in: local_wins drops those in conflict, outside_wins drops none, abort fails if there are any."""
    if policy == "outside_wins":
        return outside
    touched = local.select("doc_id", "element").distinct()
    if policy == "local_wins":
        return outside.join(touched, ["doc_id", "element"], "left_anti")
    if policy == "abort":
        hit = outside.join(touched.withColumn("hit", F.lit(True)), ["doc_id", "element"], "left")
        return hit.where(F.when(F.col("hit"), F.raise_error(F.lit("an outside operation conflicts with a pending one")).cast("boolean")).otherwise(True)).drop("hit")
    raise ValueError(f"no such policy: {policy}")


def resumed(snapshot: DataFrame, tail: DataFrame) -> DataFrame:
    """The state after a stored state and the operations that came since: the later of both for each element, so old operations are not read again."""
    both = snapshot.select("doc_id", "element", "value", "seq").unionByName(materialized(tail).select("doc_id", "element", "value", "seq"))
    return both.groupBy("doc_id", "element").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def attribute_state(log: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """Upserts of some attributes at a time: for each attribute the last value that was given; nulls leave it as it was."""
    last = [F.max_by(F.col(a), F.when(F.col(a).isNotNull(), F.col("seq"))).alias(a) for a in attributes]
    return log.groupBy(*keys).agg(*last)


def touching(log: DataFrame, elements: DataFrame) -> DataFrame:
    """The operations on any of (doc_id, element)."""
    return log.join(elements.select("doc_id", "element").distinct(), ["doc_id", "element"], "left_semi")


def imported(old: DataFrame, new: DataFrame, pending: DataFrame, policy: str) -> DataFrame:
    """Outside changes as operations: what differs between two generations, less what the policy keeps out.

    old and new are (doc_id, ord, stable_id, text), pending the local operations (doc_id, element, seq), element being
    a stable id. Returns (doc_id, element, kind, old_ord, new_ord); paragraphs without an id touch no element.
    """
    from .compare import paragraph_diff

    ids = old.select("doc_id", F.col("ord").alias("old_ord"), "stable_id")
    found = paragraph_diff(old, new).join(ids, ["doc_id", "old_ord"], "left").withColumnRenamed("stable_id", "element")
    return resolved(pending, found, policy).select("doc_id", "element", "kind", "old_ord", "new_ord")
