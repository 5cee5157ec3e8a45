"""Edits of document tables: set, insert, append, delete, renumber, merge of declarations, new ids.

An edit is a DataFrame of the rows it concerns, for any number of documents at once, joined by key; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def set_values(rows: DataFrame, keys: list[str], changes: DataFrame, columns: list[str]) -> DataFrame:
    """Takes `columns` from `changes` where keys match; one change a key. A change to null clears the value."""
    new = changes.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.struct(*columns).alias("_new"))
    joined = rows.join(new, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left")
    return joined.select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))


def delete(rows: DataFrame, keys: list[str], gone: DataFrame, *children: DataFrame) -> list[DataFrame]:
    """Rows without those whose keys are in `gone`, and the same for tables that hang on them by the same keys."""
    return [t.join(gone.select(*keys).distinct(), keys, "left_anti") for t in (rows, *children)]


def renumbered(rows: DataFrame, doc: str, order: list[str | Column], name: str = "ord") -> DataFrame:
    """Places from 0 in each document, by `order`."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(doc).orderBy(*order)) - 1).cast("long"))


def insert_at(rows: DataFrame, new: DataFrame, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """New rows come to stand at their `order`; what stands there and after moves on. Several at one place keep the order of their text."""
    both = rows.withColumn("_new", F.lit(1)).unionByName(new.withColumn("_new", F.lit(0)))
    return renumbered(both, doc, [order, "_new", "text"], order).drop("_new")


def append(rows: DataFrame, new: DataFrame, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """New rows come after all others of their document, by their own `order`."""
    both = rows.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return renumbered(both, doc, ["_new", order], order).drop("_new")


def anchor_after(rows: DataFrame, needle: str, n: int = 1, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """(doc, order) just after the n-th row that contains the needle; documents without it have no row."""
    hits = rows.where(F.contains("text", F.lit(needle))).withColumn("_n", F.row_number().over(Window.partitionBy(doc).orderBy(order)))
    return hits.where(F.col("_n") == n).select(doc, (F.col(order) + 1).alias(order))


def merged_declarations(originals: DataFrame, typed: DataFrame, keys: list[str], managed: Column) -> DataFrame:
    """Declarations of a package after its typed model changed: all typed ones, and originals that are neither managed nor declared anew."""
    kept = originals.where(~F.coalesce(managed, F.lit(False))).join(typed.select(*keys), keys, "left_anti")
    return kept.unionByName(typed)


def next_number(rows: DataFrame, keys: list[str], ids: Column, least: int = 1) -> DataFrame:
    """The number after the largest in use, from the digits at the end of an id; `least` where there are none."""
    n = F.regexp_extract(ids.cast("string"), r"([0-9]+)$", 1)
    return rows.groupBy(*keys).agg(F.greatest(F.lit(least).cast("long"), F.coalesce(F.max(F.when(n != "", n.cast("long"))) + 1, F.lit(least).cast("long"))).alias("next_id"))


def revisions_settled(runs: DataFrame, accept: bool) -> DataFrame:
    """Runs after all revisions are accepted or rejected: the losing kind goes, the other becomes plain text. `revision` is insertion, deletion or null."""
    loser = "deletion" if accept else "insertion"
    return runs.where(F.coalesce(F.col("revision") != loser, F.lit(True))).withColumn("revision", F.lit(None).cast("string"))
