"""Comparison of generations and parts; hashes and coverage."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paragraph_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, kind, old_ord, new_ord) for what differs between two generations of (doc_id, ord, stable_id, text).

    Paragraphs pair by stable id; those without one, by text and place among equals. A pair whose texts differ is
    setText, what is only old is remove, only new is insert. Moved paragraphs are no difference.
    """
    sides = [x.select("doc_id", F.col("ord").alias(f"{n}_ord"), "stable_id", F.col("text").alias(f"{n}_text")) for n, x in (("old", old), ("new", new))]
    by_id = sides[0].where("stable_id IS NOT NULL").join(sides[1].where("stable_id IS NOT NULL"), ["doc_id", "stable_id"], "full_outer").select("doc_id", "old_ord", "new_ord", "old_text", "new_text")
    nth = []
    for n, x in zip(("old", "new"), sides, strict=True):
        mark = F.coalesce(F.sha2(f"{n}_text", 256), F.lit("null"))
        nth.append(x.where("stable_id IS NULL").withColumn("mark", mark).withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy(f"{n}_ord"))).drop("stable_id"))
    by_text = nth[0].join(nth[1], ["doc_id", "mark", "nth"], "full_outer").select("doc_id", "old_ord", "new_ord", "old_text", "new_text")
    kind = F.when(F.col("new_ord").isNull(), "remove").when(F.col("old_ord").isNull(), "insert").when(~F.col("old_text").eqNullSafe(F.col("new_text")), "setText")
    return by_id.unionByName(by_text).select("doc_id", kind.alias("kind"), "old_ord", "new_ord").where("kind IS NOT NULL")


def part_verdicts(reference: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Each part path: equal, different, missing or extra. Parts are compared by SHA-256, so contents stay where they are."""
    a = reference.select("doc_id", "part_path", F.sha2("content", 256).alias("a"))
    b = rebuilt.select("doc_id", "part_path", F.sha2("content", 256).alias("b"))
    verdict = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") == F.col("b"), "equal").otherwise("different")
    return a.join(b, ["doc_id", "part_path"], "full_outer").select("doc_id", "part_path", verdict.alias("verdict"))


def coverage(parts: DataFrame, keys: list[str], covered: str, total: str) -> DataFrame:
    """Covered and total bytes and their ratio, which is 0 where there are no bytes."""
    sums = parts.groupBy(*keys).agg(F.sum(covered).cast("long").alias("covered"), F.sum(total).cast("long").alias("total"))
    return sums.withColumn("ratio", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.round(F.col("covered") / F.col("total"), 6)))


def first_divergence(a: Column, b: Column) -> Column:
    """The place of the first byte in which two BINARY columns differ; the shorter length where one begins the other, null where they are equal. An Arrow UDF, as Spark has no such function."""

    @F.pandas_udf("long")
    def place(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            if x is None or y is None or x == y:
                out.append(None)
                continue
            n = min(len(x), len(y))
            differ = np.flatnonzero(np.frombuffer(x, np.uint8)[:n] != np.frombuffer(y, np.uint8)[:n])
            out.append(int(differ[0]) if len(differ) else n)
        return pd.Series(out, dtype="Int64")

    return place(a, b)


def all_equal(reference: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(doc_id, equal): whether both generations have the same parts with the same bytes."""
    return part_verdicts(reference, rebuilt).groupBy("doc_id").agg(F.bool_and(F.col("verdict") == "equal").alias("equal"))
