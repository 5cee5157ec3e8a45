"""Chains of parents: style inheritance, comment threads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path


def chains(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, depth, root) of every node of (keys, id, parent): how many parents stand above it, and the last of them.

    All chains double at once: a node's parent at distance 2^k is the one at 2^(k-1) of that at 2^(k-1), so a depth of d
    takes log2(d) joins, each written before the next, and no more are made than there is depth. A missing parent ends
    a chain at the last node before it. A chain still going on after as many steps as its largest key has nodes runs into
    a cycle: it has no last node, so its depth and root are null.
    """
    spark = nodes.sparkSession
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    a, b = nodes.alias("a"), nodes.alias("b")
    up = a.join(b, [*same, F.col("a.parent") == F.col("b.id")], "left").select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.id").alias("id"), F.col("b.id").alias("far"), F.when(F.col("b.id").isNull(), 0).otherwise(1).alias("depth"))
    step = 1
    largest = None
    while True:
        a, b = up.alias("a"), up.alias("b")
        joined = a.join(b, [*same, F.col("a.far") == F.col("b.id")], "left").select(
            *(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.id").alias("id"), F.coalesce("b.far", "a.far").alias("far"), (F.col("a.depth") + F.coalesce("b.depth", F.lit(0))).alias("depth"), F.col("b.far").isNotNull().alias("moved")
        )
        joined.write.parquet(path := scratch_path(spark, "chains"))
        stored = spark.read.parquet(path).hint("merge")  # as in `scratch.stored`
        up = stored.drop("moved")
        step *= 2
        if stored.where("moved").isEmpty():
            return up.select(*keys, "id", F.col("depth").cast("long").alias("depth"), F.coalesce("far", "id").alias("root"))
        if step > 64:
            largest = largest or nodes.groupBy(*keys).count().agg(F.max("count")).first()[0]
            if step >= 2 * largest:
                ends = ~F.col("moved")
                return stored.select(*keys, "id", F.when(ends, F.col("depth")).cast("long").alias("depth"), F.when(ends, F.coalesce("far", "id")).alias("root"))


def heading_levels(styles: DataFrame) -> DataFrame:
    """(doc_id, id, level) of styles (doc_id, id, name, based_on): 1 to 9 where a style, or one that it is based on, is a heading by its id or its name; else null.

    All styles look up at once, twice as far each time, as in `chains`; a cycle without a heading in it has no level.
    """
    spark = styles.sparkSession
    number = lambda c, pattern: F.nullif(F.regexp_extract(F.lower(c), pattern, 1), F.lit("")).cast("int")
    own = F.coalesce(number("id", "^heading([1-9])$"), number("name", r"^heading\s*([1-9])\s*$"), number("based_on", "^heading([1-9])$"))
    rows = styles.select("doc_id", "id", own.alias("level"), F.when(own.isNull(), F.col("based_on")).alias("up"))
    largest, step = None, 1
    while True:
        a, b = rows.alias("a"), rows.alias("b")
        joined = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.up") == F.col("b.id")), "left").select("a.doc_id", "a.id", F.coalesce("a.level", "b.level").alias("level"), F.when(F.col("b.level").isNull(), F.col("b.up")).alias("up"))
        joined.write.parquet(path := scratch_path(spark, "headings"))
        rows, step = spark.read.parquet(path).hint("merge"), step * 2
        if rows.where("up IS NOT NULL").isEmpty():
            break
        largest = largest or styles.groupBy("doc_id").count().agg(F.max("count")).first()[0]
        if step >= 2 * largest:
            break
    return rows.select("doc_id", "id", "level")
