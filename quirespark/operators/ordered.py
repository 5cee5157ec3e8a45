"""Ordered computation: counters, islands, running values, nearest values, nesting."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seq_counter(fields: DataFrame, keys: list[str], ident: str, order: str, headings: Column) -> DataFrame:
    """Sequence numbers by identifier in document order, from 1 again when the count of headings so far has changed since the identifier's last number.

    `headings` is 1 on heading rows. Headings carry no number. Two windows on one partitioning, no loop.
    """
    so_far = F.sum(headings).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = fields.withColumn("_h", so_far).where(headings == 0)
    mine = Window.partitionBy(*keys, ident).orderBy(order)
    rows = rows.withColumn("_reset", (F.col("_h") != F.coalesce(F.lag("_h").over(mine), F.lit(-1))).cast("int"))
    rows = rows.withColumn("_group", F.sum("_reset").over(mine.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("value", F.row_number().over(Window.partitionBy(*keys, ident, "_group").orderBy(order)).cast("long")).drop("_h", "_reset", "_group")


def islands(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Stretches of neighbours with equal value: (keys, value, first, size)."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("int")
    numbered = rows.withColumn("_changed", changed).withColumn("_island", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island", value).agg(F.min(order).alias("first"), F.count("*").alias("size")).drop("_island")


def above(rows: DataFrame, keys: list[str], order: str, value: str) -> dict[str, Column]:
    """Formula values over the cells above in the same column: sum, average, count, max, min; null (count: 0) in the first row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    cents = F.round(F.col(value) * 100).cast("long")  # whole numbers, so that order never shows in the last digits
    return {
        "sum": F.sum(cents).over(w) / 100,
        "avg": F.sum(cents).over(w) / F.count(cents).over(w) / 100,
        "count": F.count(value).over(w),
        "max": F.max(value).over(w),
        "min": F.min(value).over(w),
    }


def nearest_before(rows: DataFrame, keys: list[str], order: str, value: Column) -> Column:
    """The last non-null value at or before each row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def nested_pairs(rows: DataFrame, keys: list[str], order: str, begins: Column, ends: Column) -> DataFrame:
    """(keys, begin, end) of each begin and the end that closes it; begins that stay open have none.

    A begin and its end stand at one depth, and there they alternate, so the end is the next row of that depth.
    """
    step = F.when(begins, 1).when(ends, -1)
    marks = rows.where(begins | ends).select(*keys, order, begins.alias("_b"), step.alias("_s"))
    depth = F.sum("_s").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    marks = marks.withColumn("_d", depth + F.when(F.col("_b"), 0).otherwise(1))
    level = Window.partitionBy(*keys, "_d").orderBy(order)
    marks = marks.withColumn("end", F.when(~F.lead("_b").over(level), F.lead(order).over(level)))
    return marks.where("_b AND end IS NOT NULL").select(*keys, F.col(order).alias("begin"), "end")
