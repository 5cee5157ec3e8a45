"""Sequence fields numbered anew and their results written back, over bodies, headers, footers and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.package_tables import fields, parsed_code
from ..sources.packages import attribute
from ..sources.scratch import stored
from . import tree as T
from .tree import KEY

DOCUMENT = "word/document.xml"


def container() -> Column:
    """The place of a part among those that are numbered: body, headers, footers, footnotes, endnotes, each kind by its number; null for other parts."""
    p = F.col("part_path")
    number = F.lpad(F.regexp_extract(p, r"(\d+)\.xml$", 1), 9, "0")
    kinds = [(p == DOCUMENT, "0"), (p.rlike(r"^word/header\d*\.xml$"), "1"), (p.rlike(r"^word/footer\d*\.xml$"), "2"), (p == "word/footnotes.xml", "3"), (p == "word/endnotes.xml", "4")]
    return F.coalesce(*(F.when(c, F.concat(F.lit(n), number)) for c, n in kinds))


def _apart(nodes: DataFrame) -> DataFrame:
    """The nodes of numbered parts, each part as a document's body of its own: the readers of fields know one part only."""
    own = F.concat("doc_id", F.lit("\x1f"), "part_path")
    return nodes.where(container().isNotNull()).withColumn("doc_id", own).withColumn("part_path", F.lit(DOCUMENT))


def _together(rows: DataFrame) -> DataFrame:
    return rows.withColumn("part_path", F.substring_index("doc_id", "\x1f", -1)).withColumn("doc_id", F.expr("left(doc_id, length(doc_id) - length(part_path) - 1)"))


def sequence_values(nodes: DataFrame, isolated: bool = False) -> DataFrame:
    """(doc_id, part_path, node_id, identifier, old, value): every closed SEQ field with its number.

    Numbers go up by identifier through the body, then headers, footers, footnotes and endnotes; isolated: each of these
    containers counts for itself, all footnotes being one, and all endnotes. A field with a level begins again at 1
    when the number of headings of that level (style "Heading n", directly in the body) is not what it was at the
    identifier's last field with a level. Outside the body headings don't count, and the body's number holds on.
    """
    found = _together(fields(_apart(nodes))).withColumn("p", parsed_code(F.col("code"))).where("p.kind = 'SEQ' AND closed")
    seq = found.select(*KEY, "node_id", F.col("p.argument").alias("identifier"), F.col("p.level").alias("level"), F.col("result").alias("old"), container().alias("_c"))
    top = nodes.where((F.col("part_path") == DOCUMENT) & (F.col("name") == "w:pStyle") & (F.size("path") == 5)).select(*KEY, "node_id", F.regexp_extract(attribute("w:val"), r"^Heading (\d+)$", 1).try_cast("int").alias("level"))
    heads = top.where("level IS NOT NULL").select(*KEY, "node_id", F.lit(None).cast("string").alias("identifier"), "level", F.lit(None).cast("string").alias("old"), container().alias("_c"))
    both = seq.where("level IS NOT NULL").unionByName(heads)
    before = Window.partitionBy("doc_id", "level").orderBy("_c", "node_id").rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("_h", F.count_if(F.col("identifier").isNull()).over(before)).where("identifier IS NOT NULL").select(*KEY, "node_id", "_h")
    rows = seq.join(counted, [*KEY, "node_id"], "left")
    if isolated:
        rows = rows.withColumn("_h", F.when((F.col("part_path") == DOCUMENT) | F.col("_h").isNull(), F.col("_h")).otherwise(0))
    keys = ["doc_id", *(["part_path"] if isolated else []), "identifier"]
    mine = Window.partitionBy(*keys).orderBy("_c", "node_id")
    last = F.last("_h", ignorenulls=True).over(mine.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_reset", F.when(F.col("_h").isNotNull() & (F.col("_h") != F.coalesce(last, F.lit(-1))), 1).otherwise(0))
    rows = rows.withColumn("_group", F.sum("_reset").over(mine.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("value", F.row_number().over(Window.partitionBy(*keys, "_group").orderBy("_c", "node_id")).cast("long")).select(*KEY, "node_id", "identifier", "old", "value")


def result_texts(nodes: DataFrame) -> DataFrame:
    """(doc_id, part_path, node_id, path): the w:t elements that show the result of each field (its node_id as in `fields`), not those of fields inside it."""
    n = _apart(nodes)
    simple = n.where("name = 'w:t'").select("doc_id", F.try_element_at("within", F.lit("w:fldSimple"))["node_id"].alias("node_id"), "path").where("node_id IS NOT NULL")
    mark = F.when(F.col("name") == "w:fldChar", attribute("w:fldCharType"))
    rows = n.where("name IN ('w:fldChar', 'w:t')").select("doc_id", "node_id", "path", mark.alias("_mark"))
    so_far = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_d", F.sum(F.when(F.col("_mark") == "begin", 1).when(F.col("_mark") == "end", -1).otherwise(0)).over(so_far) + F.when(F.col("_mark") == "end", 1).otherwise(0)).where("_d > 0")
    level = Window.partitionBy("doc_id", "_d").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_of", F.last(F.when(F.col("_mark") == "begin", F.col("node_id")), ignorenulls=True).over(level)).withColumn("_state", F.last("_mark", ignorenulls=True).over(level))
    spread = rows.where("_mark IS NULL AND _state = 'separate'").select("doc_id", F.col("_of").alias("node_id"), "path")
    return _together(simple.unionByName(spread)).select(*KEY, "node_id", "path")


def update_fields(nodes: DataFrame, isolated: bool = False) -> DataFrame:
    """The trees of the packages with the numbers of their SEQ fields written in: the first text of a field's result becomes its number, any other text of the result goes. A field that shows nothing keeps its code only."""
    nodes = stored(nodes, "nodes")
    values = sequence_values(nodes, isolated).where("old <> CAST(value AS STRING)")
    spots = result_texts(nodes).join(values, [*KEY, "node_id"])
    first = F.row_number().over(Window.partitionBy(*KEY, "node_id").orderBy("path")) == 1
    texts = spots.withColumn("_1", first).select(*KEY, "path", F.when(F.col("_1"), F.col("value").cast("string")).otherwise("").alias("text"))
    return T.set_text(T.tree_of(nodes), stored(texts, "results"))
