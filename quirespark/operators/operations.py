"""The operations of a document's log, by kind: which take part, what they touch, and the tables that they leave behind.

A log is (doc_id, seq, op_id, op_type, payload VARIANT), as `sources.packages.read_oplog` gives it. All kinds whose outcome is
a last or first word, a union or a running value are aggregations and windows over any number of documents; the order
of a document's blocks is `blocks` and `operators.replay`; attributes, links and raw nodes are edits of its tree
(`operators.tree`). Operations of unknown kinds stay in the log and have no effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import nested_pairs

#: The kinds of operations, and the field that names the element each is about (None: it is about none).
ELEMENT_OF = {
    "insertParagraphAfter": "after", "insertParagraphBefore": "before", "removeParagraph": "id", "setText": "target", "setParagraphStyle": "target", "insertTable": "at", "removeTable": "id", "setCellText": "table",
    "insertRun": "in", "setRunFormat": "target", "insertBookmark": "at", "insertComment": "anchor", "undo": None, "redo": None, "batchBegin": None, "batchEnd": None, "appendParagraph": "in", "setRuns": "target",
    "defineStyle": None, "beginComponent": "id", "endComponent": "id", "insertTab": "in", "insertBreak": "in", "insertNoBreakHyphen": "in", "insertNode": "parent", "removeNode": "target", "updateAttribute": "target",
    "moveNode": "sourceNode", "insertSiblingAfter": "after", "wrapWithHyperlink": "target", "addRelationship": None, "carryPart": None, "carryBinaryPart": None, "setSectionProperties": "at", "appendTable": "in",
    "appendBlockMarker": None, "setParagraphContent": "target", "setDocumentRoot": None, "setDocumentProlog": None,
}
CONTROLS = ("undo", "redo", "batchBegin", "batchEnd")
UNDOABLE = ("setText", "setParagraphStyle")


def field(name: str, kind: str = "string") -> Column:
    """A field of the payload; null where there is none."""
    return F.try_variant_get("payload", f"$.{name}", kind)


def of_kind(log: DataFrame, *kinds: str) -> DataFrame:
    return log.where(F.col("op_type").isin(*kinds))


def elements(log: DataFrame) -> DataFrame:
    """The log with `element`: what each operation is about, null for operations about no element and for unknown kinds."""
    by_field: dict[str, list[str]] = {}
    for kind, name in ELEMENT_OF.items():
        if name:
            by_field.setdefault(name, []).append(kind)
    element = F.lit(None).cast("string")
    for name, kinds in by_field.items():
        element = F.when(F.col("op_type").isin(*kinds), field(name)).otherwise(element)
    return log.withColumn("element", element)


def unknown(log: DataFrame) -> DataFrame:
    """The operations of no known kind."""
    return log.where(~F.col("op_type").isin(*ELEMENT_OF))


def batches(log: DataFrame) -> DataFrame:
    """(doc_id, begin, end) of closed batches, also inside others."""
    return nested_pairs(log, ["doc_id"], "seq", F.col("op_type") == "batchBegin", F.col("op_type") == "batchEnd")


def components(log: DataFrame) -> DataFrame:
    """(doc_id, id, type, begin, end) of components: a begin and the next end of the same id."""
    rows = of_kind(log, "beginComponent", "endComponent").select("doc_id", "seq", field("id").alias("id"), field("type").alias("type"), (F.col("op_type") == "beginComponent").alias("begins"))
    w = Window.partitionBy("doc_id", "id").orderBy("seq")
    rows = rows.withColumn("end", F.when(~F.lead("begins").over(w), F.lead("seq").over(w)))
    return rows.where("begins").select("doc_id", "id", "type", F.col("seq").alias("begin"), "end")


def taking_part(log: DataFrame) -> DataFrame:
    """The operations that a replay applies: all but controls and what these have undone and not redone.

    An undo names an operation of UNDOABLE, or the begin of a batch that is closed by then, which stands for all in it.
    A control that names nothing before it, another kind, or redoes what was never undone is an error.
    """
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ops = log.select("doc_id", F.col("seq").alias("target"), F.col("op_id").alias("_named"), F.col("op_type").alias("_kind")).where(~F.col("op_type").isin("undo", "redo"))
    controls = of_kind(log, "undo", "redo").select("doc_id", "seq", "op_type", field("targetOpID").alias("_named")).join(ops, ["doc_id", "_named"], "left")
    closed = batches(log).select("doc_id", F.col("begin").alias("target"), "end")
    controls = controls.join(closed, ["doc_id", "target"], "left")
    first_undo = F.min(F.when(F.col("op_type") == "undo", F.col("seq"))).over(Window.partitionBy("doc_id", "_named"))
    allowed = F.coalesce((F.col("target") < F.col("seq")) & (F.col("_kind").isin(*UNDOABLE) | ((F.col("_kind") == "batchBegin") & (F.col("end") < F.col("seq")))), F.lit(False))
    allowed = allowed & ((F.col("op_type") == "undo") | F.coalesce(F.col("seq") > first_undo, F.lit(False)))
    checked = controls.withColumn("_allowed", allowed).where(F.when(~F.col("_allowed"), F.raise_error(F.concat(F.lit("can't "), "op_type", F.lit(" "), F.coalesce("_named", F.lit("null")))).cast("boolean")).otherwise(True))
    last = checked.groupBy("doc_id", "target").agg(F.max_by(F.struct("op_type", "end"), "seq").alias("x")).where("x.op_type = 'undo'").select("doc_id", "target", F.col("x.end").alias("end"))
    singles = last.where("end IS NULL").select("doc_id", F.col("target").alias("seq"))
    # inside an undone batch the count of those begun and not ended is above zero
    edges = last.where("end IS NOT NULL").select("doc_id", F.explode(F.array(F.struct(F.col("target").alias("seq"), F.lit(1).alias("step")), F.struct(F.col("end").alias("seq"), F.lit(-1).alias("step")))).alias("e")).select("doc_id", "e.*")
    steps = edges.groupBy("doc_id", "seq").agg(F.sum("step").alias("_step"))
    rows = log.join(singles, ["doc_id", "seq"], "left_anti").join(steps, ["doc_id", "seq"], "left")
    rows = rows.withColumn("_open", F.sum(F.coalesce("_step", F.lit(0))).over(w))
    return rows.where((F.col("_open") == 0) & ~F.col("op_type").isin(*CONTROLS)).select(*log.columns)


def replacements(log: DataFrame, control: DataFrame) -> DataFrame:
    """What an undo or redo at the end of a log changes in a state that holds all before it: (doc_id, op_type, element, text).

    control is (doc_id, op_id) of those entries. Each text and each style that a controlled operation set gets the value
    of the last one that takes part; without any, a text becomes empty and a style null.
    """
    ids = of_kind(log, "undo", "redo").join(control, ["doc_id", "op_id"]).select("doc_id", field("targetOpID").alias("_named"))
    named = log.select("doc_id", F.col("seq").alias("begin"), F.col("op_id").alias("_named")).join(ids, ["doc_id", "_named"])
    spans = named.join(batches(log), ["doc_id", "begin"], "left").select("doc_id", "begin", F.coalesce("end", "begin").alias("end"))
    value = F.when(F.col("op_type") == "setText", field("text")).otherwise(field("styleId"))
    sets = of_kind(log, *UNDOABLE).select("doc_id", "seq", "op_type", field("target").alias("element"), value.alias("text"))
    touched = sets.join(spans, "doc_id").where("seq BETWEEN begin AND end").select("doc_id", "op_type", "element").distinct()
    now = of_kind(taking_part(log), *UNDOABLE).select("doc_id", "seq", "op_type", field("target").alias("element"), value.alias("text"))
    state = now.groupBy("doc_id", "op_type", "element").agg(F.max_by("text", "seq").alias("text"))
    rows = touched.join(state, ["doc_id", "op_type", "element"], "left")
    return rows.select("doc_id", "op_type", "element", F.when(F.col("op_type") == "setText", F.coalesce("text", F.lit(""))).otherwise(F.col("text")).alias("text"))


def _last(log: DataFrame, keys: dict[str, Column], value: Column) -> DataFrame:
    """The last value by key."""
    rows = log.select("doc_id", "seq", *(c.alias(k) for k, c in keys.items()), value.alias("value"))
    return rows.groupBy("doc_id", *keys).agg(F.max_by("value", "seq").alias("value"))


def texts(log: DataFrame) -> DataFrame:
    """(doc_id, element, value) by setText."""
    return _last(of_kind(log, "setText"), {"element": field("target")}, field("text"))


def paragraph_styles(log: DataFrame) -> DataFrame:
    """(doc_id, element, value) by setParagraphStyle; a null value clears."""
    return _last(of_kind(log, "setParagraphStyle"), {"element": field("target")}, field("styleId"))


def cell_texts(log: DataFrame) -> DataFrame:
    """(doc_id, element, row, column, value) by setCellText."""
    return _last(of_kind(log, "setCellText"), {"element": field("table"), "row": field("row", "int"), "column": field("column", "int")}, field("text"))


def attributes(log: DataFrame) -> DataFrame:
    """(doc_id, element, prefix, name, value) by updateAttribute; a null value takes the attribute away."""
    return _last(of_kind(log, "updateAttribute"), {"element": field("target"), "prefix": field("prefix"), "name": field("localName")}, field("value"))


def run_formats(log: DataFrame, names: tuple[str, ...] = ("bold", "italic", "underline", "fontSize", "color", "fontName")) -> DataFrame:
    """(doc_id, element, one column a name) by setRunFormat: of each property the last that was given."""
    rows = of_kind(log, "setRunFormat").select("doc_id", "seq", field("target").alias("element"), *(field(f"format.{n}").alias(n) for n in names))
    return rows.groupBy("doc_id", "element").agg(*(F.max_by(n, F.when(F.col(n).isNotNull(), F.col("seq"))).alias(n) for n in names))


def sections(log: DataFrame) -> DataFrame:
    """(doc_id, element, value VARIANT) by setSectionProperties; a null element is the document's last section."""
    rows = of_kind(log, "setSectionProperties").select("doc_id", "seq", field("at").alias("element"), F.to_json(field("section", "variant")).alias("value"))
    return rows.groupBy("doc_id", "element").agg(F.max_by("value", "seq").alias("value")).withColumn("value", F.parse_json("value"))


def roots(log: DataFrame) -> DataFrame:
    """(doc_id, prolog, attributes as JSON text) by setDocumentProlog and setDocumentRoot."""
    rows = of_kind(log, "setDocumentProlog", "setDocumentRoot").select("doc_id", "seq", field("prolog").alias("prolog"), F.to_json(field("attributes", "variant")).alias("attributes"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return rows.groupBy("doc_id").agg(last("prolog"), last("attributes"))


def styles_defined(log: DataFrame) -> DataFrame:
    """(doc_id, style_id, name, based_on) by defineStyle: the first definition of an id counts, later ones change nothing."""
    rows = of_kind(log, "defineStyle").select("doc_id", "seq", *(field(f"payload.{f}").alias(c) for f, c in (("styleId", "style_id"), ("name", "name"), ("basedOn", "based_on"))))
    return rows.groupBy("doc_id", "style_id").agg(F.min_by(F.struct("name", "based_on"), "seq").alias("x")).select("doc_id", "style_id", "x.*")


def relationships_added(log: DataFrame) -> DataFrame:
    """(doc_id, part, r_id, type, target, mode) by addRelationship; the same again changes nothing, an id with another target is an error."""
    rows = of_kind(log, "addRelationship").select("doc_id", *(field(f).alias(c) for f, c in (("part", "part"), ("id", "r_id"), ("type", "type"), ("target", "target"))), F.coalesce(field("targetMode"), F.lit("Internal")).alias("mode")).distinct()
    twice = F.count("*").over(Window.partitionBy("doc_id", "part", "r_id")) > 1
    return rows.withColumn("_twice", twice).where(F.when(F.col("_twice"), F.raise_error(F.concat(F.lit("two relationships "), "r_id")).cast("boolean")).otherwise(True)).drop("_twice")


def carried_parts(log: DataFrame) -> DataFrame:
    """(doc_id, part_path, content) by carryPart and carryBinaryPart: the last that came for a path, as bytes."""
    content = F.coalesce(F.encode(field("xml"), "UTF-8"), F.unbase64(field("base64")))
    return _last(of_kind(log, "carryPart", "carryBinaryPart"), {"part_path": field("partPath")}, content).withColumnRenamed("value", "content")


def bookmarks_inserted(log: DataFrame) -> DataFrame:
    """(doc_id, element, id, name) by insertBookmark."""
    return of_kind(log, "insertBookmark").select("doc_id", field("at").alias("element"), field("bookmarkId", "int").alias("id"), field("name").alias("name"))


def comments_inserted(log: DataFrame) -> DataFrame:
    """(doc_id, element, id, author, text) by insertComment."""
    return of_kind(log, "insertComment").select("doc_id", field("anchor").alias("element"), field("commentId", "int").alias("id"), field("author").alias("author"), field("text").alias("text"))


def links_wrapped(log: DataFrame) -> DataFrame:
    """(doc_id, element, value: r_id) by wrapWithHyperlink."""
    return _last(of_kind(log, "wrapWithHyperlink"), {"element": field("target")}, field("rId"))


def inline_content(log: DataFrame) -> DataFrame:
    """(doc_id, element, runs array<string>): what stands in each paragraph that an operation wrote into.

    setText, setRuns and setParagraphContent replace it; insertRun comes in at its position (at the end beyond it);
    insertTab, insertBreak and insertNoBreakHyphen come last. A fold over one paragraph's operations in order.
    """
    kinds = ("setText", "setRuns", "setParagraphContent", "insertRun", "insertTab", "insertBreak", "insertNoBreakHyphen")
    texts_of = lambda name: F.transform(field(name, "array<variant>"), lambda v: F.coalesce(F.try_variant_get(v, "$.text", "string"), F.try_variant_get(v, "$.run.text", "string")))
    whole = F.when(F.col("op_type") == "setText", F.array(field("text"))).when(F.col("op_type") == "setRuns", texts_of("runs")).when(F.col("op_type") == "setParagraphContent", F.filter(texts_of("items"), lambda t: t.isNotNull()))
    atom = F.when(F.col("op_type") == "insertTab", "\t").when(F.col("op_type") == "insertBreak", "\n").when(F.col("op_type") == "insertNoBreakHyphen", "‑").when(F.col("op_type") == "insertRun", field("run.text"))
    rows = elements(of_kind(log, *kinds)).select("doc_id", "element", "seq", whole.alias("whole"), atom.alias("atom"), F.when(F.col("op_type") == "insertRun", field("position", "int")).alias("at"))
    ops = F.array_sort(F.collect_list(F.struct("seq", "whole", "atom", "at")))

    def step(out: Column, o: Column) -> Column:
        at = F.least(F.coalesce(o["at"], F.size(out)), F.size(out))
        return F.when(o["whole"].isNotNull(), o["whole"]).otherwise(F.concat(F.slice(out, 1, at), F.array(o["atom"]), F.slice(out, at + 1, F.greatest(F.size(out) - at, F.lit(0)))))

    return rows.groupBy("doc_id", "element").agg(F.aggregate(ops, F.array().cast("array<string>"), step).alias("runs"))


def blocks(log: DataFrame) -> DataFrame:
    """The log's operations on blocks as steps of `operators.replay`: (doc_id, seq, op, target, element, text, style, kind).

    A new block's element is the id in its payload, else that of its operation. Texts and styles of new paragraphs come
    from their payload; a raw sibling is a marker with its XML for a text.
    """
    kind = F.col("op_type")
    op = (
        F.when(kind.isin("insertParagraphAfter", "insertTable", "insertSiblingAfter"), "insertAfter").when(kind == "insertParagraphBefore", "insertBefore").when(kind.isin("appendParagraph", "appendTable", "appendBlockMarker"), "append")
        .when(kind.isin("removeParagraph", "removeTable", "removeNode"), "remove").when(kind == "setText", "setText").when(kind == "setParagraphStyle", "setStyle")
    )
    new = op.isin("insertAfter", "insertBefore", "append")
    rows = elements(log).withColumn("op", op).where("op IS NOT NULL")
    own = F.coalesce(field("paragraph.paraId"), field("table.id"), field("marker.id"), F.col("op_id"))
    text = F.coalesce(field("text"), field("paragraph.text"), field("nodeXML"), F.to_json(field("table", "variant")), F.to_json(field("marker", "variant")))
    what = F.when(kind.isin("insertTable", "appendTable"), "table").when(kind.isin("appendBlockMarker", "insertSiblingAfter"), "marker").otherwise("paragraph")
    return rows.select(
        "doc_id", "seq", "op", F.when(F.col("op") != "append", F.col("element")).alias("target"), F.when(new, own).alias("element"), text.alias("text"), F.coalesce(field("styleId"), field("paragraph.styleId")).alias("style"), F.when(new, what).alias("kind")
    )
