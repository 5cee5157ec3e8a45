"""Formulas as trees: what each of their components is, what it reads as, and the text of paragraphs with their formulas in it.

A formula is a sequence of components; a component that is known by name has arguments, each a sequence again. What is
seen of a formula are leaves: the text of m:t, and the sign of an n-ary operator. Each leaf gets a key, the places that
its ancestors have in reading order, by one fold over its path from the formula down. So the text of every component is
its leaves in the order of their keys, however deep formulas are nested: one join with ancestors, one aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.packages import attribute
from ..sources.scratch import stored
from .documents import Document, Node, rarely_collected

#: The components that are known, and their arguments in reading order. All others read as the text in them.
ARGUMENTS = {"m:f": ("m:num", "m:den"), "m:sSub": ("m:e", "m:sub"), "m:sSup": ("m:e", "m:sup"), "m:sSubSup": ("m:e", "m:sub", "m:sup"), "m:rad": ("m:deg", "m:e"), "m:nary": ("m:sub", "m:sup", "m:e"), "m:acc": ("m:e",)}
#: The signs of n-ary operators; any other, or none, reads as the first.
SIGNS = ("∑", "∫", "∏", "∬", "∮", "⋃", "⋂")
#: What holds runs of its own, in the order in which a paragraph's text takes them after its own runs.
HOLDERS = ("w:hyperlink", "w:fldSimple", "mc:AlternateContent", "w:sdt")
KEY = ["doc_id", "part_path", "formula_id"]
_STATE = "struct<mode:string,key:array<bigint>,ids:array<bigint>,kinds:array<string>>"


def _up(n: int) -> Column:
    return F.slice("path", 1, F.greatest(F.size("path") - n, F.lit(0)))


def _formula_nodes(nodes: DataFrame) -> DataFrame:
    """The nodes of formulas with formula_id; of alternate content only the fallback counts."""
    inside = nodes.withColumn("formula_id", F.try_element_at("within", F.lit("m:oMath"))["node_id"])
    return inside.where(F.col("formula_id").isNotNull() & F.try_element_at("within", F.lit("mc:Choice")).isNull())


def _leaves(nodes: DataFrame) -> DataFrame:
    """(KEY, text, at): the leaves that are seen; at holds a leaf's key and the components it stands in, from the outside in: ids and kinds."""
    n = stored(_formula_nodes(nodes).select(*KEY, "node_id", "path", "ord", "kind", "name", "text", "attrs"), "formulas")
    value = F.coalesce(attribute("m:val"), attribute("w:val"))
    said = n.where("name IN ('m:chr', 'm:degHide')").select(*KEY, _up(2).alias("_of"), "name", value.alias("value")).groupBy(*KEY, "_of").agg(
        F.max(F.when(F.col("name") == "m:chr", F.col("value"))).alias("sign"),
        F.bool_or(F.when(F.col("name") == "m:degHide", F.coalesce("value", F.lit("1")).isin("1", "true", "on"))).alias("hides"),
    )
    first = F.row_number().over(Window.partitionBy(*KEY, _up(1), "name").orderBy("ord")) == 1
    elements = n.where("kind = 'element'").withColumn("_of", F.when(F.col("name") == "m:deg", _up(1)).otherwise(F.col("path"))).withColumn("first", first)
    elements = elements.join(said, [*KEY, "_of"], "left").withColumn("first", F.col("first") & ((F.col("name") != "m:deg") | ~F.coalesce("hides", F.lit(False))))
    above = elements.select(*KEY, F.col("path").alias("_up"), F.struct(F.size("path").alias("depth"), "node_id", "ord", "name", "first").alias("step"))
    sign = F.when(F.col("sign").isin(*SIGNS), F.col("sign")).otherwise(SIGNS[0])
    signs = elements.where("name = 'm:nary'").select(*KEY, "node_id", "path", sign.alias("text"), F.lit(True).alias("is_sign"))
    holders = elements.where("name = 'm:t'").select(*KEY, F.col("path").alias("_t"))
    texts = n.where("kind = 'text'").withColumn("_t", _up(1)).join(holders, [*KEY, "_t"], "left_semi")
    leaves = signs.unionByName(texts.select(*KEY, "node_id", "path", "text", F.lit(False).alias("is_sign")))
    leaves = leaves.withColumn("_up", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k)))).drop("path")
    walks = leaves.join(above, [*KEY, "_up"]).groupBy(*KEY, "node_id", "is_sign").agg(F.first("text").alias("text"), F.array_sort(F.collect_list("step")).alias("steps"))
    within = F.filter("steps", lambda x: x["node_id"] > F.col("formula_id"))
    walks = walks.withColumn("at", F.aggregate(within, _begin(), _step))
    # a sign comes before the arguments; texts under one element are told apart by their place in the part
    last = F.when(F.col("is_sign"), F.lit(-1)).otherwise(F.col("node_id"))
    return walks.where("at.mode IS NOT NULL AND (NOT is_sign OR at.mode = 'm:nary')").select(*KEY, "text", F.col("at").withField("key", F.concat("at.key", F.array(last.cast("bigint")))).alias("at"))


def _begin() -> Column:
    nothing = F.array()
    return F.struct(F.lit("sequence").alias("mode"), nothing.alias("key"), nothing.alias("ids"), nothing.alias("kinds")).cast(_STATE)


def _step(at: Column, x: Column) -> Column:
    """One element further down: a component of a sequence, an argument of a component, or anything inside what reads as the text in it. mode null: nothing below is seen."""
    places = F.create_map(*(F.lit(v) for kind, names in ARGUMENTS.items() for i, name in enumerate(names) for v in (f"{kind} {name}", i)))
    place = F.try_element_at(places, F.concat_ws(" ", at["mode"], x["name"]))
    known, new = at["mode"].isin(*ARGUMENTS), at["mode"] == "sequence"
    mode = (
        F.when(at["mode"].isNull(), None)
        .when(known, F.when(place.isNotNull() & x["first"], "sequence"))
        .when(new, F.when(x["name"].isin(*ARGUMENTS), x["name"]).otherwise("text"))
        .otherwise(at["mode"])
    )
    key = F.concat(at["key"], F.array(F.when(known, F.coalesce(place, F.lit(0))).otherwise(x["ord"]).cast("bigint")))
    more = lambda field, value: F.when(new, F.concat(at[field], F.array(value))).otherwise(at[field])
    return F.struct(mode.alias("mode"), key.alias("key"), more("ids", x["node_id"]).alias("ids"), more("kinds", x["name"]).alias("kinds")).cast(_STATE)


def _joined(order: str) -> Column:
    """The texts of a group in the order of a column."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "")


def formula_texts(nodes: DataFrame) -> DataFrame:
    """(doc_id, part_path, formula_id, text): what each formula with a visible leaf reads as; formula_id is the node of its m:oMath.

    Fractions read numerator, denominator; scripts base, lower, upper; radicals degree (unless hidden), radicand; n-ary
    operators their sign, lower, upper, operand; accents their base alone; whatever else (matrices, delimiters,
    functions) the text of m:t in it, in document order. Of an argument that comes twice the first counts, an argument that the
    component has none of is not seen. Formulas in mc:Choice are left out, their fallback stands for them.
    """
    return _leaves(nodes).groupBy(*KEY).agg(_joined("at.key").alias("text"))


def components(nodes: DataFrame) -> DataFrame:
    """(doc_id, part_path, formula_id, node_id, kind, parent_id, depth, text): every component of a sequence, from the formula's own (depth 0, parent null) to those in arguments; parent_id is the component around it. One in which nothing is seen has no row."""
    each = _leaves(nodes).select(*KEY, "text", F.col("at.key").alias("key"), F.posexplode(F.arrays_zip("at.ids", "at.kinds", F.concat(F.array(F.lit(None).cast("bigint")), F.slice("at.ids", 1, F.size("at.ids") - 1)).alias("parents"))).alias("depth", "c"))
    rows = each.select(*KEY, "key", "text", "depth", F.col("c.ids").alias("node_id"), F.col("c.kinds").alias("kind"), F.col("c.parents").alias("parent_id"))
    return rows.groupBy(*KEY, "node_id", "kind", "parent_id", "depth").agg(_joined("key").alias("text")).select(*KEY, "node_id", "kind", "parent_id", "depth", "text")


def display_texts(nodes: DataFrame) -> DataFrame:
    """(doc_id, part_path, node_id, text): what each paragraph reads as, formulas in it included; node_id is the w:p.

    First come the paragraph's own runs and formulas as they stand, then those in links, in simple fields, in the fallback
    of alternate content and in content controls, each in their order. Deleted text, field codes and mc:Choice are left
    out, paragraphs inside (text boxes) have rows of their own. A paragraph without any text has an empty one.
    """
    nodes = stored(nodes, "nodes")
    of = F.try_element_at("within", F.lit("w:p"))["node_id"]
    inside = lambda name: F.try_element_at("within", F.lit(name))["node_id"]
    shown = F.when((F.col("kind") == "text") & inside("w:t").isNotNull(), F.col("text")).when(F.col("name") == "w:tab", "\t").when(F.col("name").isin("w:br", "w:cr"), "\n").when(F.col("name") == "w:noBreakHyphen", "\u2011")
    shown = F.when(inside("w:tabs").isNull() & inside("m:oMath").isNull(), shown)
    rows = nodes.where(of.isNotNull() & inside("mc:Choice").isNull()).withColumn("_p", of)
    holders = [F.when(inside(h) > F.col("_p"), F.struct(inside(h).alias("id"), F.lit(i + 1).alias("place"))) for i, h in enumerate(HOLDERS)]
    outer = F.coalesce(F.least(*holders)["place"], F.lit(0))  # the outermost holder inside the paragraph
    rows = rows.select("doc_id", "part_path", "_p", outer.alias("place"), "node_id", F.when(F.col("name") == "m:oMath", F.lit("")).when(F.col("node_id") == F.col("_p"), F.lit("")).otherwise(shown).alias("text"), (F.col("name") == "m:oMath").alias("formula"))
    math = formula_texts(nodes).select("doc_id", "part_path", F.col("formula_id").alias("node_id"), F.col("text").alias("_math"))
    rows = rows.where("text IS NOT NULL").join(math, ["doc_id", "part_path", "node_id"], "left").withColumn("text", F.when(F.col("formula"), F.coalesce("_math", F.lit(""))).otherwise(F.col("text")))
    rows = rows.withColumn("key", F.struct("place", "node_id"))
    return rows.groupBy("doc_id", "part_path", F.col("_p").alias("node_id")).agg(_joined("key").alias("text"))


def formula_text(math: Node) -> str:
    """What an m:oMath reads as, see `formula_texts`; empty where nothing is seen."""
    out: list[str] = []
    stack: list[tuple[Node, str]] = [(math, "sequence")]
    while stack:
        node, mode = stack.pop()
        if node.kind != "element":
            if node.kind == "text" and node.up.name == "m:t":
                out.append(node.text)
            continue
        kids = [x for x in node.children if x.name not in ("mc:Choice", "m:oMath")]
        if mode not in ARGUMENTS:
            stack += [(x, x.name if mode == "sequence" and x.name in ARGUMENTS else "text") for x in reversed(kids)]
            continue
        said = [(y.name, next((v for name in ("m:val", "w:val") for a, v, _ in y.attrs if a == name), None)) for x in kids for y in x.children if y.name in ("m:chr", "m:degHide")]
        hides = any(name == "m:degHide" and (value is None or value in ("1", "true", "on")) for name, value in said)
        if mode == "m:nary":
            sign = max((value for name, value in said if name == "m:chr" and value is not None), default=None)
            out.append(sign if sign in SIGNS else SIGNS[0])
        for name in reversed(ARGUMENTS[mode]):
            first = next((x for x in kids if x.name == name), None)
            if first is not None and not (name == "m:deg" and hides):
                stack.append((first, "sequence"))
    return "".join(out)


_SHOWN = {"w:tab": "\t", "w:br": "\n", "w:cr": "\n", "w:noBreakHyphen": "\u2011"}
_MATTERS = frozenset(("w:p", "w:t", "w:tabs", "m:oMath", "mc:Choice", *HOLDERS, *_SHOWN))


def part_texts(tops: list[Node]) -> Iterator[tuple[Node, str]]:
    """What each paragraph of a part reads as, see `display_texts`, in the document's order."""
    found: list[tuple[Node, list[tuple[int, str]]]] = []
    # around a node: its paragraph's texts with their places; whether it is in a w:t, w:tabs or formula; the innermost holders of each kind in the paragraph; the place that these give
    none = (-1,) * len(HOLDERS)
    outside = (None, False, False, False, none, 0)
    stack = [(top, outside) for top in reversed(tops)]
    count = 0
    while stack:
        node, around = stack.pop()
        name = node.name
        if name is None:
            texts, in_text, in_tabs, in_math, _, place = around
            if in_text and texts is not None and node.kind == "text" and not in_tabs and not in_math:
                texts.append((place, node.text))
            continue
        if name in _MATTERS:
            if name == "mc:Choice":
                continue
            texts, in_text, in_tabs, in_math, holders, place = around
            if name == "w:p":
                texts, holders, place = [], none, 0
                found.append((node, texts))
            elif name in HOLDERS:
                k, count = HOLDERS.index(name), count + 1
                holders = (*holders[:k], count, *holders[k + 1 :])
                place = min((at, k + 1) for k, at in enumerate(holders) if at >= 0)[1]
            elif name == "m:oMath":
                if texts is not None:
                    texts.append((place, formula_text(node)))
                in_math = True
            elif name == "w:t":
                in_text = True
            elif name == "w:tabs":
                in_tabs = True
            elif texts is not None and not in_tabs and not in_math:
                texts.append((place, _SHOWN[name]))
            around = (texts, in_text, in_tabs, in_math, holders, place)
        for x in reversed(node.children):
            stack.append((x, around))
    for node, texts in found:
        yield node, "".join([text for _, text in sorted(texts, key=lambda x: x[0])])


def texts_of_parts(parts: DataFrame) -> DataFrame:
    """(doc_id, part_path, ord, text): `display_texts` of the paragraphs of parts (doc_id, part_path, content), numbered in each part from 0. A part is read in one go, and no node of it becomes a row."""
    kinds = pa.schema([("doc_id", pa.string()), ("part_path", pa.string()), ("ord", pa.int64()), ("text", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with rarely_collected():
            for batch in batches:
                for doc, part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    document = Document(doc)
                    document.parse(part, data, False)
                    texts = [text for _, text in part_texts(document.tops[part])]
                    document.drop()
                    if not texts:
                        continue
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(doc, pa.string()), len(texts)), pa.repeat(pa.scalar(part, pa.string()), len(texts)), pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], schema=kinds)

    return parts.where(F.col("part_path").rlike(r"\.(xml|rels)$")).select("doc_id", "part_path", "content").mapInArrow(read, "doc_id string, part_path string, ord long, text string")
