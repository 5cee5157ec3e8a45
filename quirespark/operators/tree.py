"""Edits of XML trees as set operations: remove, unwrap, wrap, move, insert, attributes, properties; and trees to part bytes.

A tree row is (doc_id, part_path, path, kind, name, attrs, text), as the node table of `sources.packages` has them. A
path holds the places of a node and its ancestors among their siblings; paths sort in document order, and a node's
subtree is what begins with its path. Places are numbers with fractions, so a new sibling goes between two others and
no other row changes; where a gap is too small to be halved on, the siblings get whole numbers anew (`roomy`). Edits name their nodes by (doc_id, part_path, path) and work on any number of documents at once;
what names no node changes nothing. An edit that reads its tree more than once writes it first (to the shared folder),
so that a chain of edits computes each step once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.packages import ATTRIBUTES, PREFIXES, _xml_rows
from ..sources.scratch import stored
from .sequence import later, sequence_of
from .text import escape_xml

KEY = ["doc_id", "part_path"]
TREE = [*KEY, "path", "kind", "name", "attrs", "text"]
DECLARATION = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
WHERE = ("before", "after", "first", "last")
MARK = "\x01"  # where a root's declarations come
REFUSED = "\x00"  # begins a fragment that is a message: why there can't be one


def tree_of(nodes: DataFrame) -> DataFrame:
    """Tree rows of the node table; names are those under the usual prefixes, see `part_bytes`. A table of these columns alone is taken as it is, and not written again."""
    return nodes if nodes.columns == TREE else nodes.select(*TREE)


def _prefixes(tree: DataFrame, name: str = "_up") -> DataFrame:
    """Each row once for itself and each of its ancestors, with the path of that in `name`. Many times the rows of the tree: joins with it sort and merge, see `stored`."""
    return tree.withColumn(name, F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k)))).hint("merge")


def _named(targets: DataFrame, *more: str) -> DataFrame:
    """Targets under names of their own, for joins with a tree by `_is`: these sort and merge, as targets may be as many as its rows."""
    return targets.select(F.col("doc_id").alias("_d"), F.col("part_path").alias("_part"), F.col("path").alias("_at"), *more).hint("merge")


def _is(path: str = "path") -> list[Column]:
    return [F.col("doc_id") == F.col("_d"), F.col("part_path") == F.col("_part"), F.col(path) == F.col("_at")]


def _held(tree: DataFrame, targets: DataFrame, *more: str) -> DataFrame:
    """Rows with `_at`, the path of the outermost of the targets that they stand in or are, and `more` columns of that target; null where there is none.

    One pass over each part in document order: of the ends of all targets that have begun the greatest is that of the
    outermost one that is still open, if any is.
    """
    begun = targets.select(*KEY, "path", F.struct(F.concat("path", F.array(F.lit(float("inf")))).alias("end"), *more).alias("_begun"))
    order = Window.partitionBy(*KEY).orderBy("path", F.col("_begun").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = tree.withColumn("_begun", F.lit(None).cast(begun.schema["_begun"].dataType)).unionByName(begun, allowMissingColumns=True).withColumn("_open", F.max("_begun").over(order)).where("_begun IS NULL")
    here = F.col("_open.end") > F.col("path")
    return rows.select(*tree.columns, F.when(here, F.slice("_open.end", 1, F.size("_open.end") - 1)).alias("_at"), *(F.when(here, F.col(f"_open.{c}")).alias(c) for c in more))


def subtrees(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows of the targets and of all that stands in them."""
    return _held(tree, targets).where("_at IS NOT NULL").drop("_at")


def remove(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """Without the targets and all that stands in them."""
    return _held(stored(tree, "tree"), targets).where("_at IS NULL").drop("_at")


def unwrap(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """Without the target elements themselves; what stood in them stays at its place."""
    return tree.join(_named(targets).distinct(), _is(), "left_anti")


def _repathed(tree: DataFrame, moves: DataFrame) -> DataFrame:
    """Rows in a subtree `path` of moves(doc_id, part_path, path, new_path) get new_path for the beginning of theirs. Targets must not stand in each other."""
    rows = _held(stored(tree, "tree"), moves.withColumnRenamed("new_path", "_new"), "_new")
    return rows.withColumn("path", F.when(F.col("_at").isNull(), F.col("path")).otherwise(F.concat("_new", F.slice("path", F.size("_at") + 1, F.greatest(F.size("path") - F.size("_at"), F.lit(0)))))).select(*TREE)


#: The least gap between siblings that is halved once more.
LEAST_GAP = 2.0**-20


def _gaps(tree: DataFrame) -> DataFrame:
    """(_d, _part, _at, _up, _own, _before, _after) of every node: its place and those of its neighbours."""
    row = Window.partitionBy("_d", "_part", "_up").orderBy("_own")
    sides = tree.select(F.col("doc_id").alias("_d"), F.col("part_path").alias("_part"), F.col("path").alias("_at"), F.slice("path", 1, F.size("path") - 1).alias("_up"), F.element_at("path", -1).alias("_own"))
    return sides.withColumn("_before", F.lag("_own").over(row)).withColumn("_after", F.lead("_own").over(row))


def roomy(tree: DataFrame, targets: DataFrame, *paths: str) -> tuple[DataFrame, DataFrame]:
    """The tree and the targets, with whole places anew for the children of nodes where a gap has become too small; columns `paths` of the targets follow."""
    tree, targets = stored(tree, "tree"), stored(targets, "targets")  # targets are often found in a tree that isn't written yet
    if tree.where(F.element_at("path", -1) % 1 != 0).isEmpty():
        return tree, targets  # whole places are a unit apart, as those of a tree that was read
    parents = targets.select(*KEY, F.explode(F.array(*(F.slice(p, 1, F.size(p) - 1) for p in paths), *paths)).alias("_up")).distinct()
    while True:
        here = tree.withColumn("_up", F.slice("path", 1, F.size("path") - 1)).join(parents, [*KEY, "_up"], "left_semi")
        near = _gaps(here).where((F.col("_after") - F.col("_own") < LEAST_GAP) & (F.size("_up") > 0))
        if near.isEmpty():
            return tree, targets
        tight = stored(near.select(F.col("_d").alias("doc_id"), F.col("_part").alias("part_path"), "_up").distinct(), "tight")
        inner = _prefixes(tight.withColumnRenamed("_up", "path"), "_above").where(F.size("_above") < F.size("path"))
        outer = tight.join(inner.join(tight.withColumnRenamed("_up", "_above"), [*KEY, "_above"], "left_semi").select(*KEY, F.col("path").alias("_up")), [*KEY, "_up"], "left_anti")
        nth = (F.row_number().over(Window.partitionBy(*KEY, "_up").orderBy("path")) - 1).cast("double")
        moves = tree.select(*KEY, "path", F.slice("path", 1, F.size("path") - 1).alias("_up")).join(outer, [*KEY, "_up"], "left_semi").withColumn("new_path", F.concat("_up", F.array(nth))).drop("_up")
        moves = stored(moves, "moves")
        tree = stored(_repathed(tree, moves), "tree")
        for p in paths:
            begins = _prefixes(targets.select(*KEY, F.col(p).alias("path")).distinct())
            found = begins.join(_named(moves, F.col("new_path").alias("_new")), _is("_up")).select(*KEY, F.col("path").alias("_from"), F.concat("_new", F.slice("path", F.size("_at") + 1, F.greatest(F.size("path") - F.size("_at"), F.lit(0)))).alias("_to")).distinct()
            targets = stored(targets.withColumn("_from", F.col(p)).join(found, [*KEY, "_from"], "left").withColumn(p, F.coalesce("_to", "_from")).drop("_from", "_to"), "targets")
        parents = targets.select(*KEY, F.explode(F.array(*(F.slice(p, 1, F.size(p) - 1) for p in paths), *paths)).alias("_up")).distinct()


def placed(tree: DataFrame, edits: DataFrame, order: list[str | Column]) -> DataFrame:
    """Edits (doc_id, part_path, path, where, ...) with `new_path`: a free place beside the node `path` (where is before or after) or in it (first or last).

    It lies between the neighbours that stand there now; several edits at one place stand by `order`. A place that the
    numbers' digits no longer tell from a neighbour's is an error; `roomy` keeps that from happening.
    """
    edits = stored(edits, "edits")
    up = F.slice("path", 1, F.size("path") - 1)
    # only the lists that get something are put in order
    lists = edits.select(*KEY, F.when(F.col("where").isin("before", "after"), up).otherwise(F.col("path")).alias("_up")).distinct()
    sides = _gaps(tree.select(*KEY, "path", up.alias("_up")).join(lists, [*KEY, "_up"], "left_semi").drop("_up"))
    ends = sides.groupBy("_d", "_part", F.col("_up").alias("_at")).agg(F.min("_own").alias("_least"), F.max("_own").alias("_most"))
    beside = edits.where("where IN ('before', 'after')").join(sides.drop("_up"), _is()).drop("_d", "_part", "_at").withColumn("_least", F.lit(None).cast("double")).withColumn("_most", F.lit(None).cast("double"))
    inside = edits.where("where IS NULL OR where NOT IN ('before', 'after')").join(ends, _is(), "left").drop("_d", "_part", "_at")
    both = beside.unionByName(inside.withColumns({c: F.lit(None).cast("double") for c in ("_own", "_before", "_after")}))
    w = Window.partitionBy(*KEY, "path", "where")
    k = F.row_number().over(w.orderBy(*order)) / (F.count("*").over(w) + 1)  # between 0 and 1
    # of a gap, what comes after a node has the lower half and what comes before the next one the upper
    low = F.when(F.col("where") == "before", (F.coalesce("_before", F.col("_own") - 1) + F.col("_own")) / 2).when(F.col("where") == "after", F.col("_own")).when(F.col("where") == "first", F.coalesce("_least", F.lit(0.0)) - 1).when(F.col("where") == "last", F.coalesce("_most", F.lit(0.0)))
    high = F.when(F.col("where") == "before", F.col("_own")).when(F.col("where") == "after", (F.col("_own") + F.coalesce("_after", F.col("_own") + 1)) / 2).when(F.col("where") == "first", F.coalesce("_least", F.lit(0.0))).when(F.col("where") == "last", F.coalesce("_most", F.lit(0.0)) + 1)
    base = F.when(F.col("where").isin("before", "after"), up).otherwise(F.col("path"))
    both = both.withColumns({"_low": low, "_high": high, "_place": low + (high - low) * k})
    free = F.when((F.col("_place") > F.col("_low")) & (F.col("_place") < F.col("_high")), F.col("_place")).otherwise(F.raise_error(F.lit("no place left between two siblings")).cast("double"))
    known = F.when(F.col("where").isin(*WHERE), F.concat(base, F.array(free))).otherwise(F.raise_error(F.concat(F.lit("no such place: "), F.coalesce("where", F.lit("null")))))
    return both.withColumn("new_path", known).drop("_own", "_before", "_after", "_least", "_most", "_low", "_high", "_place")


def move(tree: DataFrame, moves: DataFrame, order: list[str | Column]) -> DataFrame:
    """Moves subtrees. moves(doc_id, part_path, path, to, where, ...): the subtree `path` comes to stand at `where` of the node `to`. A node can't be moved into itself: that is an error."""
    tree, moves = roomy(tree, moves, "path", "to")
    into = F.slice(F.col("to"), 1, F.size("path")) == F.col("path")
    checked = moves.where(F.when(into & ~((F.col("to") == F.col("path")) & F.col("where").isin("before", "after")), F.raise_error(F.lit("a node can't be moved into itself")).cast("boolean")).otherwise(True))
    spots = placed(tree, checked.withColumnRenamed("path", "_from").withColumnRenamed("to", "path"), order)
    return _repathed(tree, spots.select(*KEY, F.col("_from").alias("path"), "new_path"))


def wrap(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """Puts an element around each target: targets(doc_id, part_path, path, name, attrs)."""
    tree = stored(tree, "tree")
    new = targets.select(*KEY, "path", F.lit("element").alias("kind"), "name", F.col("attrs").cast(ATTRIBUTES).alias("attrs"), F.lit(None).cast("string").alias("text"))
    moves = targets.select(*KEY, "path", F.concat("path", F.array(F.lit(0.0))).alias("new_path"))
    known = new.join(tree.select(*KEY, "path"), [*KEY, "path"], "left_semi")
    return _repathed(tree, moves).unionByName(known.select(*TREE))


def attribute_list(**values: str | Column | None) -> Column:
    """An attribute array for rows made here; names are written with _ for the colon (w_val), and nulls are left out."""
    items = [F.struct(F.lit(k.replace("_", ":", 1)).alias("name"), (v if isinstance(v, Column) else F.lit(v)).cast("string").alias("value"), F.lit(k.replace("_", ":", 1)).alias("raw")) for k, v in values.items()]
    return F.filter(F.array(*items), lambda x: x["value"].isNotNull()) if items else F.array().cast(ATTRIBUTES)


def set_attributes(tree: DataFrame, changes: DataFrame) -> DataFrame:
    """Sets or, where the value is null, removes attributes: changes(doc_id, part_path, path, name, value). Of several changes of one attribute the last by `seq` counts, where there is such a column, else the largest value."""
    last = F.max_by("value", "seq") if "seq" in changes.columns else F.max("value")
    lists = changes.groupBy(*KEY, "path", "name").agg(last.alias("value")).groupBy(*KEY, "path").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("_set"))
    joined = tree.join(_named(lists, "_set"), _is(), "left")
    there = lambda x: F.exists("_set", lambda y: y["name"] == x["name"])
    new_value = lambda x: F.filter("_set", lambda y: y["name"] == x["name"])[0]["value"]
    kept = F.transform("attrs", lambda x: F.struct(x["name"].alias("name"), F.when(there(x), new_value(x)).otherwise(x["value"]).alias("value"), x["raw"].alias("raw")))
    had = lambda y: F.exists("attrs", lambda x: x["name"] == y["name"])
    added = F.transform(F.filter("_set", lambda y: ~had(y)), lambda y: F.struct(y["name"].alias("name"), y["value"].alias("value"), y["name"].alias("raw")))
    attrs = F.when(F.col("_set").isNull(), F.col("attrs")).otherwise(F.filter(F.concat(kept, added), lambda x: x["value"].isNotNull()))
    return joined.select(*(attrs.alias("attrs") if c == "attrs" else c for c in TREE))


def fragments(edits: DataFrame) -> DataFrame:
    """Tree rows of edits(doc_id, part_path, new_path, xml), the fragment's element standing at new_path. Usual prefixes need no declaration."""
    # of the prefixes that stand for several namespaces the first is declared
    usual = {p: uri for uri, p in reversed(PREFIXES.items()) if p}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = "<f " + " ".join(f'xmlns:{p}="{uri}"' for p, uri in usual.items()) + ">"
        kinds = [pa.string(), pa.string(), pa.list_(pa.float64()), pa.string(), pa.string(), pa.list_(pa.struct([("name", pa.string()), ("value", pa.string()), ("raw", pa.string())])), pa.string()]
        for batch in batches:
            out: list[tuple] = []
            for doc, part, at, xml in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if xml.startswith(REFUSED):
                    raise ValueError(f"{part} of {doc}: {xml[1:]}")
                rows = _xml_rows(doc, part, f"{open_}{xml}</f>".encode())[1:]
                if sum(len(r[16]) == 2 for r in rows) != 1:
                    raise ValueError(f"a fragment for {part} of {doc} must be one element")
                out += [(doc, part, [*at, *r[16][2:]], r[6], r[7], r[8], r[9]) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], TREE)

    return edits.select(*KEY, "new_path", "xml").mapInArrow(parse, f"doc_id string, part_path string, path array<double>, kind string, name string, attrs {ATTRIBUTES}, text string")


def insert(tree: DataFrame, edits: DataFrame, order: list[str | Column]) -> DataFrame:
    """Inserts fragments: edits(doc_id, part_path, path, where, xml, ...), several at one place by `order`. Edits that name no node are left out. What comes last in a body stands before its section."""
    tree, edits = roomy(tree, edits, "path")
    known = edits.join(tree.select(*KEY, "path"), [*KEY, "path"], "left_semi")
    up = F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))
    sections = tree.where("name = 'w:sectPr'").select(*KEY, F.col("path").alias("_section"), up.alias("path")).join(tree.where("name = 'w:body'").select(*KEY, "path"), [*KEY, "path"], "left_semi")
    known = known.join(sections.groupBy(*KEY, "path").agg(F.max("_section").alias("_section")), [*KEY, "path"], "left")
    before = (F.col("where") == "last") & F.col("_section").isNotNull()
    known = known.withColumn("path", F.when(before, F.col("_section")).otherwise(F.col("path"))).withColumn("where", F.when(before, "before").otherwise(F.col("where"))).drop("_section")
    return tree.unionByName(fragments(placed(tree, known, order)))


def set_text(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """Replaces all that stands in the target elements by a text: targets(doc_id, part_path, path, text)."""
    rows = _held(stored(tree, "tree"), targets.withColumnRenamed("text", "_text"), "_text").where("_at IS NULL OR path = _at")
    rows = rows.withColumn("_new", F.explode(F.when(F.col("_at").isNull(), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    new = {"path": F.concat("path", F.array(F.lit(0.0))), "kind": F.lit("text"), "name": F.lit(None).cast("string"), "attrs": F.array().cast(ATTRIBUTES), "text": F.col("_text")}
    return rows.select(*KEY, *(F.when(F.col("_new"), v).otherwise(F.col(c)).alias(c) for c, v in new.items()))


def children(tree: DataFrame, parents: DataFrame, name: str) -> DataFrame:
    """(doc_id, part_path, path, parent) of the parents' own children of that name."""
    up = tree.where(F.col("name") == name).select(*KEY, "path", F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))).alias("parent"))
    return up.join(_named(parents).distinct(), _is("parent"), "left_semi")


def _in_sequence(tree: DataFrame, targets: DataFrame, holder: str | None, name: str) -> DataFrame:
    """Targets (doc_id, part_path, path, ...) as edits for `placed`: a child `name` comes before the first child that the format has behind it, or last. Its own path is in `parent` afterwards."""
    if holder is None:
        return targets.withColumn("parent", F.col("path")).withColumn("where", F.lit("last"))
    up = F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))
    behind = tree.where(later(holder, name)).select(*KEY, "path", up.alias("_up")).join(targets.select(*KEY, F.col("path").alias("_up")), [*KEY, "_up"], "left_semi")
    first = behind.groupBy(*KEY, "_up").agg(F.min("path").alias("_next")).withColumnRenamed("_up", "path")
    out = targets.join(first, [*KEY, "path"], "left").withColumn("parent", F.col("path"))
    return out.withColumn("where", F.when(F.col("_next").isNull(), "last").otherwise("before")).withColumn("path", F.coalesce("_next", "path")).drop("_next")


def _replaced(tree: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """The tree without the subtrees `old` and with the rows `new`, which may stand at their places: one pass, after which the rows of a part are together."""
    rows = tree.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    return _held(rows, old).where("_at IS NULL OR _new").select(*TREE)


def set_child(tree: DataFrame, changes: DataFrame, holder: str | None, name: str, owner: str | None = None, known: bool = False) -> DataFrame:
    """Gives each target an element `name` in its `holder` child (made where there is none; None: in the target itself), in place of what it has of that name.

    changes(doc_id, part_path, path, xml): xml is the new element, null takes the old one away. One change a target.
    Where there was none, the element stands where the format's sequence has it (see `sequence`); owner is the targets'
    element name, needed for that where there is no holder, and for the holder's own place. known: all targets are there.
    """
    tree, changes = roomy(tree, changes, "path")
    if not known:
        changes = changes.join(tree.select(*KEY, "path"), [*KEY, "path"], "left_semi")
    if holder is not None:
        have = children(tree, changes, holder).select(*KEY, F.col("parent").alias("path"))
        missing = stored(changes.where("xml IS NOT NULL").join(have, [*KEY, "path"], "left_anti").select(*KEY, "path"), "missing")
        if not missing.isEmpty():  # most trees have them all; else the tree is gone through for their places
            if owner is None or holder not in sequence_of(owner):
                edits = missing.withColumn("where", F.lit("first"))
            else:
                edits = _in_sequence(tree, missing, owner, holder)
            spots = placed(tree, edits, ["path"])
            made = spots.select(*KEY, F.col("new_path").alias("path"), F.lit("element").alias("kind"), F.lit(holder).alias("name"), F.array().cast(ATTRIBUTES).alias("attrs"), F.lit(None).cast("string").alias("text"))
            tree = stored(tree.unionByName(made), "tree")
        spots = children(tree, changes, holder)
        changes = stored(spots.join(changes.withColumnRenamed("path", "parent"), [*KEY, "parent"]).drop("parent"), "changes")
    old = stored(children(tree, changes, name), "old")
    slot = old.groupBy(*KEY, F.col("parent").alias("path")).agg(F.min("path").alias("_slot"))
    fresh = stored(changes.where("xml IS NOT NULL").join(slot, [*KEY, "path"], "left"), "fresh")
    comes = fresh.where("_slot IS NOT NULL").select(*KEY, F.col("_slot").alias("new_path"), "xml")
    lacking = fresh.where("_slot IS NULL").drop("_slot")
    if not lacking.isEmpty():
        comes = comes.unionByName(placed(tree, _in_sequence(tree, lacking, holder or owner, name), ["parent"]).select(*KEY, "new_path", "xml"))
    return _replaced(tree, old, fragments(comes))


#: Usual prefixes and the first of the namespaces that each stands for.
USUAL = {p: uri for uri, p in reversed(PREFIXES.items()) if p}


def _prefixes_in() -> Column:
    """The prefixes in the names of a row and its attributes."""
    prefix = lambda c: F.when(F.contains(c, F.lit(":")), F.substring_index(c, ":", 1))
    return F.array_distinct(F.concat(F.array(prefix(F.col("name"))), F.transform("attrs", lambda x: prefix(x["name"]))))


def used_prefixes(tree: DataFrame) -> DataFrame:
    """(doc_id, part_path, used): the usual prefixes in the names of elements and attributes."""
    used = tree.where("kind = 'element'").select(*KEY, F.explode(_prefixes_in()).alias("_prefix"))
    return used.where(F.col("_prefix").isin(*USUAL)).groupBy(*KEY).agg(F.array_sort(F.collect_set("_prefix")).alias("used"))


def pieces_of(tree: DataFrame, all_declarations: bool = False) -> DataFrame:
    """(doc_id, part_path, p struct<path,s>): the text of each node, one or two pieces: the start tag or text at its path, and the end tag behind all that begins with its path.

    Names are written under the usual prefixes; a root declares those that are in use, and keeps its other declarations
    (all_declarations: also those of known namespaces under other prefixes).
    """
    tree = stored(tree, "tree")
    root = F.size("path") == 1
    declared = used_prefixes(tree).withColumnRenamed("used", "_used")
    # only roots, one a part, need them
    tags = tree.where(root).join(declared.hint("merge"), KEY, "left").unionByName(tree.where(~root).withColumn("_used", F.lit(None).cast("array<string>")))
    own = _own_attributes(all_declarations)
    return tags.select(*KEY, F.explode(_pieces(_declarations(F.col("_used"), F.transform(own, lambda x: x["name"])), own)).alias("p"))


def _own_attributes(all_declarations: bool = False) -> Column:
    """A row's attributes as they are written: a declaration of a known namespace under another prefix goes; one of an unknown namespace stays, also under a usual prefix."""
    known = [u for u, p in PREFIXES.items() if p]
    return F.col("attrs") if all_declarations else F.filter("attrs", lambda x: ~(x["name"].startswith("xmlns") & x["name"].rlike("^xmlns(:|$)") & x["value"].isin(*known)))


def _declarations(used: Column, names: Column) -> Column:
    """The declarations of the prefixes in use that are not among a root's own attributes, as text."""
    uri = F.create_map(*(F.lit(x) for pair in USUAL.items() for x in pair))
    none = F.array().cast("array<string>")
    lacking = F.filter(F.coalesce(used, none), lambda p: ~F.array_contains(F.coalesce(names, none), F.concat(F.lit("xmlns:"), p)))
    return F.array_join(F.transform(lacking, lambda p: F.concat(F.lit(" xmlns:"), p, F.lit('="'), F.element_at(uri, p), F.lit('"'))), "")


def _pieces(declared: Column, own: Column) -> Column:
    """The pieces of a row with these attributes, see `pieces_of`; a root has `declared` behind its name."""
    quoted = lambda v: F.replace(F.replace(F.replace(escape_xml(v), F.lit("\n"), F.lit("&#10;")), F.lit("\t"), F.lit("&#9;")), F.lit("\r"), F.lit("&#13;"))
    written = F.array_join(F.transform(own, lambda x: F.concat(F.lit(" "), x["name"], F.lit('="'), quoted(x["value"]), F.lit('"'))), "")
    written = F.concat(F.when(F.size("path") == 1, declared).otherwise(""), written)
    plain = F.replace(F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("\r"), F.lit("&#13;"))
    piece = lambda path, s: F.struct(path.alias("path"), s.alias("s"))
    end = F.concat("path", F.array(F.lit(float("inf"))))
    return (
        F.when(F.col("kind") == "element", F.array(piece(F.col("path"), F.concat(F.lit("<"), F.col("name"), written, F.lit(">"))), piece(end, F.concat(F.lit("</"), F.col("name"), F.lit(">")))))
        .when(F.col("kind") == "text", F.array(piece(F.col("path"), plain)))
        .when(F.col("kind") == "comment", F.array(piece(F.col("path"), F.concat(F.lit("<!--"), F.col("text"), F.lit("-->")))))
        .otherwise(F.array(piece(F.col("path"), F.concat(F.lit("<?"), F.col("name"), F.lit(" "), F.coalesce("text", F.lit("")), F.lit("?>")))))
    )


def short(x: Column, i: Column) -> Column:
    """The text of the i-th piece of an array `p` (see `pieces_of`); an element that holds nothing is one tag."""
    end = lambda path: F.concat(path, F.array(F.lit(float("inf"))))
    holds_nothing = F.coalesce(F.get("p", i + 1)["path"] == end(x["path"]), F.lit(False))
    is_its_end = F.coalesce(x["path"] == end(F.get("p", i - 1)["path"]), F.lit(False))
    return F.when(holds_nothing, F.concat(F.substring(x["s"], F.lit(1), F.length(x["s"]) - 1), F.lit("/>"))).when(is_its_end, "").otherwise(x["s"])


def part_bytes(tree: DataFrame) -> DataFrame:
    """(doc_id, part_path, content) of the trees: well-formed UTF-8 XML with a declaration. A part is its pieces in order (see `pieces_of`), gathered in one group, as large as the part.

    The tree is read once: what a root declares is gathered along with the pieces, and comes into its tag at a mark, which is no character of XML.
    """
    own, element = _own_attributes(), F.col("kind") == "element"
    rows = tree.select(*KEY, _pieces(F.lit(MARK), own).alias("_pieces"), F.when(element, _prefixes_in()).alias("_used"), F.when(element & (F.size("path") == 1), F.transform(own, lambda x: x["name"])).alias("_names"))
    # the rows of a part are one group, and all pieces of them in order
    parts = rows.groupBy(*KEY).agg(F.array_sort(F.flatten(F.collect_list("_pieces"))).alias("p"), F.flatten(F.collect_set("_used")).alias("_used"), F.first("_names", ignorenulls=True).alias("_names"))
    used = F.array_sort(F.array_distinct(F.filter("_used", lambda p: p.isin(*USUAL))))
    parts = parts.select(*KEY, "p", _declarations(used, F.col("_names")).alias("_declared"))
    # texts are escaped, so an end tag right behind a start tag is told by how they begin
    begins = lambda s: s.startswith("<") & ~F.substring(s, 2, 1).isin("/", "!", "?")
    next_ends = lambda i: F.coalesce(F.get("p", i + 1)["s"].startswith("</"), F.lit(False))
    own_end = lambda s, i: s.startswith("</") & F.coalesce(begins(F.get("p", i - 1)["s"]), F.lit(False))
    tag = lambda s, i: F.when(own_end(s, i), "").when(begins(s) & next_ends(i), F.concat(F.substring(s, F.lit(1), F.length(s) - 1), F.lit("/>"))).otherwise(s)
    text = lambda x, i: F.when(F.size(x["path"]) == 1, F.regexp_replace(tag(x["s"], i), F.lit(f"^(<[^{MARK}]*){MARK}"), F.concat(F.lit("$1"), "_declared"))).otherwise(tag(x["s"], i))
    return parts.select(*KEY, F.encode(F.concat(F.lit(DECLARATION), F.array_join(F.transform("p", text), "")), "UTF-8").alias("content"))


def edited_parts(parts: DataFrame, tree: DataFrame) -> DataFrame:
    """The parts of packages with those of `tree` written anew (and new ones added); all others stay byte for byte."""
    new = part_bytes(stored(tree, "tree"))
    return parts.select(*KEY, "content").join(new.select(*KEY), KEY, "left_anti").unionByName(new)


def element(name: str, content: Column | str | None = None, /, **attrs: str | Column | None) -> Column:
    """XML text of an element: attributes as in attribute_list (escaped here), content as it is."""
    if not re.fullmatch(r"[A-Za-z_][\w.-]*(:[A-Za-z_][\w.-]*)?", name):
        raise ValueError(f"no such name: {name}")
    out = [F.lit(f"<{name}")]
    for k, v in attrs.items():
        value = (v if isinstance(v, Column) else F.lit(v)).cast("string")
        out.append(F.coalesce(F.concat(F.lit(f' {k.replace("_", ":", 1)}="'), escape_xml(value), F.lit('"')), F.lit("")))
    inner = F.lit("") if content is None else content if isinstance(content, Column) else F.lit(content)
    return F.concat(*out, F.lit(">"), inner, F.lit(f"</{name}>"))
