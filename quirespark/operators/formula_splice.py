"""Formulas brought from one document into another, and text replaced beside formulas without touching them.

A formula is carried by a run that holds it, or stands in its paragraph itself; either is copied with all that is in it.
Copies are rows of the tree under new paths, so any number of them between any documents is one job. Of packages that are
read and written (`splice_parts`) a task holds one part: formulas go from the parts they are in to those they come into.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import inline as I
from . import tree as T
from .documents import Document, Node, as_written, in_turn, rarely_collected, written
from .formulas import formula_texts
from .tree import KEY, TREE

#: The properties of a run that are kept with a formula under "formula".
KEPT = ("w:rFonts", "w:sz", "w:szCs", "w:b", "w:bCs", "w:i", "w:iCs")
CONTEXT = 10
_SOURCE = ["source_doc", "source_part", "source_path"]


def _up(n: int = 1, path: str = "path") -> Column:
    return F.slice(path, 1, F.greatest(F.size(path) - n, F.lit(0)))


def carriers(tree: DataFrame) -> DataFrame:
    """(doc_id, part_path, path, index, carrier, in_run): the formulas of paragraphs, path being the paragraph's, index counting from 0 in their order; carrier is the run or the m:oMath or m:oMathPara itself."""
    math = tree.where("name IN ('m:oMath', 'm:oMathPara')").select(*KEY, "path", _up().alias("_up"))
    here = tree.where("name IN ('w:p', 'w:r')").select(*KEY, F.col("path").alias("_up"), "name")
    found = math.join(here, [*KEY, "_up"])  # an m:oMath in an m:oMathPara stands in neither
    found = found.select(*KEY, F.when(F.col("name") == "w:r", _up(1, "_up")).otherwise(F.col("_up")).alias("_p"), F.when(F.col("name") == "w:r", F.col("_up")).otherwise(F.col("path")).alias("carrier"), (F.col("name") == "w:r").alias("in_run")).distinct()
    paragraphs = tree.where("name = 'w:p'").select(*KEY, F.col("path").alias("_p"))
    index = F.row_number().over(Window.partitionBy(*KEY, "_p").orderBy("carrier")) - 1
    return found.join(paragraphs, [*KEY, "_p"], "left_semi").select(*KEY, F.col("_p").alias("path"), index.alias("index"), "carrier", "in_run")


def _carried(tree: DataFrame, carriers: DataFrame) -> DataFrame:
    """The rows of the tree once for each carrier (doc_id, part_path, path, in_run) that they stand in or are, its path in `_up`. A pass takes the outermost carriers, the next one those that stand in these (in text boxes)."""
    left, out = stored(carriers.distinct(), "carriers"), None
    while True:
        rows = T._held(tree, left, "in_run").where("_at IS NOT NULL").withColumnRenamed("_at", "_up")
        out = rows if out is None else out.unionByName(rows)
        left = stored(T._held(left, left).where("_at <> path").drop("_at"), "carriers")
        if left.isEmpty():
            return out


def splice(tree: DataFrame, splices: DataFrame, properties: str = "all") -> DataFrame:
    """The tree with copies of formulas.

    splices(id, doc_id, part_path, path, source_doc, source_part, source_path, index, where, anchor, instance): formula
    `index` of the source paragraph comes to stand in the paragraph `path`, at its start (behind its properties) or end, or before or after the
    instance-th place (from 1, overlapping ones count) where `anchor` stands in the text of its own runs, which are split there. Several at
    one place stand by id, which tells the splices of a paragraph apart. properties of a formula's run: all, formula (KEPT) or none. A target that is no paragraph, a
    source without formulas, an index or an anchor that isn't there: each is an error.
    """
    if properties not in ("all", "formula", "none"):
        raise ValueError(f"no such properties: {properties}")
    tree, splices = stored(T.tree_of(tree), "tree"), stored(splices, "splices")
    known = carriers(tree).select(F.col("doc_id").alias("source_doc"), F.col("part_path").alias("source_part"), F.col("path").alias("source_path"), "index", "carrier", "in_run")
    counts = known.groupBy(*_SOURCE).agg(F.count("*").alias("_n"))
    targets = tree.where("name = 'w:p'").select(*KEY, "path", F.lit(True).alias("_there"))
    rows = splices.join(known, [*_SOURCE, "index"], "left").join(counts, _SOURCE, "left").join(targets, [*KEY, "path"], "left")
    flat = I.pieces(tree).groupBy(*KEY, F.col("surface").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), "").alias("_flat"))
    rows = rows.join(flat, [*KEY, "path"], "left")
    by_text = F.col("where").isin("before", "after")
    hit = F.aggregate(F.sequence(F.lit(1), F.greatest(F.coalesce("instance", F.lit(1)), F.lit(1))), F.lit(0), lambda at, k: F.when((k > 1) & (at == 0), 0).otherwise(F.call_function("locate", F.col("anchor"), F.coalesce("_flat", F.lit("")), at + 1)))
    rows = rows.withColumn("_hit", F.when(by_text & (F.length("anchor") > 0) & (F.coalesce("instance", F.lit(1)) >= 1), hit))
    fail = (
        F.when(F.col("_there").isNull(), "the target is no paragraph").when(F.col("_n").isNull(), "the source has no formula").when(F.col("carrier").isNull(), F.concat(F.lit("no formula "), F.col("index").cast("string")))
        .when(~F.col("where").isin("start", "end", "before", "after") | F.col("where").isNull(), "no such place").when(by_text & (F.coalesce("_hit", F.lit(0)) == 0), F.concat(F.lit("not found: "), F.coalesce("anchor", F.lit("null"))))
    )
    rows = stored(rows.where(F.when(fail.isNotNull(), F.raise_error(fail).cast("boolean")).otherwise(True)), "splices")

    # what is copied, before runs of the targets are split
    content = _carried(tree, rows.select(F.col("source_doc").alias("doc_id"), F.col("source_part").alias("part_path"), F.col("carrier").alias("path"), "in_run"))
    tail = F.slice("path", F.size("_up") + 1, F.greatest(F.size("path") - F.size("_up"), F.lit(0)))
    content = content.select(F.col("doc_id").alias("source_doc"), F.col("part_path").alias("source_part"), F.col("_up").alias("carrier"), tail.alias("tail"), "in_run", "kind", "name", "attrs", "text")
    if properties != "all":
        heads = content.where("in_run AND name = 'w:rPr' AND size(tail) = 1").select("source_doc", "source_part", "carrier", F.col("tail").alias("_head"))
        kept = content.where(F.size("tail") == 2).where(F.col("name").isin(*KEPT) if properties == "formula" else F.lit(False)).select("source_doc", "source_part", "carrier", F.col("tail").alias("_kept"))
        held = content.join(heads, ["source_doc", "source_part", "carrier"], "left").withColumn("_kept", F.slice("tail", 1, 2)).join(kept.withColumn("_ok", F.lit(True)), ["source_doc", "source_part", "carrier", "_kept"], "left")
        inside = F.coalesce(F.slice("tail", 1, 1) == F.col("_head"), F.lit(False))
        content = held.where(~inside | (F.lit(properties == "formula") & ((F.size("tail") == 1) | F.coalesce("_ok", F.lit(False))))).drop("_head", "_kept", "_ok")
    content = stored(content, "copied")

    at = F.when(F.col("where") == "before", F.col("_hit") - 1).otherwise(F.col("_hit") - 1 + F.length("anchor")).cast("int")
    anchored = rows.where(by_text).select(*KEY, F.col("path").alias("surface"), at.alias("start"), at.alias("end")).distinct()
    tree = I._cut(tree, anchored)
    spans = I.pieces(tree).groupBy(*KEY, F.col("surface").alias("path"), "run").agg(F.min("start").alias("_a"), F.max(F.col("start") + F.length("text")).alias("_b"))
    near = rows.where(by_text).withColumn("_at", at).join(spans, [*KEY, "path"])
    near = near.groupBy("id", *KEY, "path", "where").agg(F.max(F.when(F.col("_b") <= F.col("_at"), F.col("run"))).alias("_behind"), F.min(F.when(F.col("_a") >= F.col("_at"), F.col("run"))).alias("_next"))
    beside = near.select("id", *KEY, "path", F.when((F.col("where") == "after") | F.col("_next").isNull(), F.col("_behind")).otherwise(F.col("_next")).alias("_to"), F.when((F.col("where") == "after") | F.col("_next").isNull(), "after").otherwise("before").alias("_where"))
    heads = tree.where("name = 'w:pPr'").select(*KEY, _up().alias("path"), F.col("path").alias("_head"))
    edits = rows.join(beside, ["id", *KEY, "path"], "left").join(heads, [*KEY, "path"], "left")
    start = F.col("where") == "start"
    edits = edits.select(
        "id", *KEY, F.coalesce("_to", F.when(start, F.col("_head")), "path").alias("path"), F.coalesce("_where", F.when(start & F.col("_head").isNotNull(), "after"), F.when(start, "first"), F.lit("last")).alias("where"),
        "source_doc", "source_part", "carrier",
    )
    tree, edits = T.roomy(tree, edits, "path")
    spots = T.placed(tree, edits, ["id"]).select(*KEY, "new_path", "source_doc", "source_part", "carrier")
    new = content.join(spots, ["source_doc", "source_part", "carrier"]).select(*KEY, F.concat("new_path", "tail").alias("path"), "kind", "name", "attrs", "text")
    return tree.unionByName(new)


_MATH = ("m:oMath", "m:oMathPara")
_XML = r"\.(xml|rels)$"


def _carriers_in(paragraph: Node) -> list[Node]:
    """`carriers` of one paragraph."""
    return [x for x in paragraph.children if x.name in _MATH or (x.name == "w:r" and any(y.name in _MATH for y in x.children))]


def paragraphs(parts: DataFrame) -> DataFrame:
    """(doc_id, part_path, path, ord, formulas): the paragraphs of parts (doc_id, part_path, content), numbered in each part from 0, and how many formulas each has."""
    kinds = pa.schema([("doc_id", pa.string()), ("part_path", pa.string()), ("path", pa.list_(pa.float64())), ("ord", pa.int64()), ("formulas", pa.int32())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with rarely_collected():
            for batch in batches:
                for doc, part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    document = Document(doc)
                    document.parse(part, data, False)
                    rows = [(doc, part, n.path, k, len(_carriers_in(n))) for k, n in enumerate(n for n in document.nodes[part] if n.name == "w:p")]
                    document.drop()
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return parts.where(F.col("part_path").rlike(_XML)).select(*KEY, "content").mapInArrow(read, "doc_id string, part_path string, path array<double>, ord long, formulas int")


def _packed(carrier: Node, properties: str) -> tuple[str, list[str]]:
    """A formula as it is written, with the prefixes in use; of a run's properties what is to be kept."""
    if carrier.name != "w:r" or properties == "all":
        return written(carrier, lambda x: x.children)
    heads = [x for x in carrier.children if x.name == "w:rPr"]

    def children(node: Node) -> list[Node]:
        if node is carrier and properties == "none":
            return [x for x in node.children if x.name != "w:rPr"]
        return [x for x in node.children if x.name in KEPT] if node in heads else node.children

    return written(carrier, children)


def _paths(document: Document, part: str | None) -> dict[tuple, Node]:
    return {tuple(n.path): n for n in document.nodes.get(part, ()) if n.name == "w:p"}


def _formulas(parts: DataFrame, wanted: DataFrame, properties: str) -> DataFrame:
    """(source_doc, source_part, source_path, index, n, formula, prefixes): each of the formulas that are wanted as it is written, with the prefixes in use, and how many its paragraph has."""
    kinds = pa.schema([("source_doc", pa.string()), ("source_part", pa.string()), ("source_path", pa.list_(pa.float64())), ("index", pa.int32()), ("n", pa.int32()), ("formula", pa.string()), ("prefixes", pa.list_(pa.string()))])

    def done(key: tuple, rows: Iterator[dict]) -> Iterator[tuple]:
        document, data = Document(key[0]), None
        found: dict[tuple, Node] | None = None
        for row in rows:
            if row["source_path"] is None:
                data = row["content"]
                continue
            if found is None:
                if data is not None:
                    document.parse(key[1], data, False)
                found = _paths(document, key[1])
            paragraph = found.get(tuple(row["source_path"]))
            own = [] if paragraph is None else _carriers_in(paragraph)
            index = row["index"]
            here = index is not None and 0 <= index < len(own)
            yield *key, row["source_path"], index, len(own), *(_packed(own[index], properties) if here else (None, None))
        document.drop()

    asked = wanted.select(*_SOURCE, F.col("index").cast("int").alias("index")).distinct().where("source_path IS NOT NULL")
    things = parts.where(F.col("part_path").rlike(_XML)).select(F.col("doc_id").alias("source_doc"), F.col("part_path").alias("source_part"), "content")
    order = [F.col("source_path").isNotNull(), "source_path", "index"]
    return _dealt(things.unionByName(asked, allowMissingColumns=True), ["source_doc", "source_part"], order).mapInArrow(
        lambda batches: in_turn(batches, ("source_doc", "source_part"), done, kinds), "source_doc string, source_part string, source_path array<double>, index int, n int, formula string, prefixes array<string>"
    )


def _dealt(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """Parts with what is asked of them behind each, in order; a part is in one task. There are as many tasks as shuffles have partitions, as this is work."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *key).sortWithinPartitions(*key, *order)


def splice_parts(parts: DataFrame, splices: DataFrame, properties: str = "all") -> DataFrame:
    """(doc_id, part_path, content): all parts, with copies of formulas as `splice` makes them; what no copy concerns stays byte for byte.

    Each formula is taken out of its part once and brought to the parts that it comes into, where a task holds one part at
    a time with all that comes into it. Errors are those of `splice`.
    """
    if properties not in ("all", "formula", "none"):
        raise ValueError(f"no such properties: {properties}")
    kinds = pa.schema([("doc_id", pa.string()), ("part_path", pa.string()), ("content", pa.binary())])
    parts, splices = stored(parts.select(*KEY, "content"), "parts"), stored(splices.withColumn("index", F.col("index").cast("int")), "splices")
    rows = splices.join(_formulas(parts, splices, properties), [*_SOURCE, "index"], "left")
    rows = rows.select(*KEY, "id", F.col("path").alias("at"), "index", "where", "anchor", F.coalesce("instance", F.lit(1)).cast("int").alias("instance"), "n", "formula", "prefixes", F.lit(True).alias("_asked"))

    def done(key: tuple, rows: Iterator[dict]) -> Iterator[tuple]:
        data, asked = None, []
        for row in rows:
            if row["_asked"]:
                asked.append(row)
            else:
                data = row["content"]
        if not asked:
            yield *key, data
            return
        document = Document(key[0])
        if data is not None and key[1].endswith((".xml", ".rels")):
            document.parse(key[1], data)
        _spliced(document, key[1], asked)
        document.finish()
        yield *key, dict(document.changed(alike=False)).get(key[1], data)
        document.drop()

    dealt = _dealt(parts.unionByName(rows, allowMissingColumns=True), KEY, [F.col("_asked").isNotNull(), "id"])
    return dealt.select(*KEY, "content", "_asked", "at", "index", "where", "anchor", "instance", "n", "formula", "prefixes").mapInArrow(lambda batches: in_turn(batches, tuple(KEY), done, kinds), "doc_id string, part_path string, content binary")


def _texts(paragraph: Node) -> list[tuple[Node, Node, str]]:
    """What makes up a paragraph's own text (see `inline.pieces`): the run, its child, and the text of that."""
    out: list[tuple[Node, Node, str]] = []
    stack = list(reversed(paragraph.children))
    while stack:
        node = stack.pop()
        if node.kind != "element" or node.name in I.SURFACES or node.name in I.GONE:
            continue
        if node.up.name == "w:r" and (node.name == "w:t" or node.name in I.CHARACTERS):
            out.append((node.up, node, "".join([x.text for x in node.children if x.kind == "text"]) if node.name == "w:t" else I.CHARACTERS[node.name]))
        stack += reversed(node.children)
    return out


def _copy(node: Node) -> Node:
    out = Node(node.kind, node.name, node.attrs, node.text)
    stack = [(node, out)]
    while stack:
        old, new = stack.pop()
        for x in old.children:
            y = Node(x.kind, x.name, x.attrs, x.text)
            y.up = new
            new.children.append(y)
            stack.append((x, y))
    return out


def _split(run: Node, texts: dict[int, tuple[int, str]], cuts: list[int]) -> list[Node]:
    """The parts of a run that is split at offsets of its own text, see `inline.split_runs`; texts has its children's, and where they begin."""
    bounds = [0, *cuts, max(at + len(text) for at, text in texts.values())]
    parts = [Node("element", run.name, run.attrs, None) for _ in bounds[1:]]

    def add(part: Node, x: Node) -> None:
        x.up = part
        part.children.append(x)

    end = 0  # of the texts so far
    for x in run.children:
        a, text = texts.get(id(x), (end, ""))
        b = end = max(end, a + len(text))
        for part, low, high in zip(parts, bounds, bounds[1:], strict=False):
            if x.name == "w:rPr":
                add(part, x if part is parts[0] else _copy(x))
            elif not text:
                if (low < a or part is parts[0]) and a <= high:
                    add(part, x)
            elif a < high and b > low:
                if low <= a and b <= high:
                    add(part, x)
                    continue
                piece = Node("element", x.name, [t for t in x.attrs if t[0] != "xml:space"] + [("xml:space", "preserve", "xml:space")], None)
                add(piece, Node("text", None, [], text[max(low - a, 0) : min(high, b) - a]))
                for y in x.children:
                    if y.kind == "element":
                        add(piece, _copy(y))
                add(part, piece)
    return parts


def _offset(flat: str, row: dict) -> int:
    """Where in a paragraph's text a splice comes."""
    anchor, at = row["anchor"], 0
    if anchor and row["instance"] >= 1:
        for k in range(row["instance"]):
            if k and not at:
                break
            at = flat.find(anchor, at) + 1
    if not at:
        raise ValueError(f"not found: {'null' if anchor is None else anchor}")
    return at - 1 if row["where"] == "before" else at - 1 + len(anchor)


def _spliced(document: Document, part: str, asked: list[dict]) -> None:
    """Does the splices of one part, which come in the order of their ids."""
    found = _paths(document, part)
    by: dict[int, tuple[Node, list[dict]]] = {}
    for row in asked:
        paragraph = None if row["at"] is None else found.get(tuple(row["at"]))
        if paragraph is None:
            raise ValueError("the target is no paragraph")
        if not row["n"]:
            raise ValueError("the source has no formula")
        if row["formula"] is None:
            raise ValueError(f"no formula {row['index']}")
        if row["where"] not in ("start", "end", "before", "after"):
            raise ValueError("no such place")
        by.setdefault(id(paragraph), (paragraph, []))[1].append(row)
    for paragraph, rows in by.values():
        _spliced_into(document, paragraph, rows)


def _spliced_into(document: Document, paragraph: Node, rows: list[dict]) -> None:
    flat, runs = "", {}
    for run, x, text in _texts(paragraph):
        runs.setdefault(id(run), (run, len(flat), {}))[2][id(x)] = len(flat), text
        flat += text
    offsets = {k: _offset(flat, row) for k, row in enumerate(rows) if row["where"] in ("before", "after")}
    # the runs with where they begin and end, split where something comes in
    spans: list[tuple[int, int, Node]] = []
    for run, begin, own in runs.values():
        end = max(at + len(text) for at, text in own.values())
        cuts = sorted({x for x in offsets.values() if begin < x < end})
        if not cuts:
            spans.append((begin, end, run))
            continue
        parts = _split(run, {x: (at - begin, text) for x, (at, text) in own.items()}, [x - begin for x in cuts])
        document.replace(run.up, run.up.children.index(run), 1, parts)
        spans += zip([begin, *cuts], [*cuts, end], parts, strict=True)
    head = next((x for x in paragraph.children if x.name == "w:pPr"), None)
    after: dict[int, list[Node]] = {}
    before: dict[int, list[Node]] = {}
    first: list[Node] = []
    last: list[Node] = []
    beside: dict[int, Node] = {}
    for k, row in enumerate(rows):
        new = as_written(row["formula"], row["prefixes"])
        if row["where"] == "end":
            last.append(new)
            continue
        if row["where"] == "start":
            to = head
            if to is None:
                first.append(new)
                continue
        else:
            following = next((run for begin, _, run in spans if begin >= offsets[k]), None) if row["where"] == "before" else None
            if following is not None:
                before.setdefault(id(following), []).append(new)
                beside[id(following)] = following
                continue
            to = [run for _, end, run in spans if end <= offsets[k]][-1]
        after.setdefault(id(to), []).append(new)
        beside[id(to)] = to
    for x in beside.values():
        place = x.up.children.index(x)
        document.replace(x.up, place + 1, 0, after.get(id(x), []))
        document.replace(x.up, place, 0, before.get(id(x), []))
    document.replace(paragraph, 0, 0, first)
    document.replace(paragraph, len(paragraph.children), 0, last)


def contexts(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """Splices for every formula of the source paragraphs of pairs(id, doc_id, part_path, path, source_doc, source_part, source_path): after what the target has of the CONTEXT characters of text before it, at the end where there are none. Formulas of a source paragraph keep their order (id is that of the pair and the index)."""
    tree = stored(T.tree_of(tree), "tree")
    known = carriers(tree).join(pairs.select(F.col("source_doc").alias("doc_id"), F.col("source_part").alias("part_path"), F.col("source_path").alias("path")).distinct(), [*KEY, "path"], "left_semi")
    texts = I.pieces(tree).select(*KEY, F.col("surface").alias("path"), "run", F.struct(F.col("path").alias("p"), "text").alias("t"))
    before = known.join(texts, [*KEY, "path"], "left").groupBy(*KEY, "path", "index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("run") < F.col("carrier"), F.col("t")))), lambda x: x["text"]), "").alias("_before"))
    rows = pairs.join(before.select(F.col("doc_id").alias("source_doc"), F.col("part_path").alias("source_part"), F.col("path").alias("source_path"), "index", "_before"), _SOURCE)
    anchor = F.substring("_before", F.greatest(F.length("_before") - CONTEXT, F.lit(0)) + 1, F.lit(CONTEXT))
    return rows.select(F.struct("id", "index").alias("id"), *KEY, "path", *_SOURCE, "index", F.when(anchor == "", "end").otherwise("after").alias("where"), anchor.alias("anchor"), F.lit(1).alias("instance"))


def prefixes_differ(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (as `contexts` has them) whose formulas are bound to another prefix than those of the target paragraph, m where it has none: with source_prefix and target_prefix. `splice` needs no check, as names are written under one prefix; this tells where a stricter rule would refuse."""
    math = nodes.where("name = 'm:oMath'").withColumn("_p", F.try_element_at("within", F.lit("w:p"))["node_id"])
    of = nodes.where("name = 'w:p'").select(*KEY, F.col("node_id").alias("_p"), "path")
    first = math.groupBy(*KEY, "_p").agg(F.min_by("prefix", "node_id").alias("prefix")).join(of, [*KEY, "_p"])
    source = first.select(F.col("doc_id").alias("source_doc"), F.col("part_path").alias("source_part"), F.col("path").alias("source_path"), F.col("prefix").alias("source_prefix"))
    both = pairs.join(source, _SOURCE).join(first.select(*KEY, "path", F.col("prefix").alias("target_prefix")), [*KEY, "path"], "left").withColumn("target_prefix", F.coalesce("target_prefix", F.lit("m")))
    return both.where("source_prefix <> target_prefix")


def replace_beside_formulas(nodes: DataFrame, find: str, replacement: str, regex: bool = False, match_case: bool = True) -> tuple[DataFrame, DataFrame]:
    """Replaces text in all surfaces, formulas counting as text that can't change: the tree, and refused(doc_id, part_path, surface, n).

    A paragraph's formulas read as `formulas.formula_texts` says, where they stand. An occurrence that a formula has part in
    stays as it is and is counted; the others are replaced over runs, as in `inline.replace_in_runs`.
    """
    nodes = stored(nodes, "nodes")
    tree = stored(T.tree_of(nodes), "tree")
    own = I.pieces(tree).select(*KEY, "surface", "path", "text", F.lit(False).alias("math"))
    math = nodes.where("name = 'm:oMath'").select(*KEY, F.col("node_id").alias("formula_id"), "path").join(formula_texts(nodes), [*KEY, "formula_id"])
    held = carriers(tree).select(*KEY, F.col("path").alias("surface"), F.col("carrier").alias("_up"))
    math = T._prefixes(math.select(*KEY, "path", "text")).join(held, [*KEY, "_up"]).select(*KEY, "surface", "path", "text", F.lit(True).alias("math"))
    both = own.unionByName(math).groupBy(*KEY, "surface").agg(F.array_sort(F.collect_list(F.struct("path", "text", "math"))).alias("all"))
    both = both.withColumn("flat", F.array_join(F.transform("all", lambda x: x["text"]), ""))
    step = lambda acc, x: F.struct((acc["at"] + F.length(x["text"])).cast("int").alias("at"), F.when(x["math"], F.array_append(acc["out"], F.struct(acc["at"].alias("s"), (acc["at"] + F.length(x["text"])).cast("int").alias("e")))).otherwise(acc["out"]).alias("out"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
    spans = stored(both.select(*KEY, "surface", "flat", F.aggregate("all", zero, step, lambda acc: acc["out"]).alias("spans")), "flat")
    found = I.matches_in(spans.select(*KEY, "surface", "flat"), find, replacement, regex, match_case).join(spans.drop("flat"), [*KEY, "surface"])
    met = lambda x: F.exists("spans", lambda m: (m["s"] < x["e"]) & (m["e"] > x["s"]))
    before = lambda x: F.aggregate(F.filter("spans", lambda m: m["e"] <= x["s"]), F.lit(0), lambda n, m: n + m["e"] - m["s"])
    free = F.transform(F.filter("edits", lambda x: ~met(x)), lambda x: F.struct((x["s"] - before(x)).cast("int").alias("s"), (x["e"] - before(x)).cast("int").alias("e"), x["r"].alias("r")))
    found = stored(found.select(*KEY, "surface", free.alias("edits"), F.size(F.filter("edits", met)).alias("n")), "found")
    return I.rewritten(tree, found.where(F.size("edits") > 0).drop("n")), found.where("n > 0").select(*KEY, "surface", "n")
