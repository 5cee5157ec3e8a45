"""Document packages (ZIP archives of XML parts) as tables: parts, XML nodes, paragraphs, runs, cells, styles, relationships, comments, revisions.

Files are read with Spark's binaryFile source; a task opens each archive in memory and yields a row a part. Everything
after that is DataFrame work on (doc_id, part_path, content) or on the node table.
"""

import io
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence, Sized
from itertools import accumulate, chain
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_DEPTH = 1024
ATTRIBUTES = "array<struct<name:string,value:string,raw:string>>"
_TYPES = {
    "doc_id": "string", "part_path": "string", "node_id": "long", "parent_id": "long", "ord": "int", "depth": "int", "kind": "string", "name": "string", "attrs": ATTRIBUTES, "text": "string", "src_start": "long", "src_end": "long",
    "within": "map<string,struct<node_id:long,nest:int>>", "prefix": "string", "local_name": "string", "ns_uri": "string", "path": "array<double>",
}
NODES = ", ".join(f"{name} {kind}" for name, kind in _TYPES.items())
# Namespaces of the format and the prefixes by which operators name them, whatever prefix a part binds them to.
PREFIXES = {
    "http://schemas.openxmlformats.org/wordprocessingml/2006/main": "w",
    "http://purl.oclc.org/ooxml/wordprocessingml/main": "w",
    "http://schemas.microsoft.com/office/word/2010/wordml": "w14",
    "http://schemas.microsoft.com/office/word/2012/wordml": "w15",
    "http://schemas.openxmlformats.org/officeDocument/2006/relationships": "r",
    "http://purl.oclc.org/ooxml/officeDocument/relationships": "r",
    "http://schemas.openxmlformats.org/officeDocument/2006/math": "m",
    "http://schemas.openxmlformats.org/markup-compatibility/2006": "mc",
    "http://schemas.openxmlformats.org/drawingml/2006/main": "a",
    "http://schemas.openxmlformats.org/drawingml/2006/picture": "pic",
    "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing": "wp",
    "http://schemas.microsoft.com/office/word/2010/wordprocessingShape": "wps",
    "urn:schemas-microsoft-com:vml": "v",
    "http://schemas.openxmlformats.org/package/2006/metadata/core-properties": "cp",
    "http://purl.org/dc/elements/1.1/": "dc",
    "http://purl.org/dc/terms/": "dcterms",
    "http://schemas.openxmlformats.org/package/2006/relationships": "",
    "http://schemas.openxmlformats.org/package/2006/content-types": "",
}


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part_path, content) of every part of every package below `path`; doc_id is the file's path. Part paths that leave the package are an error."""

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    names = [n for n in z.namelist() if not n.endswith("/")]
                    if bad := [n for n in names if n.startswith("/") or ".." in n or "\\" in n or len(n) > 256]:
                        raise ValueError(f"unsafe part path in {file}: {bad[0]}")
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(names), pa.string()), pa.array(names, pa.string()), pa.array([z.read(n) for n in names], pa.binary())], ["doc_id", "part_path", "content"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path)
    return files.select("path", "content").mapInArrow(unzip, "doc_id string, part_path string, content binary")


def read_part_folders(spark: SparkSession, path: str) -> DataFrame:
    """The parts of packages kept as folders: the first folder below `path` is the document, the rest the part's path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inside = F.regexp_replace("path", "^[a-z]+:/*" + re.escape(path.split(":")[-1].strip("/")) + "/", "")
    return files.select(F.regexp_extract(inside, "^([^/]+)/", 1).alias("doc_id"), F.regexp_replace(inside, "^[^/]+/", "").alias("part_path"), "content")


def named(name: str, scope: dict[str, str], element: bool) -> tuple[str, str, str, str | None]:
    """(name, prefix, local name, namespace) of a name as written: the name is under the usual prefix of its namespace, if that is known. Attributes without a prefix are in no namespace."""
    prefix, _, local = name.rpartition(":")
    uri = scope.get(prefix) if prefix or element else None
    usual = PREFIXES.get(uri, prefix) if uri else prefix
    return (f"{usual}:{local}" if usual else local), prefix, local, uri


def _declares(attribute: str) -> bool:
    return attribute.startswith("xmlns") and (attribute == "xmlns" or attribute[5] == ":")


class _Parsed:
    """The nodes of a part in document order, a list for each column; attributes of all nodes lie end to end. `around` has the elements of `within` by their node_id.

    Handlers only note what comes, as they run for each node; parents and places among siblings follow from the depths, see `_layout`.
    wanted: the columns that are read of it, where not all are. Without src_start and src_end the parser joins texts itself.
    """

    def __init__(self, doc: str, part: str, data: bytes, within: frozenset[str] | None = None, wanted: Sequence[str] | None = None):
        self.doc, self.part = doc, part
        self.depth, self.kind, self.names, self.text, self.start, self.end, self.around, self.nest = [], [], [], [], [], [], [], []
        self.attributes, self.attribute_names, self.attribute_values, self.attribute_raws = [], [], [], []
        open_of: dict[str, list[int]] = {}  # the open elements of each name
        around: list[tuple[int, ...]] = [()]
        scopes: list[tuple[int, dict[str, str], dict, dict]] = [(-1, {}, {}, {})]  # depth, bindings, names of elements and attributes met in them
        stack: list[tuple] = []  # names of the open elements
        lasts: list[int] = []  # and their node_ids, where their ends are asked for
        depths, kinds, names, texts = self.depth, self.kind, self.names, self.text
        owners: list[int] = []  # the elements that have attributes
        lengths: list[int] = []
        add_depth, add_kind, add_name, add_text, push, pop = depths.append, kinds.append, names.append, texts.append, stack.append, stack.pop
        surrounded = wanted is None or "within" in wanted
        placed = wanted is None or "src_start" in wanted or "src_end" in wanted
        attributed = wanted is None or "attrs" in wanted
        parser = expat.ParserCreate()
        parser.ordered_attributes, parser.buffer_text = True, not placed
        none = (None,) * 4
        add_names, add_raws, add_values = self.attribute_names.extend, self.attribute_raws.extend, self.attribute_values.extend

        def open_(kind: str, of: tuple, text: str | None) -> None:
            if len(stack) >= MOST_DEPTH:
                raise ValueError(f"{part} of {doc} is nested deeper than {MOST_DEPTH}")
            add_depth(len(stack))
            add_kind(kind)
            add_name(of)
            add_text(text)
            if placed:
                self.start.append(parser.CurrentByteIndex)
                self.end.append(None)
            if surrounded:
                self.around.append(around[-1])
                self.nest.append(0)

        def bind(attrs: list[str]) -> None:
            """What an element's attributes bind, and the names of those that are new in its scope. Declarations have no entry, so that each is seen."""
            bound = {a.partition(":")[2]: v for a, v in zip(attrs[::2], attrs[1::2]) if _declares(a)}
            if bound:
                scopes.append((len(stack), scopes[-1][1] | bound, {}, {}))
            _, scope, _, of_attributes = scopes[-1]
            for raw in attrs[::2]:
                if raw not in of_attributes and not _declares(raw):
                    of_attributes[raw] = named(raw, scope, False)[0]

        def start(name: str, attrs: list[str]) -> None:
            if attrs:
                raws = attrs[::2]
                try:
                    usual = list(map(scopes[-1][3].__getitem__, raws))
                except KeyError:
                    bind(attrs)
                    _, scope, _, of_attributes = scopes[-1]
                    usual = [of_attributes[a] if a in of_attributes else named(a, scope, False)[0] for a in raws]
                if attributed:
                    add_names(usual)
                    add_raws(raws)
                    add_values(attrs[1::2])
                    owners.append(len(kinds))
                    lengths.append(len(raws))
            of_elements = scopes[-1][2]
            of = of_elements.get(name)
            if of is None:
                of = of_elements[name] = named(name, scopes[-1][1], True)
            if not surrounded and not placed and len(stack) < MOST_DEPTH:  # as `open_` does, without a call for each element
                add_depth(len(stack))
                add_kind("element")
                add_name(of)
                add_text(None)
                push(of)
                return
            own = len(kinds)
            if surrounded:
                nest = 0
                if within is None or of[0] in within:
                    same = open_of.setdefault(of[0], [])
                    nest = len(same)
                    around.append(tuple(own if x == same[-1] else x for x in around[-1]) if same else (*around[-1], own))
                    same.append(own)
                else:
                    around.append(around[-1])
                open_("element", of, None)
                self.nest[own] = nest
            else:
                open_("element", of, None)
            push(of)
            if placed:
                lasts.append(own)

        def end(name: str) -> None:
            of = pop()
            if placed:
                # of an empty-element tag the end is reported behind it, of others where the end tag begins
                at, own = parser.CurrentByteIndex, lasts.pop()
                empty = own == len(kinds) - 1 and data[at - 2 : at] == b"/>"
                self.end[own] = at if empty else data.find(b">", at) + 1
            if surrounded:
                around.pop()
                if within is None or of[0] in within:
                    open_of[of[0]].pop()
            if scopes[-1][0] == len(stack):
                scopes.pop()

        def text(value: str) -> None:
            # a text that came right before at this depth is the same one
            if kinds and kinds[-1] == "text" and depths[-1] == len(stack):
                texts[-1] += value
            else:
                open_("text", none, value)

        def no_dtd(*_: object) -> None:
            raise ValueError(f"{part} of {doc} has a document type declaration")

        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = start, end, text, no_dtd
        parser.CommentHandler = lambda value: open_("comment", none, value)
        parser.ProcessingInstructionHandler = lambda name, value: open_("instruction", (name, None, name, None), value)
        parser.Parse(data, True)
        counts = np.zeros(len(kinds), np.int64)
        counts[owners] = lengths
        self.attributes = counts.tolist()
        self._places: tuple | None = None

    def _layout(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Parents (-1: none), places among siblings, and paths laid end to end with their bounds. A level at a time: the ancestor of a node at a level is the last node that stands there."""
        if self._places is None:
            depth = np.array(self.depth, np.int32)
            ends = np.cumsum(depth + 1, dtype=np.int64)
            begins = ends - depth - 1
            parent, ord_, paths = np.full(len(depth), -1, np.int64), np.zeros(len(depth), np.int32), np.empty(int(ends[-1]) if len(ends) else 0)
            deep, level = np.arange(len(depth)), 0
            while len(deep):
                here = depth[deep] == level
                own = deep[here]
                up, nth = parent[own], np.arange(len(own))
                first = np.ones(len(own), bool)
                first[1:] = up[1:] != up[:-1]
                ord_[own] = nth - np.maximum.accumulate(np.where(first, nth, 0))
                ancestor = np.maximum.accumulate(np.where(here, deep, 0))
                paths[begins[deep] + level] = ord_[ancestor]
                below = ~here
                parent[deep[below]] = ancestor[below]
                deep, level = deep[below], level + 1
            self._places = parent, ord_, paths, np.concatenate([[0], ends])
        return self._places

    def column(self, name: str) -> pa.Array:
        """A column of the node table; lists and maps are laid end to end, which is several times as fast as a conversion of each."""
        n = len(self.kind)
        if name in ("name", "prefix", "local_name", "ns_uri"):
            k = ("name", "prefix", "local_name", "ns_uri").index(name)
            return pa.array([x[k] for x in self.names], pa.string())
        if name == "attrs":
            lists = [self.attribute_names, self.attribute_values, self.attribute_raws]
            return pa.ListArray.from_arrays(pa.array([0, *accumulate(self.attributes)], pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in lists], ["name", "value", "raw"]))
        if name == "within":
            ids = pa.array(list(chain.from_iterable(self.around)), pa.int64())
            nest = pa.array(self.nest, pa.int32()).take(ids)
            return pa.MapArray.from_arrays(_offsets(self.around), self.column("name").take(ids), pa.StructArray.from_arrays([ids, nest], ["node_id", "nest"]))
        if name == "path":
            _, _, paths, bounds = self._layout()
            return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(paths, pa.float64()))
        if name in ("doc_id", "part_path"):
            return pa.repeat(pa.scalar(self.doc if name == "doc_id" else self.part, pa.string()), n)
        if name == "node_id":
            return pa.array(np.arange(n), pa.int64())
        if name == "parent_id":
            parent = self._layout()[0]
            return pa.array(parent, pa.int64(), mask=parent < 0)
        if name == "ord":
            return pa.array(self._layout()[1], pa.int32())
        plain = {"depth": self.depth, "kind": self.kind, "text": self.text, "src_start": self.start, "src_end": self.end}
        return pa.array(plain[name], _NODE_COLUMNS.field(name).type)


def _xml_rows(doc: str, part: str, data: bytes) -> list[list]:
    """The rows of a part as NODES has them, but `within` a dict of pairs."""
    p = _Parsed(doc, part, data)
    ends = list(accumulate(p.attributes))
    attrs = [{"name": a, "value": v, "raw": r} for a, v, r in zip(p.attribute_names, p.attribute_values, p.attribute_raws, strict=True)]
    parent, ord_, paths, bounds = (x.tolist() for x in p._layout())
    return [
        [doc, part, k, parent[k] if parent[k] >= 0 else None, ord_[k], p.depth[k], p.kind[k], p.names[k][0], attrs[ends[k] - p.attributes[k] : ends[k]], p.text[k], p.start[k], p.end[k], {p.names[x][0]: (x, p.nest[x]) for x in p.around[k]}, *p.names[k][1:], paths[bounds[k] : bounds[k + 1]]]
        for k in range(len(p.kind))
    ]


_NODE_COLUMNS = pa.schema(
    [("doc_id", pa.string()), ("part_path", pa.string()), ("node_id", pa.int64()), ("parent_id", pa.int64()), ("ord", pa.int32()), ("depth", pa.int32()), ("kind", pa.string()), ("name", pa.string())]
    + [("attrs", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string()), ("raw", pa.string())]))), ("text", pa.string()), ("src_start", pa.int64()), ("src_end", pa.int64())]
    + [("within", pa.map_(pa.string(), pa.struct([("node_id", pa.int64()), ("nest", pa.int32())]))), ("prefix", pa.string()), ("local_name", pa.string()), ("ns_uri", pa.string()), ("path", pa.list_(pa.float64()))]
)
_BATCH_ROWS = 8192


def _offsets(lists: Iterable[Sized]) -> pa.Array:
    return pa.array([0, *accumulate(map(len, lists))], pa.int32())


def xml_nodes(parts: DataFrame, dealt: bool = False, columns: Sequence[str] | None = None, within: Iterable[str] | None = None) -> DataFrame:
    """The node table of all XML parts: an adjacency list in document order, with attributes in their order and the bytes of each element.

    `name` is the element's name under the usual prefix of its namespace, so operators find w:p whatever prefix a part
    uses; prefix, local_name and ns_uri are as written. Attributes have both names too (name, raw). `path` holds the
    places of a node and its ancestors among their siblings, from the root down, so that paths sort in document order.
    `within` names, for each kind of element that is open at a node (itself included), the innermost one and how many of its kind it stands in.
    White space is kept, CDATA is text, entities are decoded. A part with a document type declaration or nested deeper
    than MOST_DEPTH is an error, as is one that isn't well formed. dealt: parts that were made by a query go to as many
    tasks as shuffles have partitions first; a shuffle of few bytes would bring them to one task, and parsing is work.
    columns: only these are made; within: only these kinds of elements are named there (both: all, where not given).
    A row of all columns has a dozen entries in `within` alone, so what reads few of them should say so.
    """
    if dealt:
        parts = parts.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "part_path")
    wanted = list(columns or _TYPES)
    kinds = None if within is None else frozenset(within)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, n = [], 0
        for batch in batches:
            for doc, part, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                p = _Parsed(doc, part, data, kinds, wanted)
                ready.append(pa.RecordBatch.from_arrays([p.column(c) for c in wanted], wanted))
                n += len(p.kind)
                if n >= _BATCH_ROWS:
                    yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                    ready, n = [], 0
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()

    rows = parts.where(F.col("part_path").rlike(r"\.(xml|rels)$")).select("doc_id", "part_path", "content")
    return rows.mapInArrow(parse, ", ".join(f"{c} {_TYPES[c]}" for c in wanted))


def attribute(name: str) -> Column:
    """The value of an attribute of a node row, or null."""
    return F.get(F.filter("attrs", lambda x: x["name"] == name), 0)["value"]


def _inside(nodes: DataFrame, outer: str) -> DataFrame:
    """Nodes of a part with `_of`: the node_id of the innermost `outer` element they stand in (or are)."""
    return nodes.withColumn("_of", F.try_element_at("within", F.lit(outer))["node_id"])


def paragraphs(nodes: DataFrame, part: str = "word/document.xml") -> DataFrame:
    """(doc_id, ord, node_id, in_table, nest_depth, style, num_id, ilvl, para_id, page_break_before, has_formula, has_drawing, text) of a part's paragraphs.

    The text is that of w:t, with tabs and breaks, without deleted and field code text, and without that of paragraphs
    inside (text boxes), which have rows of their own. nest_depth counts the tables a paragraph stands in.
    """
    n = nodes.where(F.col("part_path") == part)
    inner = _inside(n, "w:p").where("_of IS NOT NULL")
    shown = F.when((F.col("kind") == "text") & (F.try_element_at("within", F.lit("w:t")).isNotNull()), F.col("text")).when(F.col("name") == "w:tab", "\t").when(F.col("name").isin("w:br", "w:cr"), "\n").when(F.col("name") == "w:noBreakHyphen", "\u2011")
    shown = F.when(F.try_element_at("within", F.lit("w:tabs")).isNull(), shown)  # w:tab is a tab stop there
    own = F.col("node_id") == F.col("_of")
    value = lambda name, attr="w:val": F.max(F.when((F.col("name") == name) & F.try_element_at("within", F.lit("w:pPrChange")).isNull(), attribute(attr)))
    on = F.bool_or(F.when(F.col("name") == "w:pageBreakBefore", ~F.coalesce(attribute("w:val"), F.lit("1")).isin("0", "false", "off")))
    rows = inner.groupBy("doc_id", F.col("_of").alias("node_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(shown.isNotNull(), F.struct("node_id", shown.alias("s"))))), lambda x: x["s"]), "").alias("text"),
        value("w:pStyle").alias("style"),
        value("w:numId").cast("int").alias("num_id"),
        value("w:ilvl").cast("int").alias("ilvl"),
        F.max(F.when(F.col("name") == "w:p", attribute("w14:paraId"))).alias("para_id"),
        F.coalesce(on, F.lit(False)).alias("page_break_before"),
        F.bool_or(F.coalesce(F.col("name").isin("m:oMath", "m:oMathPara"), F.lit(False))).alias("has_formula"),
        F.bool_or(F.coalesce(F.col("name").isin("w:drawing", "w:pict"), F.lit(False))).alias("has_drawing"),
        F.max(F.when(own, F.coalesce(F.try_element_at("within", F.lit("w:tbl"))["nest"] + 1, F.lit(0)))).alias("nest_depth"),
    )
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("node_id")) - 1
    return rows.select("doc_id", order.alias("ord"), "node_id", (F.col("nest_depth") > 0).alias("in_table"), "nest_depth", "style", "num_id", "ilvl", "para_id", "page_break_before", "has_formula", "has_drawing", "text")


def runs(nodes: DataFrame, part: str = "word/document.xml") -> DataFrame:
    """(doc_id, paragraph_id, run_idx, node_id, text, bold, italic, underline, size_half_points, color, font, revision_id, revision) of a part's runs, in order.

    A toggle such as w:b is on unless its value is 0, false or off; where a run doesn't say, it is null (the style
    decides). revision tells in which kind of change the run stands: insertion, deletion, moveFrom, moveTo, or null.
    """
    n = nodes.where(F.col("part_path") == part)
    inner = _inside(n, "w:r").where("_of IS NOT NULL")
    inside = lambda name: F.try_element_at("within", F.lit(name)).isNotNull()
    shown = F.when((F.col("kind") == "text") & (inside("w:t") | inside("w:delText")), F.col("text")).when(F.col("name") == "w:tab", "\t").when(F.col("name").isin("w:br", "w:cr"), "\n").when(F.col("name") == "w:noBreakHyphen", "\u2011")
    now = ~inside("w:rPrChange")
    value = lambda name, attr="w:val": F.max(F.when((F.col("name") == name) & now, attribute(attr)))
    toggle = lambda name: F.max(F.when((F.col("name") == name) & now, ~F.coalesce(attribute("w:val"), F.lit("1")).isin("0", "false", "off")))
    of = {k: F.max(F.when(F.col("node_id") == F.col("_of"), F.try_element_at("within", F.lit(k))["node_id"])) for k in ("w:p", *CHANGES)}
    rows = inner.groupBy("doc_id", F.col("_of").alias("node_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(shown.isNotNull(), F.struct("node_id", shown.alias("s"))))), lambda x: x["s"]), "").alias("text"),
        toggle("w:b").alias("bold"), toggle("w:i").alias("italic"), value("w:u").alias("underline"), value("w:sz").cast("int").alias("size_half_points"), value("w:color").alias("color"), value("w:rFonts", "w:ascii").alias("font"),
        of["w:p"].alias("paragraph_id"), F.greatest(*(of[k] for k in CHANGES)).alias("_change"),
    )
    marks = n.where(F.col("name").isin(*CHANGES)).select(F.col("doc_id").alias("_d"), F.col("node_id").alias("_m"), attribute("w:id").cast("int").alias("revision_id"), _change_kind().alias("revision"))
    rows = rows.join(marks, (F.col("doc_id") == F.col("_d")) & (F.col("_change") == F.col("_m")), "left")
    idx = F.row_number().over(Window.partitionBy("doc_id", "paragraph_id").orderBy("node_id")) - 1
    return rows.select("doc_id", "paragraph_id", idx.alias("run_idx"), "node_id", "text", "bold", "italic", "underline", "size_half_points", "color", "font", "revision_id", "revision")


def relationships(nodes: DataFrame) -> DataFrame:
    """(doc_id, part, r_id, type, target, mode) of all relationship parts; `part` is the one they belong to."""
    n = nodes.where("part_path LIKE '%.rels' AND name = 'Relationship'")
    part = F.regexp_replace(F.regexp_replace("part_path", r"_rels/", ""), r"\.rels$", "")
    return n.select("doc_id", part.alias("part"), attribute("Id").alias("r_id"), attribute("Type").alias("type"), attribute("Target").alias("target"), F.coalesce(attribute("TargetMode"), F.lit("Internal")).alias("mode"))


def styles(nodes: DataFrame) -> DataFrame:
    """(doc_id, id, name, type, based_on, is_default) of word/styles.xml."""
    n = nodes.where("part_path = 'word/styles.xml'")
    inner = _inside(n, "w:style").where("_of IS NOT NULL")
    first = lambda name: F.max(F.when(F.col("name") == name, attribute("w:val")))
    own = lambda a: F.max(F.when(F.col("name") == "w:style", attribute(a)))
    return inner.groupBy("doc_id", "_of").agg(own("w:styleId").alias("id"), first("w:name").alias("name"), own("w:type").alias("type"), first("w:basedOn").alias("based_on"), (own("w:default") == "1").alias("is_default")).drop("_of")


def comments(nodes: DataFrame) -> DataFrame:
    """(doc_id, id, author, date, text) of word/comments.xml."""
    n = nodes.where("part_path = 'word/comments.xml'")
    inner = _inside(n, "w:comment").where("_of IS NOT NULL")
    own = lambda a: F.max(F.when(F.col("name") == "w:comment", attribute(a)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("node_id", "text")))), lambda x: x["text"]), "")
    return inner.groupBy("doc_id", "_of").agg(own("w:id").cast("int").alias("id"), own("w:author").alias("author"), F.to_timestamp(own("w:date")).alias("date"), text.alias("text")).drop("_of")


# The elements that mark changes to content, and to formatting.
CHANGES = {"w:ins": "insertion", "w:del": "deletion", "w:moveFrom": "moveFrom", "w:moveTo": "moveTo"}
FORMAT_CHANGES = {"w:rPrChange": "formatting", "w:pPrChange": "paragraphChange", "w:sectPrChange": "sectionChange", "w:tblPrChange": "tableChange"}
#: What `paragraphs`, `runs` and `revisions` read of the node table, its columns and the kinds of elements in `within`; see `xml_nodes`.
READ = ("doc_id", "part_path", "node_id", "kind", "name", "attrs", "text", "within")
OF_PARAGRAPHS = ("w:p", "w:t", "w:tabs", "w:pPrChange", "w:tbl")
OF_RUNS = ("w:r", "w:p", "w:t", "w:delText", "w:rPrChange", *CHANGES)
OF_REVISIONS = ("w:p", *CHANGES, *FORMAT_CHANGES)


def _change_kind() -> Column:
    kinds = CHANGES | FORMAT_CHANGES
    return F.element_at(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)), F.col("name"))


def revisions(nodes: DataFrame) -> DataFrame:
    """(doc_id, part_path, id, kind, author, date, paragraph_index, text) of tracked changes in all parts.

    Kinds are insertion, deletion, moveFrom, moveTo and changes of formatting; a deletion and moveFrom hold the text
    that was, the others that which is. paragraph_index is the place of the paragraph in its part, null for a mark
    outside of all.
    """
    marks = [*CHANGES, *FORMAT_CHANGES]
    rows = nodes.withColumn("_p", F.try_element_at("within", F.lit("w:p"))["node_id"])
    place = rows.where("name = 'w:p'").select("doc_id", "part_path", F.col("node_id").alias("_p"), (F.row_number().over(Window.partitionBy("doc_id", "part_path").orderBy("node_id")) - 1).alias("paragraph_index"))
    held = rows.select("doc_id", "part_path", "node_id", "kind", "text", F.explode(F.filter(F.map_values(F.map_filter("within", lambda k, v: k.isin(*marks))), lambda v: v.isNotNull())).alias("_in")).where("kind = 'text'")
    text = held.groupBy("doc_id", "part_path", F.col("_in.node_id").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]), "").alias("_text"))
    own = rows.where(F.col("name").isin(*marks)).select("doc_id", "part_path", "node_id", "_p", attribute("w:id").cast("int").alias("id"), _change_kind().alias("kind"), attribute("w:author").alias("author"), F.to_timestamp(attribute("w:date")).alias("date"))
    out = own.join(text, ["doc_id", "part_path", "node_id"], "left").join(place, ["doc_id", "part_path", "_p"], "left")
    return out.select("doc_id", "part_path", "id", "kind", "author", "date", "paragraph_index", F.coalesce("_text", F.lit("")).alias("text"))


def fingerprints(nodes: DataFrame) -> DataFrame:
    """(doc_id, part_path, fingerprint): a hash of each part's tree without revision-save ids and namespace declarations, attributes sorted by name. Names count by their namespace, not by the prefix that a part binds it to."""
    kept = F.array_sort(F.transform(F.filter("attrs", lambda x: ~x["name"].rlike("^(w:rsid|xmlns)")), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"))))
    known = F.col("ns_uri").isin(*PREFIXES)
    line = F.to_json(F.struct("depth", "kind", F.when(known | F.col("ns_uri").isNull(), F.col("name")).otherwise(F.col("local_name")).alias("name"), F.when(~known, F.col("ns_uri")).alias("ns"), kept.alias("attrs"), "text"))
    rows = nodes.groupBy("doc_id", "part_path").agg(F.array_sort(F.collect_list(F.struct("node_id", line.alias("line")))).alias("lines"))
    return rows.select("doc_id", "part_path", F.sha2(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), 256).alias("fingerprint"))


def html_node_counts(pages: DataFrame) -> DataFrame:
    """(page_id, tag, n): how often each element is opened in a page. Comments are no elements, nor is what stands in scripts and style sheets. Spark functions only; a null page has no rows."""
    bare = F.regexp_replace("html", r"(?is)<!--.*?(?:-->|\z)", "")
    bare = F.regexp_replace(bare, r"(?is)(<(script|style)\b[^>]*>).*?(?:</\2\s*>|\z)", "$1")
    tags = pages.select("page_id", F.explode(F.regexp_extract_all(bare, F.lit(r"<([A-Za-z][^\s/>]*)"), 1)).alias("tag"))
    return tags.groupBy("page_id", F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


def image_size(content: Column) -> Column:
    """struct<width,height> of PNG or JPEG bytes, from the header's big-endian integers; null for other bytes.

    A JPEG's size stands in its first frame header (markers C0 to CF without C4, C8 and CC), found by stepping over the segments before it.
    """
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    short = lambda at: F.conv(F.hex(content.substr(at, F.lit(2))), 16, 10).cast("int")
    png = F.struct(number(17).alias("width"), number(21).alias("height"))
    # each step: the place after the segment that begins at `at`, and once a frame header is reached, that place for good
    marker = lambda at: F.hex(content.substr(at + 1, F.lit(1)))
    frame = lambda at: marker(at).isin(*(f"C{d}" for d in "01235679ABDEF"))
    step = lambda at, _: F.when(frame(at) | (F.hex(content.substr(at, F.lit(1))) != "FF"), at).otherwise(at + 2 + short(at + 2))
    at = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.lit(3), step)
    jpeg = F.transform(F.array(at), lambda x: F.when(frame(x), F.struct(short(x + 7).cast("long").alias("width"), short(x + 5).cast("long").alias("height"))))[0]
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", png).when(F.hex(F.substring(content, 1, 2)) == "FFD8", jpeg)


def read_oplog(spark: SparkSession, path: str) -> DataFrame:
    """JSONL operation logs: (doc_id, seq, op_id, op_type, source, ts, payload). Unknown operations keep their payload; seq is the line's place in its file."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.posexplode(F.split("value", "\n")).alias("seq", "line")).where("line <> ''")
    v = F.parse_json("line")
    get = lambda k, t: F.try_variant_get(v, f"$.{k}", t)
    return lines.select("doc_id", F.col("seq").cast("long").alias("seq"), get("op_id", "string").alias("op_id"), get("op_type", "string").alias("op_type"), get("source", "string").alias("source"), F.to_timestamp(get("ts", "string")).alias("ts"), v.alias("payload"))


def write_packages(parts: DataFrame) -> DataFrame:
    """(doc_id, package BINARY): each document's parts as one archive, in the order of their paths. A document is one group; its size is a file's."""
    import pandas as pd

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for part, content in sorted(zip(pdf["part_path"], pdf["content"], strict=True)):
                z.writestr(zipfile.ZipInfo(part, (1980, 1, 1, 0, 0, 0)), bytes(content), zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "package": [out.getvalue()]})

    return parts.select("doc_id", "part_path", "content").groupBy("doc_id").applyInPandas(pack, "doc_id string, package binary")


def write_oplog(log: DataFrame, path: str) -> None:
    """JSONL, one folder a document, lines in order with their keys in the log's order."""
    columns = [c for c in log.columns if c not in ("doc_id", "seq")]
    lines = log.select("doc_id", "seq", F.to_json(F.struct(*columns)).alias("value"))
    lines.repartition("doc_id").sortWithinPartitions("doc_id", "seq").select("doc_id", "value").write.partitionBy("doc_id").mode("overwrite").text(path)
