"""Packages turned back into logs: replaying the log on an empty document gives every part byte for byte.

A document's body becomes typed operations, a paragraph, table or section each with a payload, where these would write the
same bytes; that is tried element by element, and once more for the whole part by replaying the log. Parts for which it
fails, and all other parts, are carried as they are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.packages import PREFIXES, _xml_rows, xml_nodes
from ..sources.scratch import stored
from . import payloads as Y
from .reduction import DOCUMENT, materialised_parts
from .tree import KEY, USUAL

SKELETON = f'<w:document xmlns:w="{USUAL["w"]}"><w:body></w:body></w:document>'
#: Payload fields that are numbers.
NUMBERS = {"sizeHalfPoints", "sizeCsHalfPoints", "numId", "numLevel", *(f"spacing{x}" for x in ("Before", "After", "Line")), *(f"indent{x}" for x in ("Left", "Right", "FirstLine", "Hanging", "FirstLineChars", "HangingChars")), "pageWidth", "pageHeight", "pageSizeCode", *(f"margin{x}" for x in ("Top", "Right", "Bottom", "Left", "Header", "Footer", "Gutter")), "columnCount", "columnSpace", "docGridLinePitch"}
#: Attributes of paragraphs, runs and sections that payloads have.
PARAGRAPH = {"w14:paraId": "paraId", "w14:textId": "textId", "w:rsidR": "rsidR", "w:rsidRPr": "rsidRPr", "w:rsidRDefault": "rsidRDefault", "w:rsidP": "rsidP"}
RUN = {"w:rsidR": "rsidR", "w:rsidRPr": "rsidRPr"}
SECTION = RUN | {"w:rsidSect": "rsidSect"}


class Other(Exception):
    """Something that no payload says."""


def nested(xml: str) -> list:
    """[name, attributes, children] of one element; texts are strings."""
    at: dict[tuple, list] = {}
    scope = " ".join(f'xmlns:{p}="{uri}"' for p, uri in USUAL.items())
    for r in _xml_rows("", "", f"<f {scope}>{xml}</f>".encode()):
        if r[6] not in ("element", "text"):
            raise Other
        node = [r[7], {a["name"]: a["value"] for a in r[8]}, []] if r[6] == "element" else r[9]
        at[tuple(r[16])] = node
        if len(r[16]) > 1:
            at[tuple(r[16][:-1])][2].append(node)
    return at[0.0,][2][0]


def fields(attrs: dict, known: dict) -> dict:
    if set(attrs) - set(known):
        raise Other
    return {known[a]: v for a, v in attrs.items()}


def value(field: str, text: str) -> object:
    return int(text) if field in NUMBERS and text.lstrip("-").isdigit() else text


def said(table: tuple, elements: list) -> dict:
    """The payload fields that a table of properties has for elements."""
    out, known = {}, dict(table)
    for name, attrs, inner in elements:
        if inner or name not in known:
            raise Other
        of = {a: f for f, a in known[name].items()}
        if None in of:
            if attrs:
                raise Other
            out[of[None]] = True
        else:
            out |= {f: value(f, v) for f, v in fields(attrs, of).items()}
    return out


def run_of(node: list) -> dict:
    name, attrs, inner = node
    marks = inner[0][2] if inner and inner[0][0] == "w:rPr" else []
    texts = inner[1:] if marks else inner
    if name != "w:r" or len(texts) != 1 or texts[0][0] != "w:t" or len(texts[0][2]) > 1:
        raise Other
    space = fields(texts[0][1], {"xml:space": "preserveSpace"})
    return {"text": texts[0][2][0] if texts[0][2] else ""} | ({"preserveSpace": True} if space else {}) | said(Y.RUN_PROPERTIES, marks) | fields(attrs, RUN)


def marker_of(node: list) -> dict:
    name, attrs, inner = node
    if inner or not name.startswith("w:"):
        raise Other
    return {"localName": name[2:], "attributes": [{"prefix": a.rpartition(":")[0] or None, "localName": a.rpartition(":")[2], "value": v} for a, v in attrs.items()]}


def item_of(node: list) -> dict:
    if isinstance(node, str):
        raise Other
    name, attrs, inner = node
    if name == "w:r":
        return {"kind": "run", "run": run_of(node)}
    if name != "w:hyperlink":
        return {"kind": "marker", "marker": marker_of(node)}
    (a, target), *more = attrs.items() or [(None, None)]
    if more or a not in ("r:id", "w:anchor"):
        raise Other
    link = {"targetKind": "external", "target": "", "relationshipId": target} if a == "r:id" else {"targetKind": "anchor", "target": target}
    return {"kind": "hyperlink", "hyperlink": link | {"runs": [], "items": [item_of(x) for x in inner]}}


def section_of(node: list) -> dict:
    refs = {p: [{"type": x[1]["w:type"], "relationshipId": x[1]["r:id"]} for x in node[2] if x[0] == f"w:{p}Reference"] for p in ("header", "footer")}
    rest = [x for x in node[2] if x[0] not in ("w:headerReference", "w:footerReference")]
    return said(Y.SECTION_PROPERTIES, rest) | fields(node[1], SECTION) | {f"{p}References": r for p, r in refs.items() if r}


def paragraph_of(node: list) -> tuple[dict, list, dict | None]:
    """Payload, content and section of a paragraph."""
    name, attrs, inner = node
    payload, section = {"text": ""} | fields(attrs, PARAGRAPH), None
    if inner and not isinstance(inner[0], str) and inner[0][0] == "w:pPr":
        plain = []
        for x in inner[0][2]:
            if x[0] == "w:pStyle":
                payload |= fields(x[1], {"w:val": "styleId"})
            elif x[0] == "w:numPr":
                payload |= said((("w:ilvl", {"numLevel": "w:val"}), ("w:numId", {"numId": "w:val"})), x[2])
            elif x[0] == "w:rPr":
                payload["paragraphMarkRun"] = {"text": ""} | said(Y.RUN_PROPERTIES, x[2])
            elif x[0] == "w:sectPr":
                section = section_of(x)
            else:
                plain.append(x)
        payload |= said(Y.PARAGRAPH_PROPERTIES, plain)
        inner = inner[1:]
    return payload, [item_of(x) for x in inner], section


def table_of(node: list) -> dict:
    rows = [x for x in node[2] if x[0] == "w:tr"]
    columns = len(rows[0][2]) if rows else 0
    cells = [[c[2] for c in r[2]] for r in rows]
    rich = [[[{"paragraph": p[0], "items": p[1]} for p in map(paragraph_of, c)] for c in r] for r in cells]
    ids = lambda x: fields(x[1], {"w14:textId": "id"}).get("id", "")
    return {"rows": len(rows), "columns": columns, "richCells": rich, "rowIds": [ids(r) for r in rows], "cellIds": [[ids(c) for c in r[2]] for r in rows]} | ({"tableId": ids(node)} if ids(node) else {})


def typed(xml: str, op_id: str) -> list[tuple[str, dict]] | None:
    """The operations that write a body's child, in order, or None where none would write these very bytes. op_id is the first one's id."""
    try:
        node = nested(xml)
        if node[0] == "w:p":
            payload, items, section = paragraph_of(node)
            written = Y.paragraph(payload, "".join(map(Y.inline, items)), "" if section is None else Y.section(section))
            me = f"w14:paraId={payload['paraId']}" if payload.get("paraId") else f"w14:textId={payload['textId']}" if payload.get("textId") else f"lib:{op_id}"
            ops = [("appendParagraph", {"in": None, "paragraph": payload}), ("setParagraphContent", {"target": me, "items": items})] + ([("setSectionProperties", {"at": me, "section": section})] if section is not None else [])
        elif node[0] == "w:tbl":
            table = table_of(node)
            written, ops = Y.table(table), [("appendTable", {"in": None, "table": table})]
        elif node[0] == "w:sectPr":
            section = section_of(node)
            written, ops = Y.section(section), [("setSectionProperties", {"at": None, "section": section})]
        else:
            marker = marker_of(node)
            written, ops = Y.marker(marker), [("appendBlockMarker", {"marker": marker})]
    except (Other, KeyError, IndexError, TypeError, ValueError):
        return None
    return ops if written == xml else None


def skeleton(parts: DataFrame) -> DataFrame:
    """The empty document of each package, on which its log is replayed."""
    return parts.select("doc_id").distinct().select("doc_id", F.lit(DOCUMENT).alias("part_path"), F.encode(F.lit(SKELETON), "UTF-8").alias("content"))


def _operations(parts: DataFrame) -> DataFrame:
    """(doc_id, seq, op_id, op_type, p) for the documents whose body is all typed."""
    documents = parts.where(F.col("part_path") == DOCUMENT).select(*KEY, "content")
    nodes = stored(xml_nodes(documents).select(*KEY, "path", "kind", "name", "prefix", "attrs", "ns_uri", "src_start", "src_end"), "nodes")
    slices = lambda a, b: F.decode(F.substring("content", (F.col(a) + 1).cast("int"), (b - F.col(a)).cast("int")), "UTF-8")
    root = nodes.where("size(path) = 1 AND kind = 'element' AND name = 'w:document'").join(documents, KEY)
    # names must stand under their usual prefixes, a document's root must hold its body alone, and nothing may stand behind it
    usual = F.create_map(*(F.lit(x) for uri, p in PREFIXES.items() for x in (uri, p)))
    strange = nodes.where("kind = 'element'").where(F.coalesce(F.element_at(usual, F.col("ns_uri")) != F.col("prefix"), F.lit(False))).select("doc_id")
    strange = strange.unionByName(nodes.where("size(path) = 2 AND (kind <> 'element' OR name <> 'w:body' OR size(attrs) > 0)").select("doc_id")).unionByName(nodes.where("size(path) = 3 AND kind <> 'element'").select("doc_id")).unionByName(root.where(F.col("src_end") != F.length("content")).select("doc_id"))
    strange = strange.distinct()
    attributes = F.to_json(F.struct(F.transform("attrs", lambda x: F.struct(F.nullif(F.regexp_extract(x["raw"], "^([^:]+):", 1), F.lit("")).alias("prefix"), F.regexp_extract(x["raw"], "([^:]+)$", 1).alias("localName"), x["value"].alias("value"))).alias("attributes")))
    prolog = F.to_json(F.struct(slices("_zero", F.col("src_start")).alias("prolog")))
    head = root.withColumn("_zero", F.lit(0)).select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("seq"), F.lit("setDocumentProlog").alias("op_type"), prolog.alias("p")), F.struct(F.lit(1).alias("seq"), F.lit("setDocumentRoot").alias("op_type"), attributes.alias("p")))).alias("o")).select("doc_id", F.col("o.seq").cast("long").alias("seq"), "o.op_type", "o.p", F.lit(True).alias("ok"))
    children = nodes.where("size(path) = 3 AND kind = 'element'").join(documents, KEY).select("doc_id", (F.element_at("path", -1).cast("long") * 4 + 4).alias("seq"), slices("src_start", F.col("src_end")).alias("xml"))

    def ops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, seq, xml, op_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = typed(xml, op_id)
                out += [(doc, seq + k, kind, json.dumps(p), True) for k, (kind, p) in enumerate(found)] if found else [(doc, seq, None, None, False)]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], ["doc_id", "seq", "op_type", "p", "ok"])

    body = children.select("doc_id", "seq", "xml", _op_id().alias("op_id")).mapInArrow(ops, "doc_id string, seq long, op_type string, p string, ok boolean")
    every = stored(head.unionByName(body), "operations")
    failed = every.where("NOT ok").select("doc_id").unionByName(strange).distinct()
    return every.where("ok").join(failed, "doc_id", "left_anti").select("doc_id", "seq", _op_id().alias("op_id"), "op_type", "p")


def _op_id() -> Column:
    """A UUID of a document's operation, the same each time."""
    h = F.upper(F.md5(F.concat_ws("\n", "doc_id", F.col("seq").cast("string"))))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def reversed_log(parts: DataFrame) -> DataFrame:
    """(doc_id, seq, op_id, op_type, payload VARIANT): logs that give the packages (doc_id, part_path, content) back, from `skeleton`.

    Typed operations where a replay of them gives the document's bytes; it is tried here. All other parts are carried:
    text that is UTF-8 as it is, else as base64. A package without a document part has carried parts only.
    """
    parts = stored(parts.select(*KEY, "content"), "parts")
    found = stored(_operations(parts), "typed")
    log = found.withColumn("payload", F.parse_json("p")).drop("p")
    rebuilt = materialised_parts(skeleton(found), log).withColumnRenamed("content", "_new")
    same = stored(rebuilt.join(parts, KEY).where("_new = content").select("doc_id"), "rebuilt")
    kept = log.join(same, "doc_id", "left_semi")
    text = F.col("content").cast("string")
    plain = F.col("part_path").rlike(r"\.(xml|rels)$") & F.is_valid_utf8(text)
    rest = parts.join(same.select("doc_id", F.lit(DOCUMENT).alias("part_path")), KEY, "left_anti")
    # JSON keeps a text as it is, but for what it can't hold
    payload = F.when(plain, F.to_json(F.struct(F.col("part_path").alias("partPath"), text.alias("xml")))).otherwise(F.to_json(F.struct(F.col("part_path").alias("partPath"), F.base64("content").alias("base64"))))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("part_path")).cast("long") + (1 << 40)
    carried = rest.withColumn("seq", nth).select("doc_id", "seq", _op_id().alias("op_id"), F.when(plain, "carryPart").otherwise("carryBinaryPart").alias("op_type"), F.parse_json(payload).alias("payload"))
    return kept.unionByName(carried)


def typed_share(parts: DataFrame, log: DataFrame) -> DataFrame:
    """(doc_id, parts, bytes, typed_bytes, operations): how much of each package its log says by typed operations."""
    carried = log.where("op_type IN ('carryPart', 'carryBinaryPart')").select("doc_id", F.try_variant_get("payload", "$.partPath", "string").alias("part_path"), F.lit(True).alias("_c"))
    sizes = parts.select(*KEY, F.length("content").cast("long").alias("n")).join(carried, KEY, "left")
    count = log.groupBy("doc_id").agg(F.count("*").alias("operations"))
    return sizes.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum("n").alias("bytes"), F.sum(F.when(F.col("_c").isNull(), F.col("n")).otherwise(0)).alias("typed_bytes")).join(count, "doc_id", "left")
