"""A log's operations applied to the trees of packages, in the log's order, over any number of documents.

Documents are dealt out with their logs and sorted, so that a task reads one after the other: a document's trees, then
its operations, each done on the trees in memory as it comes (`documents`). So the job is one shuffle, and a task holds
one document at a time, whose parts are as large as they are; of its log it holds one batch of rows.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.packages import ATTRIBUTES
from .documents import DOCUMENT, Document, Node, in_turn
from .operations import taking_part
from .tree import KEY, TREE

#: Kinds that concern no tree: a document without others is not read.
ASIDE = ("carryPart", "carryBinaryPart", "beginComponent", "endComponent")


def _by_document(things: DataFrame, log: DataFrame, order: list[str]) -> DataFrame:
    """The rows of parts or trees, each document's in order and followed by its log's; a document is in one task. There are as many tasks as shuffles have partitions: of few bytes Spark would make one, and this is work."""
    ops = log.select("doc_id", "seq", "op_id", "op_type", F.to_json("payload").alias("payload"))
    both = things.unionByName(ops, allowMissingColumns=True)
    tasks = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(tasks, "doc_id").sortWithinPartitions("doc_id", F.col("op_type").isNotNull(), *order, "seq")


def materialised(tree: DataFrame, log: DataFrame) -> DataFrame:
    """The tree rows (TREE) of all parts after the log (doc_id, seq, op_id, op_type, payload VARIANT), undone operations left out.

    An element is known by its own id (w14:paraId=.., w:id=.. and so on) or, new ones without any, as lib: and the id of the
    operation that brought it. A name that no node has at that time, an element that has been taken out of its list, a
    place beyond the end of a list, a kind of element that an operation is not for: each is an error. Operations on what
    stands inside a removed element have no effect. Cells are those of the table as it came. A part that an operation
    needs (styles, relationships) must be there; a comment's definition goes to the comments part if there is one. Unknown
    kinds have no effect; carried parts and prologs are not trees, see `materialised_parts`.
    """
    attribute = pa.struct([("name", pa.string()), ("value", pa.string()), ("raw", pa.string())])
    kinds = pa.schema([("doc_id", pa.string()), ("part_path", pa.string()), ("path", pa.list_(pa.float64())), ("kind", pa.string()), ("name", pa.string()), ("attrs", pa.list_(attribute)), ("text", pa.string())])

    def done(key: tuple, rows: Iterator[dict]) -> Iterator[tuple]:
        (doc,) = key
        document, nodes, stack = Document(doc), {}, []
        for row in rows:
            if row["op_type"] is None:
                node = Node(row["kind"], row["name"], [(a["name"], a["value"], a["raw"]) for a in row["attrs"]], row["text"], row["part_path"], row["path"][-1])
                del stack[len(row["path"]) - 1 :]
                if stack:
                    node.up = stack[-1]
                    node.up.children.append(node)
                stack.append(node)
                nodes.setdefault(node.part, []).append(node)
                continue
            if nodes:
                _added(document, nodes)
            document.apply(row["seq"], row["op_id"], row["op_type"], json.loads(row["payload"]))
        _added(document, nodes)
        document.finish()
        for row in document.rows():
            yield doc, *row
        document.drop()

    rows = _by_document(tree.select(*TREE), taking_part(log), ["part_path", "path"])
    return rows.mapInArrow(lambda batches: in_turn(batches, ("doc_id",), done, kinds), f"doc_id string, part_path string, path array<double>, kind string, name string, attrs {ATTRIBUTES}, text string")


def _added(document: Document, nodes: dict[str, list[Node]]) -> None:
    for part, found in nodes.items():
        document.add(part, found)
    nodes.clear()


def materialised_parts(parts: DataFrame, log: DataFrame) -> DataFrame:
    """(doc_id, part_path, content) of packages after their logs: of parts that an operation concerns the elements that are new or changed are written anew, all else stays byte for byte; carried parts are as they came.

    A prolog that the log sets begins the document's part. Parts that are no XML are not looked into.
    """
    kinds = pa.schema([("doc_id", pa.string()), ("part_path", pa.string()), ("content", pa.binary())])

    def done(key: tuple, rows: Iterator[dict]) -> Iterator[tuple]:
        (doc,) = key
        old: dict[str, bytes] = {}
        carried: dict[str | None, bytes | None] = {}
        document = None
        for row in rows:
            if row["op_type"] is None:
                old[row["part_path"]] = row["content"]
                continue
            if row["op_type"] in ASIDE:
                if row["op_type"].startswith("carry"):
                    payload = json.loads(row["payload"])
                    xml, coded = payload.get("xml"), payload.get("base64")
                    carried[payload.get("partPath")] = xml.encode() if xml is not None else None if coded is None else base64.b64decode(coded)
                continue
            if document is None:
                document = Document(doc)
                for part, data in old.items():
                    if part.endswith((".xml", ".rels")):
                        document.parse(part, data)
            document.apply(row["seq"], row["op_id"], row["op_type"], json.loads(row["payload"]))
        if document is not None:
            document.finish()
            old |= dict(document.changed(carried))
            document.drop()
        for part, data in (old | carried).items():
            yield doc, part, data

    rows = _by_document(parts.select(*KEY, "content"), taking_part(log), ["part_path"])
    return rows.mapInArrow(lambda batches: in_turn(batches, ("doc_id",), done, kinds), "doc_id string, part_path string, content binary")


__all__ = ["DOCUMENT", "materialised", "materialised_parts"]
