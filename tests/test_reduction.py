"""Logs applied to trees, against a plain fold over one document at a time."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quirespark.operators import payloads, reduction
from quirespark.operators import tree as T
from quirespark.sources import packages as P

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml"'
PROSE = '<w:p w14:paraId="A"><w:pPr><w:jc w:val="left"/></w:pPr><w:bookmarkStart w:id="90" w:name="b"/><w:r><w:t>one</w:t></w:r><w:bookmarkEnd w:id="91"/><w:r w14:textId="R1"><w:rPr><w:i/></w:rPr><w:t>two</w:t></w:r></w:p><w:p w14:paraId="B"><w:r><w:t>three</w:t></w:r></w:p>'
GRID = '<w:tbl w14:textId="T"><w:tr><w:tc><w:p w14:paraId="C1"><w:r><w:t>c</w:t></w:r></w:p></w:tc><w:tc><w:p w14:paraId="C2"/></w:tc></w:tr><w:tr><w:tc><w:p/></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>'
PARTS = {
    "word/document.xml": f'<w:document {NS}><w:body>{PROSE}{GRID}<w:p w14:paraId="D"><w:pPr><w:pStyle w:val="S"/></w:pPr><w:hyperlink r:id="rId1"><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p><w:sectPr><w:pgSz w:w="1"/></w:sectPr></w:body></w:document>',
    "word/styles.xml": f'<w:styles {NS}><w:style w:styleId="S"><w:name w:val="s"/></w:style></w:styles>',
    "word/comments.xml": f"<w:comments {NS}/>",
    "word/_rels/document.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"/>',
    "word/other.xml": "<x><y>kept  as it is</y></x>",
}
SCHEMA = "doc_id string, part_path string, content binary"
LOG = "doc_id string, seq long, op_id string, op_type string, payload string"
ORDER = {"w:rPr": ["w:rFonts", "w:b", "w:i", "w:color", "w:sz", "w:u"], "w:pPr": ["w:pStyle", "w:numPr", "w:spacing", "w:jc", "w:rPr", "w:sectPr"]}


def nested(rows):
    """[name or text, attributes, children] of tree rows (path, kind, name, attrs, text)."""
    at = {}
    for r in sorted(rows, key=lambda r: list(r["path"])):
        node = [r["name"], {a["name"]: a["value"] for a in r["attrs"] if not a["name"].startswith("xmlns")}, []] if r["kind"] == "element" else r["text"]
        at[tuple(r["path"])] = node
        if len(r["path"]) > 1:
            at[tuple(r["path"][:-1])][2].append(node)
    return next(iter(at.values()))


def parse(xml):
    usual = f'<f {NS}>{xml}</f>'
    return nested([dict(zip(("path", "kind", "name", "attrs", "text"), (r[16], r[6], r[7], r[8], r[9]), strict=True)) for r in P._xml_rows("d", "p", usual.encode())])[2][0]


class Plain:
    """The documents' trees as lists, and operations one after the other."""

    def __init__(self, parts):
        self.parts = {p: nested([dict(zip(("path", "kind", "name", "attrs", "text"), (r[16], r[6], r[7], r[8], r[9]), strict=True)) for r in P._xml_rows("d", p, x.encode())]) for p, x in parts.items() if p != "word/other.xml"}
        self.lib = {}

    def walk(self, node=None):
        for x in self.parts.values() if node is None else node[2]:
            if not isinstance(x, str):
                yield (node, x)
                yield from self.walk(x)

    def id_of(self, x):
        return next((f"{n}={x[1][n]}" for n in ("w14:paraId", "w:bookmarkId", "w:id", "r:id", "w14:textId") if n in x[1]), self.lib.get(id(x)))

    def find(self, i):
        hits = [(up, x) for up, x in self.walk() if self.id_of(x) == i]
        return hits[0] if hits else (None, None)

    def body(self):
        return self.parts["word/document.xml"][2][0]

    def child(self, x, name, make=True):
        for k in x[2]:
            if not isinstance(k, str) and k[0] == name:
                return k
        if make:
            x[2].insert(0, [name, {}, []])
            return x[2][0]
        return None

    def put(self, holder, node, name):
        holder[2][:] = [k for k in holder[2] if k[0] != name]
        if node:
            rank = ORDER[holder[0]].index
            n = next((j for j, k in enumerate(holder[2]) if k[0] in ORDER[holder[0]] and rank(k[0]) > rank(name)), len(holder[2]))
            holder[2].insert(n, node)

    def append(self, where, node):
        n = next((j for j, k in enumerate(where[2]) if not isinstance(k, str) and k[0] == "w:sectPr"), len(where[2]))
        where[2].insert(n, node)

    def head(self, p):
        return 1 if p[2] and p[2][0][0] == "w:pPr" else 0

    def apply(self, op_id, kind, p):
        place = lambda up, x: next(j for j, k in enumerate(up[2]) if k is x)
        new = lambda x: parse(x)
        name = lambda x: self.lib.setdefault(id(x), f"lib:{op_id}") and x
        if kind.startswith("insertParagraph"):
            up, x = self.find(p["after" if kind.endswith("After") else "before"])
            up[2].insert(place(up, x) + kind.endswith("After"), name(new(payloads.paragraph(p["paragraph"]))))
        elif kind == "insertTable":
            up, x = self.find(p["at"])
            up[2].insert(place(up, x) + 1, name(new(payloads.table(p["table"]))))
        elif kind == "insertSiblingAfter":
            up, x = self.find(p["after"])
            up[2].insert(place(up, x) + 1, new(p["nodeXML"]))
        elif kind in ("appendParagraph", "appendTable"):
            self.append(self.find(p["in"])[1] if p.get("in") else self.body(), name(new(payloads.paragraph(p["paragraph"]) if kind == "appendParagraph" else payloads.table(p["table"]))))
        elif kind == "appendBlockMarker":
            self.append(self.body(), new(payloads.marker(p["marker"])))
        elif kind in ("removeParagraph", "removeTable", "removeNode"):
            up, x = self.find(p["target" if kind == "removeNode" else "id"])
            del up[2][place(up, x)]
        elif kind == "setText":
            x = self.find(p["target"])[1]
            t = ["w:t", {}, [p["text"]] if p["text"] else []]
            if x[0] == "w:p":
                content = ("w:r", "w:hyperlink", "w:fldSimple", "w:sdt", "w:smartTag", "w:t")
                goes = [isinstance(k, str) or (k[0] in content and not any(y[0] == "w:commentReference" for _, y in self.walk(k))) for k in x[2]]
                kept = [k for k, g in zip(x[2], goes, strict=True) if not g]
                at = goes[: goes.index(True)].count(False) if any(goes) else next((j for j, k in enumerate(kept) if k[0] == "w:r"), len(kept))
                kept.insert(at, ["w:r", {}, [t]])
                x[2][:] = kept
            else:
                x[2][:] = [k for k in x[2] if k[0] != "w:t"] + [t]
        elif kind == "setCellText":
            rows = [k for k in self.find(p["table"])[1][2] if k[0] == "w:tr"]
            cell = [k for k in rows[p["row"]][2] if k[0] == "w:tc"][p["column"]]
            para = self.child(cell, "w:p", False)
            para[2][:] = [k for k in para[2] if k[0] == "w:pPr"] + [new(payloads.run({"text": p["text"]}))]
        elif kind == "setParagraphStyle":
            x = self.find(p["target"])[1]
            if p["styleId"] or self.child(x, "w:pPr", False):
                self.put(self.child(x, "w:pPr"), ["w:pStyle", {"w:val": p["styleId"]}, []] if p["styleId"] else None, "w:pStyle")
        elif kind == "setRunFormat":
            x = self.find(p["target"])[1]
            f, marks = p["format"], {"bold": "w:b", "italic": "w:i"}
            for k, v in f.items():
                tag = marks.get(k) or {"underline": "w:u", "fontSizeHalfPoints": "w:sz", "color": "w:color"}[k]
                if v is not False or self.child(x, "w:rPr", False):
                    self.put(self.child(x, "w:rPr"), None if v is False else [tag, {} if k in marks else {"w:val": "single" if k == "underline" else str(v)}, []], tag)
            x[2][:] = [k for k in x[2] if not (k[0] == "w:rPr" and not k[2])]
        elif kind == "insertRun":
            x = self.find(p["in"])[1]
            x[2].insert(self.head(x) + p["position"], name(new(payloads.run(p["run"]))))
        elif kind in ("insertTab", "insertBreak", "insertNoBreakHyphen"):
            x = self.find(p["in"])[1]
            atom = [payloads.ATOMS[kind], {}, []]
            x[2].append(atom if x[0] == "w:r" else ["w:r", {}, [atom]])
        elif kind == "insertBookmark":
            x = self.find(p["at"])[1]
            x[2].insert(self.head(x), ["w:bookmarkStart", {"w:id": str(p["bookmarkId"]), "w:name": p["name"]}, []])
            x[2].append(["w:bookmarkEnd", {"w:id": str(p["bookmarkId"])}, []])
        elif kind == "insertComment":
            x, n = self.find(p["anchor"])[1], str(p["commentId"])
            x[2].insert(self.head(x), ["w:commentRangeStart", {"w:id": n}, []])
            x[2] += [["w:commentRangeEnd", {"w:id": n}, []], ["w:r", {}, [["w:commentReference", {"w:id": n}, []]]]]
            self.parts["word/comments.xml"][2].append(["w:comment", {"w:id": n, "w:author": p["author"]}, [new(payloads.paragraph({"text": p["text"]}))]])
        elif kind in ("setRuns", "setParagraphContent"):
            x = self.find(p["target"])[1]
            x[2][:] = [k for k in x[2] if k[0] == "w:pPr"] + [new(payloads.run(r)) for r in p["runs"]] if kind == "setRuns" else [k for k in x[2] if k[0] == "w:pPr"] + [new(payloads.inline(r)) for r in p["items"]]
        elif kind == "insertNode":
            self.find(p["parent"])[1][2].insert(p["position"], name(new(p["nodeXML"])))
        elif kind == "moveNode":
            up, x = self.find(p["sourceNode"])
            to = self.find(p["destinationParent"])[1]
            n, d = place(up, x), p["destinationIndex"]
            del up[2][n]
            to[2].insert(d - 1 if up is to and n < d else d, x)
        elif kind == "wrapWithHyperlink":
            up, x = self.find(p["target"])
            up[2][place(up, x)] = ["w:hyperlink", {"r:id": p["rId"]}, [x]]
        elif kind == "updateAttribute":
            x, n = self.find(p["target"])[1], (p["prefix"] + ":" if p["prefix"] else "") + p["localName"]
            x[1].pop(n, None) if p["value"] is None else x[1].__setitem__(n, p["value"])
        elif kind == "setSectionProperties":
            s = new(payloads.section(p["section"]))
            if p["at"] is None:
                b = self.body()
                b[2][:] = [k for k in b[2] if k[0] != "w:sectPr"] + [s]
            else:
                self.put(self.child(self.find(p["at"])[1], "w:pPr"), s, "w:sectPr")
        elif kind == "defineStyle":
            root = self.parts["word/styles.xml"]
            if not any(k[1].get("w:styleId") == p["payload"]["styleId"] for k in root[2]):
                root[2].append(new(payloads.style(p["payload"])))
        elif kind == "addRelationship":
            self.parts[p["part"]][2].append(["Relationship", {"Id": p["id"], "Type": p["type"], "Target": p["target"]} | ({"TargetMode": p["targetMode"]} if p.get("targetMode") else {}), []])
        elif kind == "setDocumentRoot":
            self.parts["word/document.xml"][1] = {(a["prefix"] + ":" if a.get("prefix") else "") + a["localName"]: a["value"] for a in p["attributes"] if a.get("prefix") != "xmlns"}


def invented(rng, n):
    """A log of random operations that fit the state so far, and the state."""
    plain, log = Plain(PARTS), []
    for k in range(n):
        op = f"OP-{k}"
        named = {}
        for up, x in plain.walk():
            i = plain.id_of(x)
            if i and up and i not in named:
                named[i] = x
        of = lambda *names: rng.choice([i for i, x in named.items() if x[0] in names] or [None])
        block, para, run = of("w:p", "w:tbl"), of("w:p"), of("w:r")
        payload = {"text": f"t{k} <&>", **({"paraId": f"P{k}"} if rng.random() < 0.6 else {}), **({"styleId": "S", "alignment": "right", "numId": 3, "spacingAfter": 5} if rng.random() < 0.3 else {})}
        fmt = rng.choice([{"text": f"r{k}"}, {"text": f" r{k}", "bold": True, "color": "FF0000", "preserveSpace": True, "fontAscii": "F"}])
        outer = lambda i: [y for _, y in plain.walk(named[i])]
        kind, p = rng.choice([
            ("insertParagraphAfter", {"after": block, "paragraph": payload}), ("insertParagraphBefore", {"before": block, "paragraph": payload}), ("appendParagraph", {"in": rng.choice([None, None]), "paragraph": payload}), ("removeParagraph", {"id": para}),
            ("insertTable", {"at": block, "table": {"rows": 1, "columns": 2, "cells": [["x", "y"]], "tableId": f"T{k}"}}), ("appendTable", {"in": None, "table": {"rows": 2, "columns": 1}}), ("setText", {"target": para, "text": f"s{k}"}), ("setText", {"target": run, "text": f"q{k}"}),
            ("setParagraphStyle", {"target": para, "styleId": rng.choice(["S", f"N{k}", None])}), ("setRunFormat", {"target": run, "format": rng.choice([{"bold": True}, {"bold": False}, {"italic": False, "underline": True}, {"fontSizeHalfPoints": 20, "color": "00FF00"}])}),
            ("insertRun", {"in": para, "position": 0, "run": fmt}), ("insertTab", {"in": para}), ("insertBreak", {"in": run}), ("insertBookmark", {"at": para, "bookmarkId": 1000 + k, "name": f"m{k}"}), ("insertComment", {"anchor": para, "commentId": 5000 + k, "text": "c", "author": "a"}),
            ("setRuns", {"target": para, "runs": [fmt, {"text": "z"}][: rng.randrange(3)]}), ("setParagraphContent", {"target": para, "items": [{"kind": "run", "run": fmt}, {"kind": "hyperlink", "hyperlink": {"targetKind": "anchor", "target": "m", "runs": [{"text": "l"}]}}]}),
            ("insertSiblingAfter", {"after": block, "nodeXML": f'<w:p w14:paraId="S{k}"><w:r w14:textId="SR{k}"><w:t>sib</w:t></w:r></w:p>'}), ("moveNode", {"sourceNode": block, "destinationParent": para, "destinationIndex": 0}), ("moveNode", {"sourceNode": run, "destinationParent": para, "destinationIndex": 0}),
            ("wrapWithHyperlink", {"target": run, "rId": f"rId{k}"}), ("updateAttribute", {"target": block, "prefix": "w", "localName": rng.choice(["rsidR", "x"]), "value": rng.choice([None, f"v{k}"])}), ("setSectionProperties", {"at": rng.choice([None, para]), "section": {"pageWidth": k, "columnCount": 2}}),
            ("defineStyle", {"payload": {"styleId": rng.choice(["S", "U", f"V{k}"]), "bold": True}}), ("addRelationship", {"part": "word/_rels/document.xml.rels", "id": f"rel{k}", "type": "t", "target": "x", "targetMode": None}), ("appendBlockMarker", {"marker": {"localName": "bookmarkStart", "attributes": [{"prefix": "w", "localName": "id", "value": str(9000 + k)}]}}),
            ("insertNode", {"parent": para, "position": 0, "nodeXML": f'<w:r w14:textId="I{k}"><w:t>node</w:t></w:r>'}), ("setCellText", {"table": "w14:textId=T", "row": 1, "column": 1, "text": f"cell{k}"}), ("removeNode", {"target": run}),
        ])
        first = next(iter(p.values()), 1)
        if first is None and kind not in ("appendParagraph", "appendTable", "setSectionProperties"):
            continue
        if kind == "setSectionProperties" and p["at"] is None and rng.random() < 0.5:
            continue
        if kind == "setCellText" and ("w14:textId=T" not in named or len([x for _, x in plain.walk(named["w14:textId=T"]) if x[0] == "w:p"]) != 4):
            continue
        if kind == "moveNode" and (p["destinationParent"] is None or named[p["sourceNode"]] is named[p["destinationParent"]] or any(y is named[p["destinationParent"]] for y in outer(p["sourceNode"])) or (named[p["sourceNode"]][0] != "w:r")):
            continue
        plain.apply(op, kind, p)
        log.append((op, kind, p))
    return log, plain


def frame(spark, logs):
    rows = [(d, seq, op, kind, json.dumps(p)) for d, log in logs.items() for seq, (op, kind, p) in enumerate(log)]
    return spark.createDataFrame(rows, LOG).withColumn("payload", F.parse_json("payload"))


def packages(spark, docs):
    return spark.createDataFrame([(d, k, v.encode()) for d in docs for k, v in PARTS.items()], SCHEMA)


def test_random_logs_equal_a_plain_fold(spark):
    logs, want = {}, {}
    for seed in range(24):
        logs[f"d{seed}"], want[f"d{seed}"] = invented(random.Random(seed), 40)
    assert len({kind for log in logs.values() for _, kind, _ in log}) >= 25
    parts = packages(spark, logs)
    tree = T.tree_of(P.xml_nodes(parts.where("part_path <> 'word/other.xml'")))
    got = {}
    for r in reduction.materialised(tree, frame(spark, logs)).collect():
        got.setdefault((r["doc_id"], r["part_path"]), []).append(r)
    for d, plain in want.items():
        for p, root in plain.parts.items():
            assert nested(got[d, p]) == root, (d, p, logs[d])


def test_random_logs_written_and_read_again(spark):
    """The bytes that are written say what a plain fold says, whatever of them was taken over."""
    logs, want = {}, {}
    for seed in range(100, 112):
        logs[f"d{seed}"], want[f"d{seed}"] = invented(random.Random(seed), 40)
    for r in reduction.materialised_parts(packages(spark, logs), frame(spark, logs)).collect():
        data = bytes(r["content"])
        if r["part_path"] == "word/other.xml":
            assert data == PARTS["word/other.xml"].encode()
        else:
            assert nested([dict(zip(("path", "kind", "name", "attrs", "text"), (x[16], x[6], x[7], x[8], x[9]), strict=True)) for x in P._xml_rows("d", "p", data)]) == want[r["doc_id"]].parts[r["part_path"]], (r, logs[r["doc_id"]])


def test_changed_elements_keep_their_start_tags_before_texts_of_any_form(spark):
    """A text that begins as CDATA has its place behind the mark: the start tag ends before that."""
    xml = f'<w:document {NS}><w:body  w:x = "&gt;"><![CDATA[<]]><w:p w14:paraId="A"/><w:p w14:paraId="B" ><w:r><w:t>kept</w:t ></w:r></w:p></w:body></w:document>'
    parts = spark.createDataFrame([("x", "word/document.xml", xml.encode())], SCHEMA)
    got = bytes(reduction.materialised_parts(parts, frame(spark, {"x": [("a", "removeParagraph", {"id": "w14:paraId=A"})]})).first()["content"]).decode()
    assert got == xml.replace("<![CDATA[<]]>", "&lt;").replace('<w:p w14:paraId="A"/>', "")


ONE = [
    ("a", "setText", {"target": "w14:paraId=A", "text": "undone"}), ("b", "insertParagraphAfter", {"after": "w14:paraId=A", "paragraph": {"text": "kept", "paraId": "K"}}), ("c", "undo", {"targetOpID": "a"}), ("d", "carryPart", {"partPath": "word/other.xml", "xml": "<new/>"}),
    ("e", "setDocumentProlog", {"prolog": '<?xml version="1.0"?>\r\n'}), ("f", "setDocumentRoot", {"attributes": [{"prefix": "xmlns", "localName": "w", "value": "http://schemas.openxmlformats.org/wordprocessingml/2006/main"}, {"prefix": "w", "localName": "x", "value": "1"}]}), ("g", "brandNew", {"target": "nobody"}),
    ("h", "beginComponent", {"id": "q", "type": "T"}), ("i", "carryBinaryPart", {"partPath": "word/media/i.bin", "base64": "AAE="}),
]


def test_parts_of_packages(spark):
    """What no operation concerns stays byte for byte, undone operations leave nothing, carried parts and prologs come as they are; a package without a log is left alone."""
    got = {(r["doc_id"], r["part_path"]): bytes(r["content"]) for r in reduction.materialised_parts(packages(spark, ["x", "y"]), frame(spark, {"x": ONE})).collect()}
    assert {k: v for k, v in got.items() if k[0] == "y"} == {("y", p): x.encode() for p, x in PARTS.items()}
    assert got["x", "word/styles.xml"] == PARTS["word/styles.xml"].encode() and got["x", "word/other.xml"] == b"<new/>" and got["x", "word/media/i.bin"] == b"\x00\x01"
    document = got["x", "word/document.xml"].decode()
    assert document.startswith('<?xml version="1.0"?>\r\n<w:document ') and ' w:x="1"' in document and "undone" not in document
    assert '<w:p w14:paraId="K"><w:r><w:t>kept</w:t></w:r></w:p><w:p w14:paraId="B">' in document


@pytest.mark.parametrize("log, message", [
    ([("a", "setText", {"target": "w14:paraId=none", "text": ""})], "no such element"),
    ([("a", "removeParagraph", {"id": "w14:paraId=A"}), ("b", "removeParagraph", {"id": "w14:paraId=A"})], "no such element"),
    ([("a", "insertRun", {"in": "w14:paraId=A", "position": 9, "run": {"text": ""}})], "out of range"),
    ([("a", "setRunFormat", {"target": "w14:paraId=A", "format": {"bold": True}})], "can't be done on"),
    ([("a", "removeTable", {"id": "w14:paraId=A"})], "no table"),
    ([("a", "setCellText", {"table": "w14:textId=T", "row": 2, "column": 0, "text": ""})], "no such cell"),
    ([("a", "insertSiblingAfter", {"after": "w14:paraId=A", "nodeXML": "<w:p>"})], "mismatched tag"),
    ([("a", "moveNode", {"sourceNode": "w14:paraId=A", "destinationParent": "w14:textId=R1", "destinationIndex": 0})], "into itself"),
])
def test_errors(spark, log, message):
    tree = T.tree_of(P.xml_nodes(packages(spark, ["x"]).where("part_path LIKE 'word/d%'")))
    with pytest.raises(Exception, match=message):
        reduction.materialised(tree, frame(spark, {"x": log})).collect()


def test_empty_log(spark):
    tree = T.tree_of(P.xml_nodes(packages(spark, ["x"]).where("part_path LIKE 'word/%.xml'")))
    got = reduction.materialised(tree, frame(spark, {"x": []})).collect()
    assert sorted(map(str, got)) == sorted(map(str, tree.collect()))
