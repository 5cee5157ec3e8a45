"""Packages turned into logs: replaying gives every part byte for byte."""

from pyspark.sql import functions as F

from quirespark.operators import reverse
from quirespark.operators.reduction import materialised_parts

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
ROOT = f'{W} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml"'
PROLOG = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\r\n'
RUNS = '<w:r w:rsidR="1"><w:rPr><w:rFonts w:ascii="F" w:eastAsia="G"/><w:b/><w:color w:val="FF0000"/><w:sz w:val="24"/></w:rPr><w:t xml:space="preserve"> a &amp; b </w:t></w:r><w:bookmarkStart w:id="1" w:name="m"/><w:hyperlink r:id="rId5"><w:r><w:t>link</w:t></w:r></w:hyperlink><w:hyperlink w:anchor="m"><w:r><w:t>é漢</w:t></w:r></w:hyperlink><w:bookmarkEnd w:id="1"/>'
FULL = '<w:p w14:paraId="A1" w:rsidR="2"><w:pPr><w:pStyle w:val="S"/><w:numPr><w:ilvl w:val="0"/><w:numId w:val="4"/></w:numPr><w:spacing w:before="10" w:lineRule="auto"/><w:ind w:left="5" w:hanging="6"/><w:jc w:val="center"/><w:rPr><w:i/></w:rPr></w:pPr>' + RUNS + "</w:p>"
BREAK = '<w:p><w:pPr><w:sectPr><w:type w:val="continuous"/><w:pgSz w:w="100" w:h="200"/></w:sectPr></w:pPr></w:p>'
TABLE = '<w:tbl w14:textId="T1"><w:tblGrid><w:gridCol/><w:gridCol/></w:tblGrid><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc w14:textId="C"><w:p/><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
SECTION = '<w:sectPr w:rsidR="3"><w:headerReference w:type="default" r:id="rId1"/><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="1440" w:gutter="0"/><w:cols w:space="425"/><w:docGrid w:linePitch="360"/></w:sectPr>'


def document(body, root=ROOT, prolog=PROLOG, tail=""):
    return f"{prolog}<w:document {root}><w:body>{body}</w:body></w:document>{tail}".encode()


GOOD = {"typed": document(FULL + BREAK + TABLE + "<w:p/>" + '<w:bookmarkEnd w:id="9"/>' + SECTION), "bare": document("<w:p><w:r><w:t>only</w:t></w:r></w:p>", W, "")}
ODD = {
    "spaced": document("<w:p ><w:r><w:t>one</w:t></w:r></w:p>"), "drawing": document(FULL + "<w:p><w:r><w:drawing/></w:r></w:p>"), "order": document('<w:p><w:pPr><w:jc w:val="left"/><w:pStyle w:val="S"/></w:pPr></w:p>'), "comment": document("<!-- c --><w:p/>"),
    "tail": document("<w:p/>", tail="\n"), "prefix": document("<w:p/>").replace(b"w:", b"x:").replace(b"xmlns:w", b"xmlns:x"), "quotes": document("<w:p w:rsidR='1'/>"), "entity": document("<w:p><w:r><w:t>&#65;</w:t></w:r></w:p>"), "number": document('<w:p><w:pPr><w:spacing w:before="010"/></w:pPr></w:p>'),
}
OTHERS = {"word/styles.xml": f"﻿<w:styles {W}>\r\n<!-- é --></w:styles>".encode(), "word/media/i.png": bytes(range(256)), "word/latin.xml": "<?xml version='1.0' encoding='latin-1'?><x>é</x>".encode("latin-1")}


def test_every_part_comes_back(spark):
    """Typed where operations write the same bytes, carried where they don't: odd spaces, quotes, entities, prefixes, order, drawings."""
    docs = GOOD | ODD | {"none": None}
    rows = [(d, p, c) for d, x in docs.items() for p, c in (({"word/document.xml": x} if x else {}) | OTHERS).items() if x is None or p != "word/latin.xml"]
    parts = spark.createDataFrame(rows, "doc_id string, part_path string, content binary")
    log = reverse.reversed_log(parts).cache()
    empty = reverse.skeleton(parts.where("doc_id <> 'none'"))
    got = {(r["doc_id"], r["part_path"]): bytes(r["content"]) for r in materialised_parts(empty, log).collect()}
    assert got == {(d, p): bytes(c) for d, p, c in rows}
    share = {r["doc_id"]: r for r in reverse.typed_share(parts, log).collect()}
    assert {d for d, r in share.items() if r["typed_bytes"] > 0} == set(GOOD)
    assert share["typed"]["typed_bytes"] == len(GOOD["typed"]) and share["typed"]["parts"] == 3
    kinds = {r["op_type"] for r in log.where("doc_id = 'typed'").collect()}
    assert kinds == {"setDocumentProlog", "setDocumentRoot", "appendParagraph", "setParagraphContent", "setSectionProperties", "appendTable", "appendBlockMarker", "carryPart", "carryBinaryPart"}
    assert log.groupBy("doc_id", "op_id").count().where("count > 1").count() == 0 and log.where(~F.col("op_id").rlike("^[0-9A-F]{8}(-[0-9A-F]{4}){3}-[0-9A-F]{12}$")).count() == 0
