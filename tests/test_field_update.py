"""Sequence fields numbered anew, against a plain walk."""

from pyspark.sql import functions as F

from quirespark.operators import field_update as U
from quirespark.operators import tree as T
from quirespark.sources import packages as P

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def seq(code, *shown):
    mark = lambda k: f'<w:r><w:fldChar w:fldCharType="{k}"/></w:r>'
    return mark("begin") + f"<w:r><w:instrText> SEQ {code} </w:instrText></w:r>" + mark("separate") + "".join(f"<w:r><w:t>{s}</w:t></w:r>" for s in shown) + mark("end")


def p(inner, style=None):
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr>{inner}</w:p>' if style else f"<w:p>{inner}</w:p>"


FIG, TAB = r"Figure \* ARABIC", r"Table \* ARABIC \s 1"
BODY = p(seq(FIG, "9")) + p("x", "Heading 1") + p(seq(TAB, "4", "5") + seq(FIG, "2")) + f"<w:tbl><w:tr><w:tc>{p('in', 'Heading 1')}{p(seq(TAB, '7'))}</w:tc></w:tr></w:tbl>" + p("y", "Heading 1") + p(seq(TAB, "7") + seq("Plain") + '<w:fldSimple w:instr=" SEQ Figure \\* ARABIC "><w:r><w:t>0</w:t></w:r></w:fldSimple>') + p("z", "Heading 2") + p(seq(TAB, "?"))
PARTS = {
    "word/document.xml": f"<w:document {NS}><w:body>{BODY}</w:body></w:document>",
    "word/header10.xml": f"<w:hdr {NS}>{p(seq(FIG, '1'))}</w:hdr>",
    "word/header2.xml": f"<w:hdr {NS}>{p(seq(FIG, '1') + seq(TAB, '1'))}</w:hdr>",
    "word/footnotes.xml": f"<w:footnotes {NS}><w:footnote w:id='1'>{p(seq(FIG, '1'))}</w:footnote><w:footnote w:id='2'>{p(seq(FIG, '1'))}</w:footnote></w:footnotes>",
    "word/comments.xml": f"<w:comments {NS}>{p(seq(FIG, '1'))}</w:comments>",
}


def shown(tree):
    """{part: texts of its w:t in order}."""
    rows = tree.where("kind = 'text'").join(tree.where("name = 'w:t'").select(*T.KEY, F.col("path").alias("up")), T.KEY).where(F.slice("path", 1, F.size("path") - 1) == F.col("up")).orderBy("path").collect()
    out = {}
    for r in rows:
        out.setdefault(r["part_path"], []).append(r["text"])
    return out


def test_numbers_over_containers(spark):
    nodes = P.xml_nodes(spark.createDataFrame([(d, k, v.encode()) for d in "ab" for k, v in PARTS.items()], "doc_id string, part_path string, content binary"))
    together = U.update_fields(nodes)
    for d in "ab":
        got = shown(together.where(F.col("doc_id") == d))
        # a heading inside a table does not count, one of another level begins nothing anew; a field without a result counts in its own sequence
        assert got["word/document.xml"] == ["1", "1", "", "2", "2", "1", "3", "2"]
        assert got["word/header2.xml"] == ["4", "3"] and got["word/header10.xml"] == ["5"] and got["word/footnotes.xml"] == ["6", "7"] and got["word/comments.xml"] == ["1"]
    apart = shown(U.update_fields(nodes, isolated=True).where("doc_id = 'a'"))
    assert apart["word/document.xml"] == got["word/document.xml"] and apart["word/header2.xml"] == ["1", "1"] and apart["word/header10.xml"] == ["1"] and apart["word/footnotes.xml"] == ["1", "2"]


def test_values_and_nothing_to_do(spark):
    nodes = P.xml_nodes(spark.createDataFrame([("a", "word/document.xml", f"<w:document {NS}><w:body>{p('no field')}</w:body></w:document>".encode())], "doc_id string, part_path string, content binary"))
    assert U.sequence_values(nodes).count() == 0 and shown(U.update_fields(nodes)) == {}
