"""Typed tables of a package made here."""

import pytest
from pyspark.sql import functions as F

from quirespark.sources import package_tables as T
from quirespark.sources import packages as P

W = 'xmlns:w="w" xmlns:r="r" xmlns:a="a" xmlns:wp="wp" xmlns:w14="w14" xmlns:w15="w15"'
DOC = f"""<w:document {W}><w:body>
<w:p><w:bookmarkStart w:id="1" w:name="top"/><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="2"/></w:numPr></w:pPr><w:hyperlink r:id="rId1"><w:r><w:t>site</w:t></w:r></w:hyperlink></w:p>
<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc></w:tr>
<w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:bookmarkStart w:id="2" w:name="cell"/><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
<w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> SEQ Figure \\* ARABIC \\s 1 </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>4</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r>
<w:fldSimple w:instr=" REF top \\h "><w:r><w:t>see</w:t></w:r></w:fldSimple><w:hyperlink w:anchor="top"><w:r><w:t>up</w:t></w:r></w:hyperlink></w:p>
<w:p><w:bookmarkStart w:id="3" w:name="late"/><w:sdt><w:sdtPr><w:id w:val="9"/><w:tag w:val="t"/><w:text/></w:sdtPr><w:sdtContent><w:r><w:t>held</w:t></w:r></w:sdtContent></w:sdt><w:r><w:drawing><wp:inline><wp:extent cx="952500" cy="19050"/><a:blip r:embed="rId2"/></wp:inline></w:drawing></w:r></w:p>
<w:sectPr><w:pgSz w:w="16838" w:h="11906" w:orient="landscape"/><w:cols w:num="2"/></w:sectPr></w:body></w:document>"""
PARTS = {
    "word/document.xml": DOC,
    "word/_rels/document.xml.rels": '<Relationships><Relationship Id="rId1" Type="t/hyperlink" Target="http://x" TargetMode="External"/><Relationship Id="rId2" Type="t/image" Target="media/a.png"/><Relationship Id="rId3" Type="t/image" Target="media/b.png"/></Relationships>',
    "word/media/a.png": "png",
    "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="5"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="bullet"/><w:lvlText w:val="o"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="2"><w:abstractNumId w:val="5"/></w:num><w:num w:numId="3"><w:abstractNumId w:val="6"/></w:num></w:numbering>',
    "word/footnotes.xml": f'<w:footnotes {W}><w:footnote w:id="0"/><w:footnote w:id="1"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>',
    "docProps/core.xml": '<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:title>T</dc:title><dc:creator>ann</dc:creator></cp:coreProperties>',
    "word/comments.xml": f'<w:comments {W}><w:comment w:id="1"><w:p w14:paraId="A"/></w:comment><w:comment w:id="2"><w:p w14:paraId="B"/><w:p w14:paraId="C"/></w:comment></w:comments>',
    "word/commentsExtended.xml": f'<w15:commentsEx {W}><w15:commentEx w15:paraId="A" w15:done="1"/><w15:commentEx w15:paraId="C" w15:paraIdParent="A" w15:done="0"/></w15:commentsEx>',
}


@pytest.fixture(scope="module")
def parts(spark):
    return spark.createDataFrame([("d", k, v.encode()) for k, v in PARTS.items()], "doc_id string, part_path string, content binary")


@pytest.fixture(scope="module")
def nodes(parts):
    return P.xml_nodes(parts).cache()


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_numbering(nodes):
    num, levels = T.numbering(nodes)
    assert rows(num, "num_id", "abstract_num_id") == {(2, 5), (3, 6)}
    assert rows(levels, "abstract_num_id", "ilvl", "num_fmt", "lvl_text", "start") == {(5, 0, "bullet", "o", 1), (5, 1, "decimal", None, None)}
    assert rows(T.bullet_lists(num, levels), "num_id", "is_bullet") == {(2, True), (3, False)}
    assert rows(T.unused_numbering(nodes, num), "num_id") == {(3,)}


def test_links_and_marks(nodes):
    assert rows(T.hyperlinks(nodes), "ord", "text", "url", "anchor", "kind") == {(0, "site", "http://x", None, "external"), (1, "up", None, "top", "internal")}
    assert rows(T.bookmarks(nodes), "name", "paragraph_index") == {("top", 0), ("late", 2)}


def test_sections_controls_notes_properties(nodes):
    assert rows(T.sections(nodes), "width", "height", "landscape", "columns") == {(16838, 11906, True, 2)}
    assert rows(T.controls(nodes), "id", "tag", "kind", "text") == {(9, "t", "text", "held")}
    assert rows(T.notes(nodes), "kind", "id", "text") == {("footnote", 1, "note")}
    assert rows(T.core_properties(nodes), "name", "value") == {("title", "T"), ("creator", "ann")}


def test_threads(nodes):
    assert rows(T.comment_threads(nodes), "id", "parent_id", "done") == {(1, None, True), (2, 1, False)}


def test_images(nodes, parts):
    assert rows(T.images(nodes, parts), "r_id", "width_px", "height_px") == {("rId2", 100, 2), ("rId3", 0, 0)}


def test_fields(nodes):
    got = T.fields(nodes).select("code", "result", "form", T.parsed_code(F.col("code")).alias("p"))
    assert {(r["form"], r["result"], *r["p"]) for r in got.collect()} == {("spread", "4", "SEQ", "Figure", "ARABIC", 1), ("simple", "see", "REF", "top", None, None)}


def test_cells(nodes):
    assert rows(T.cells(nodes), "row", "col", "grid_span", "v_merge", "text") == {(0, 0, 2, None, "wide"), (1, 0, 1, "restart", "a"), (1, 1, 1, None, "b")}


NESTED = f"""<w:document {W}><w:body><w:p><w:r><w:t>before </w:t></w:r><w:r><w:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent></w:r><w:r><w:t>after</w:t></w:r>
<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>SEQ A</w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>1</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>in</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>z</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
<w:sdt><w:sdtPr><w:id w:val="1"/></w:sdtPr><w:sdtContent><w:r><w:t>x</w:t></w:r><w:sdt><w:sdtPr><w:id w:val="2"/></w:sdtPr><w:sdtContent><w:r><w:t>y</w:t></w:r></w:sdtContent></w:sdt><w:r><w:t>z</w:t></w:r></w:sdtContent></w:sdt></w:body></w:document>"""


def test_elements_inside_their_own_kind(spark):
    n = P.xml_nodes(spark.createDataFrame([("d", "word/document.xml", NESTED.encode())], "doc_id string, part_path string, content binary")).cache()
    assert [r["text"] for r in P.paragraphs(n).orderBy("ord").collect()] == ["before after1", "box", "a", "in", "z", "b", "c"]
    texts = F.regexp_replace("text", r"\s", "").alias("text")
    assert rows(T.cells(n).select("row", "col", "nest_depth", texts), "row", "col", "nest_depth", "text") == {(0, 0, 0, "az"), (0, 0, 1, "in"), (0, 1, 0, "b"), (1, 0, 0, "c")}
    assert rows(T.controls(n).select("id", texts), "id", "text") == {(1, "xz"), (2, "y")}
    assert rows(T.fields(n), "code", "result") == {("SEQ A", "1")}
