"""Edits of package trees: what is written parses again and holds what was asked for."""

import pytest
from pyspark.sql import functions as F

from quirespark.operators import document_edits as D
from quirespark.operators import tree as T
from quirespark.sources import package_tables as X
from quirespark.sources import packages as P

NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
DOC = f"""<w:document xmlns:w="{NS}" xmlns:r="{R}" xmlns:x="urn:own"><w:body><w:p><w:pPr><w:jc w:val="left"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>one &amp; &lt;two&gt;</w:t></w:r></w:p><w:p x:note="a &quot;b&quot;"><w:r><w:t xml:space="preserve"> second </w:t></w:r><w:r><w:t>run</w:t></w:r></w:p><!-- c --><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>d</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:ins w:id="1" w:author="ann"><w:r><w:t>new</w:t></w:r></w:ins><w:del w:id="2" w:author="bob"><w:r><w:delText>old</w:delText></w:r></w:del><w:r><w:rPr><w:i/><w:rPrChange w:id="3" w:author="bob"><w:rPr><w:b/></w:rPr></w:rPrChange></w:rPr><w:t>styled</w:t></w:r></w:p><w:sectPr><w:pgSz w:w="11906" w:h="16838"/></w:sectPr></w:body></w:document>"""
PARTS = {
    "word/document.xml": DOC,
    "word/comments.xml": f'<w:comments xmlns:w="{NS}"/>',
    "word/footnotes.xml": f'<w:footnotes xmlns:w="{NS}"/>',
    "word/styles.xml": f'<w:styles xmlns:w="{NS}"><w:style w:type="paragraph" w:styleId="A"><w:name w:val="heading 2"/></w:style><w:style w:type="paragraph" w:styleId="B"><w:name w:val="b"/><w:basedOn w:val="A"/></w:style><w:style w:styleId="C"><w:name w:val="c"/><w:basedOn w:val="D"/></w:style><w:style w:styleId="D"><w:name w:val="d"/><w:basedOn w:val="C"/></w:style></w:styles>',
    "word/settings.xml": f'<w:settings xmlns:w="{NS}"/>',
    "word/_rels/document.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="t/hyperlink" Target="http://x" TargetMode="External"/></Relationships>',
}
SCHEMA = "doc_id string, part_path string, content binary"


@pytest.fixture(scope="module")
def parts(spark):
    return spark.createDataFrame([("d", k, v.encode()) for k, v in PARTS.items()], SCHEMA).cache()


@pytest.fixture(scope="module")
def nodes(parts):
    return P.xml_nodes(parts).cache()


@pytest.fixture(scope="module")
def tree(nodes):
    return T.tree_of(nodes).cache()


def again(tree):
    return P.xml_nodes(T.part_bytes(tree)).cache()


def texts(nodes):
    return [r["text"] for r in P.paragraphs(nodes).orderBy("ord").collect()]


def paragraph(tree, n):
    return D.elements(tree, "w:p").where(F.col("ord") == n)


def test_written_parts_are_the_same_trees(nodes, tree):
    new = again(tree)
    was = {(r["part_path"], r["fingerprint"]) for r in P.fingerprints(nodes).collect()}
    assert {(r["part_path"], r["fingerprint"]) for r in P.fingerprints(new).collect()} == was and len(was) == len(PARTS)
    assert texts(new) == texts(nodes) == ["one & <two>", " second run", "a", "b", "c", "d", "newstyled"]
    assert "x:note" in {a["name"] for r in new.collect() for a in r["attrs"]}


def test_other_prefixes_are_the_same_names(spark, nodes):
    other = DOC.replace("w:", "q:").replace("xmlns:w=", "xmlns:q=")
    default = DOC.replace("<w:", "<").replace("</w:", "</").replace(f'xmlns:w="{NS}"', f'xmlns="{NS}" xmlns:k="{NS}"').replace(" w:", " k:")
    df = spark.createDataFrame([(k, "word/document.xml", v.encode()) for k, v in (("d", DOC), ("q", other), ("n", default))], SCHEMA)
    new = P.xml_nodes(df).cache()
    by = {}
    for r in P.paragraphs(new).orderBy("ord").collect():
        by.setdefault(r["doc_id"], []).append(r["text"])
    assert by["d"] == by["q"] == by["n"] and len(by["d"]) == 7
    assert len({r["fingerprint"] for r in P.fingerprints(new).collect()}) == 1
    assert len({r["fingerprint"] for r in P.fingerprints(again(T.tree_of(new))).collect()}) == 1
    moved = DOC.replace(NS, "urn:other")
    assert P.paragraphs(P.xml_nodes(spark.createDataFrame([("m", "word/document.xml", moved.encode())], SCHEMA))).count() == 7  # an unknown namespace keeps its prefix
    assert {r["ns_uri"] for r in new.where("local_name = 'p'").collect()} == {NS}


def test_insert_remove_move_wrap(tree):
    xml = lambda t: D.paragraph_xml(F.lit(t), F.lit("S"))
    edits = paragraph(tree, 0).select(*T.KEY, "path", F.lit("after").alias("where"), F.lit(1).alias("k"), xml("x & y").alias("xml"))
    edits = edits.unionByName(edits.withColumn("k", F.lit(2)).withColumn("xml", xml("z"))).unionByName(edits.withColumn("where", F.lit("before")).withColumn("xml", xml("first")))
    new = again(T.insert(tree, edits, ["k"]))
    assert texts(new)[:4] == ["first", "one & <two>", "x & y", "z"]
    tables = D.elements(tree, "w:tbl")
    assert texts(again(T.remove(tree, tables))) == ["one & <two>", " second run", "newstyled"]
    moves = paragraph(tree, 1).select(*T.KEY, "path").join(paragraph(tree, 0).select("doc_id", F.col("path").alias("to")), "doc_id").withColumn("where", F.lit("before"))
    assert texts(again(T.move(tree, moves, ["path"])))[:2] == [" second run", "one & <two>"]
    with pytest.raises(Exception, match="into itself"):
        T.move(tree, tables.select(*T.KEY, "path").join(paragraph(tree, 2).select("doc_id", F.col("path").alias("to")), "doc_id").withColumn("where", F.lit("first")), ["path"]).collect()
    runs = D.elements(tree, "w:r").where("ord = 0").select(*T.KEY, "path", F.lit("w:hyperlink").alias("name"), T.attribute_list(r_id=F.lit("rId1")).alias("attrs"))
    linked = again(T.wrap(tree, runs).unionByName(tree.limit(0)))
    assert [(r["text"], r["url"]) for r in X.hyperlinks(linked).collect()] == [("one & <two>", "http://x")]
    links = D.elements(T.tree_of(linked), "w:hyperlink")
    assert X.hyperlinks(again(T.unwrap(T.tree_of(linked), links))).count() == 0 and texts(again(T.unwrap(T.tree_of(linked), links))) == texts(linked)


def test_properties(tree):
    new = D.set_property(tree, "paragraph_style", paragraph(tree, 0).select(*T.KEY, "path", T.element("w:pStyle", w_val="B").alias("xml")))
    new = D.set_property(new, "paragraph_alignment", paragraph(tree, 0).unionByName(paragraph(tree, 1)).select(*T.KEY, "path", T.element("w:jc", w_val="center").alias("xml")))
    new = D.set_property(new, "run_bold", D.elements(tree, "w:r").where("ord < 2").select(*T.KEY, "path", F.when(F.col("ord") == 1, T.element("w:b")).alias("xml")))
    new = D.set_property(new, "page_margins", D.elements(tree, "w:sectPr").select(*T.KEY, "path", T.element("w:pgMar", w_top="1", w_left="2").alias("xml")))
    new = D.set_property(new, "track_changes", D.elements(tree, "w:settings", "word/settings.xml").select(*T.KEY, "path", T.element("w:trackRevisions").alias("xml")))
    new = D.turned(new, D.elements(tree, "w:sectPr"), True)
    got = again(new)
    assert [(r["style"], r["text"]) for r in P.paragraphs(got).orderBy("ord").limit(2).collect()] == [("B", "one & <two>"), (None, " second run")]
    assert [a["value"] for r in got.where("name = 'w:jc'").orderBy("node_id").collect() for a in r["attrs"]] == ["center", "center"]
    assert [(r["bold"], r["text"]) for r in P.runs(got).orderBy("node_id").limit(2).collect()] == [(None, "one & <two>"), (True, " second ")]
    s = X.sections(got).first()
    assert (s["width"], s["height"], s["landscape"], s["margins"]["top"], s["margins"]["left"]) == (16838, 11906, True, 1, 2)
    assert X.settings(got).first()["track_changes"]
    with pytest.raises(Exception, match="belongs to"):
        D.set_property(tree, "page_size", paragraph(tree, 0).select(*T.KEY, "path", T.element("w:pgSz").alias("xml"))).collect()


def test_attributes_and_text(tree):
    at = D.elements(tree, "w:pgSz").select(*T.KEY, "path")
    changes = at.select("*", F.lit("w:w").alias("name"), F.lit(None).cast("string").alias("value")).unionByName(at.select("*", F.lit("w:code").alias("name"), F.lit('"<9>"').alias("value")))
    got = again(T.set_attributes(tree, changes)).where("name = 'w:pgSz'").first()["attrs"]
    assert [(a["name"], a["value"]) for a in got] == [("w:h", "16838"), ("w:code", '"<9>"')]
    t = D.elements(tree, "w:t").where("ord = 0").select(*T.KEY, "path", F.lit("a < b").alias("text"))
    assert texts(again(T.set_text(tree, t)))[0] == "a < b"


def test_tables(tree):
    rows = D.elements(tree, "w:tr").where("ord = 0").select(*T.KEY, "path", F.lit(0).alias("low"), F.lit(1).alias("high"))
    assert [(r["row"], r["col"], r["grid_span"], r["text"]) for r in X.cells(again(D.merge_row_cells(tree, rows))).orderBy("row", "col").collect()] == [(0, 0, 2, "a"), (1, 0, 1, "c"), (1, 1, 1, "d")]
    down = D.elements(tree, "w:tbl").select(*T.KEY, "path", F.lit(1).alias("col"), F.lit(0).alias("low"), F.lit(1).alias("high"))
    assert [(r["row"], r["col"], r["v_merge"]) for r in X.cells(again(D.merge_column_cells(tree, down))).where("v_merge IS NOT NULL").orderBy("row").collect()] == [(0, 1, "restart"), (1, 1, "continue")]
    grid = F.array(F.array(F.lit("p"), F.lit("q")), F.array(F.lit("r"), F.lit("&")))
    new = again(T.insert(tree, paragraph(tree, 0).select(*T.KEY, "path", F.lit("before").alias("where"), D.table_xml(grid).alias("xml")), ["path"]))
    assert [(r["row"], r["col"], r["text"]) for r in X.cells(new).orderBy("table_id", "row", "col").limit(4).collect()] == [(0, 0, "p"), (0, 1, "q"), (1, 0, "r"), (1, 1, "&")]


def test_marks_comments_notes_links(tree):
    new = D.bookmark(tree, paragraph(tree, 1).select(*T.KEY, "path", F.lit(7).alias("id"), F.lit("here").alias("name")))
    new = D.comment(new, paragraph(tree, 1).select(*T.KEY, "path", F.lit(4).alias("id"), F.lit("ann").alias("author"), F.lit("why <so>").alias("text")))
    new = D.note(new, paragraph(tree, 0).select(*T.KEY, "path", F.lit(2).alias("id"), F.lit("see").alias("text")))
    new = D.relate(new, tree.select("doc_id").distinct().select("doc_id", F.lit("rId2").alias("r_id"), F.lit("t/hyperlink").alias("type"), F.lit("http://y?a&b").alias("target"), F.lit("External").alias("mode")))
    new = T.insert(new, paragraph(tree, 0).select(*T.KEY, "path", F.lit("last").alias("where"), F.lit(9).alias("id"), D.hyperlink_xml(F.lit("link"), r_id=F.lit("rId2")).alias("xml")), ["id"])
    got = again(new)
    assert [(r["id"], r["name"], r["paragraph_index"]) for r in X.bookmarks(got).collect()] == [(7, "here", 1)]
    assert [(r["id"], r["author"], r["text"]) for r in P.comments(got).collect()] == [(4, "ann", "why <so>")]
    assert [tuple(r)[1:] for r in X.comment_anchors(got).collect()] == [(4, 1)] and got.where("name = 'w:commentReference'").count() == 1
    assert [(r["id"], r["text"]) for r in X.notes(got).collect()] == [(2, "see")]
    assert [(r["text"], r["url"]) for r in X.hyperlinks(got).collect()] == [("link", "http://y?a&b")]
    with pytest.raises(Exception, match="there is a bookmark"):
        D.bookmark(T.tree_of(got), paragraph(tree, 0).select(*T.KEY, "path", F.lit(8).alias("id"), F.lit("here").alias("name"))).collect()
    one = lambda **k: tree.select("doc_id").distinct().select("doc_id", *(F.lit(v).alias(c) for c, v in k.items()))
    back = T.tree_of(got)
    back = D.delete_notes(D.delete_comments(D.delete_bookmarks(back, one(name="here")), one(id=4)), one(id=2))
    back = D.retarget(back, one(part_path="word/_rels/document.xml.rels", r_id="rId2", target="http://z"))
    left = again(back)
    assert X.bookmarks(left).count() + P.comments(left).count() + X.notes(left).count() + left.where("name LIKE 'w:comment%' AND name <> 'w:comments'").count() == 0
    assert [r["url"] for r in X.hyperlinks(left).collect()] == ["http://z"]


def test_revisions_settle(tree):
    assert texts(again(D.settle_revisions(tree, True)))[-1] == "newstyled" and texts(again(D.settle_revisions(tree, False)))[-1] == "oldstyled"
    kept = again(D.settle_revisions(tree, True))
    assert P.revisions(kept).count() == 0 and [r["italic"] for r in P.runs(kept).where("text = 'styled'").collect()] == [True]
    was = again(D.settle_revisions(tree, False))
    assert P.revisions(was).count() == 0 and [(r["italic"], r["bold"]) for r in P.runs(was).where("text = 'styled'").collect()] == [(None, True)]
    one = tree.select("doc_id").distinct().withColumn("id", F.lit(2))
    assert {(r["id"], r["kind"], r["text"]) for r in P.revisions(again(D.settle_revisions(tree, False, one))).collect()} == {(1, "insertion", "new"), (3, "formatting", "")}
    runs = D.elements(tree, "w:r").where("ord = 1").select(*T.KEY, "path", F.lit(11).alias("id"), F.lit("cy").alias("author"))
    gone = again(D.as_revision(tree, runs, "del"))
    assert texts(gone)[1] == "run" and texts(again(D.settle_revisions(T.tree_of(gone), False)))[1] == " second run"
    props = D.elements(tree, "w:r").where("ord = 0").select(*T.KEY, "path", F.lit(12).alias("id"), F.lit("cy").alias("author"), T.element("w:rPr", T.element("w:i")).alias("xml"))
    new = again(D.properties_as_revision(tree, props))
    assert [(r["italic"], r["bold"]) for r in P.runs(new).orderBy("node_id").limit(1).collect()] == [(True, None)]
    assert [(r["italic"], r["bold"]) for r in P.runs(again(D.settle_revisions(T.tree_of(new), False))).orderBy("node_id").limit(1).collect()] == [(None, True)]


def test_controls_and_fields(tree):
    put = lambda xml, k: paragraph(tree, 0).select(*T.KEY, "path", F.lit("after").alias("where"), F.lit(k).alias("k"), xml.alias("xml"))
    boxes = [D.control_xml(F.lit(5), F.lit("t"), "text", D.paragraph_xml(F.lit("held"))), D.dropdown_xml(F.lit(6), F.lit("u"), F.array(F.lit("a"), F.lit("b")), F.lit(1)), D.checkbox_xml(F.lit(7), F.lit("v"), F.lit(True)), D.repeating_xml(F.lit(8), F.array(F.lit("i"), F.lit("j")))]
    edits = put(boxes[0], 0)
    for k, xml in enumerate(boxes[1:], 1):
        edits = edits.unionByName(put(xml, k))
    new = again(T.insert(tree, edits, ["k"]))
    got = {r["id"]: (r["tag"], r["kind"], r["text"]) for r in X.controls(new).where("id IS NOT NULL").collect()}
    assert got == {5: ("t", "text", "held"), 6: ("u", "dropDownList", "b"), 7: ("v", "checkbox", "☒"), 8: (None, "repeatingSection", "")}
    ids = tree.select("doc_id").distinct().withColumn("id", F.lit(5))
    assert "held" in texts(again(D.delete_controls(T.tree_of(new), ids))) and "held" not in texts(again(D.delete_controls(T.tree_of(new), ids, keep_content=False)))
    changed = again(D.set_control_content(T.tree_of(new), ids.withColumn("xml", D.paragraph_xml(F.lit("changed")))))
    assert {r["text"] for r in X.controls(changed).where("id = 5").collect()} == {"changed"}
    with pytest.raises(Exception, match="may not stand"):
        D.set_control_content(T.tree_of(new), ids.withColumn("xml", F.lit("<w:sectPr/>"))).collect()
    field = again(T.insert(tree, paragraph(tree, 0).select(*T.KEY, "path", F.lit("last").alias("where"), D.field_xml(F.lit("SEQ Figure"), F.lit("3")).alias("xml")), ["path"]))
    assert [(r["code"], r["result"], r["closed"]) for r in X.fields(field).collect()] == [("SEQ Figure", "3", True)]


def test_headers_images_and_names(tree, parts):
    one = tree.select("doc_id").distinct()
    names = D.free_names(parts, r"^word/header(\d+)\.xml$", "word/header%d.xml")
    assert [tuple(r) for r in names.collect()] == [("d", "word/header1.xml")]
    head = D.new_part(names, D.header_xml(F.lit("top & more"), page_number=True))
    refs = D.elements(tree, "w:sectPr").select(*T.KEY, "path", F.lit("header").alias("place"), F.lit("first").alias("kind"), F.lit("rId9").alias("r_id"))
    new = D.refer_sections(tree, refs)
    size = T.insert(new, paragraph(tree, 0).select(*T.KEY, "path", F.lit("last").alias("where"), D.drawing_xml(F.lit("rId5"), F.lit(10), F.lit(20), F.lit("n"), F.lit("d")).alias("xml")), ["path"])
    size = D.relate(size, one.select("doc_id", F.lit("rId5").alias("r_id"), F.lit("t/image").alias("type"), F.lit("media/i.png").alias("target"), F.lit(None).cast("string").alias("mode")))
    got = P.xml_nodes(T.edited_parts(parts, size).unionByName(head)).cache()
    assert X.sections(got).first()["references"] == {"header/first": "rId9"}
    assert "top & more1" in "".join(r["text"] for r in got.where("part_path = 'word/header1.xml' AND kind = 'text'").orderBy("node_id").collect())
    pictures = lambda n: [(r["width_px"], r["height_px"]) for r in X.images(n, parts).collect()]
    assert pictures(got) == [(10, 20)]
    wide = D.resize_drawings(size, one.select("doc_id", F.lit("word/document.xml").alias("part_path"), F.lit("rId5").alias("r_id"), F.lit(30).alias("width_px"), F.lit(None).cast("int").alias("height_px")))
    assert pictures(again(wide)) == [(30, 20)]
    assert again(D.delete_drawings(size, one.select("doc_id", F.lit("word/document.xml").alias("part_path"), F.lit("rId5").alias("r_id")))).where("name = 'w:drawing'").count() == 0


def test_headings_and_semantics(spark, nodes, tree):
    from quirespark.operators.styles import heading_levels

    levels = heading_levels(P.styles(nodes))
    assert {(r["id"], r["level"]) for r in levels.collect()} == {("A", 2), ("B", 2), ("C", None), ("D", None)}
    style = D.set_property(tree, "paragraph_style", paragraph(tree, 0).select(*T.KEY, "path", T.element("w:pStyle", w_val="B").alias("xml")))
    listed = D.set_property(style, "paragraph_numbering", paragraph(tree, 1).select(*T.KEY, "path", D.numbering_xml(3, 1).alias("xml")))
    got = again(listed)
    bullets = spark.createDataFrame([("d", 3, True)], "doc_id string, num_id int, is_bullet boolean")
    rows = X.semantics(P.paragraphs(got), levels, bullets).orderBy("ord").limit(3).collect()
    assert [(r["kind"], r["level"]) for r in rows] == [("heading", 2), ("bulletListItem", 1), ("paragraph", None)]
    with pytest.raises(Exception, match="0 to 8"):
        D.set_property(tree, "paragraph_numbering", paragraph(tree, 1).select(*T.KEY, "path", D.numbering_xml(3, 9).alias("xml"))).collect()


def _one(spark, xml):
    """A tree of one part with this XML inside a document's root."""
    doc = f'<w:document xmlns:w="{NS}" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture">{xml}</w:document>'
    return T.tree_of(P.xml_nodes(spark.createDataFrame([("d", "word/document.xml", doc.encode())], SCHEMA)))


def test_every_property_has_its_place(spark):
    """For every property the children behind which it comes, and those before which, are those of its holder's sequence."""
    from quirespark.operators.sequence import later, sequence_of

    wanted, checks = {}, []
    for owner, holder, name in set(D.PROPERTIES.values()):
        order = sequence_of(holder or owner)
        assert name in order, (holder, owner, name)
        wanted[owner, holder, name] = order[order.index(name) + 1 :]
        checks.append(F.array_compact(F.array(*(F.when(later(holder or owner, name, F.lit(n)), n) for n in order))).alias(str(len(checks))))
    assert [list(x) for x in spark.range(1).select(*checks).first()] == list(wanted.values())


@pytest.mark.parametrize("prop, name", [("paragraph_style", "w:pStyle"), ("paragraph_alignment", "w:jc")])
def test_properties_stand_in_sequence(spark, prop, name):
    tree = _one(spark, "<w:p><w:pPr><w:keepNext/><w:ind/><w:outlineLvl/></w:pPr></w:p><w:p/>")
    tree = D.set_property(tree, prop, D.elements(tree, "w:p").select(*T.KEY, "path", T.element(name).alias("xml")))
    names = [r["name"] for r in tree.orderBy("path").collect()][3:]
    assert names == sorted(names[:4], key=["w:pStyle", "w:keepNext", "w:ind", "w:jc", "w:outlineLvl"].index) + ["w:p", "w:pPr", name]


def test_holders_stand_in_sequence(spark):
    """A holder that is made stands where the format has it: a cell's and a picture's properties before and behind the rest."""
    tree = _one(spark, "<w:tc><w:p/></w:tc><pic:pic><pic:blipFill/></pic:pic><w:tbl><w:tblGrid/></w:tbl>")
    for owner, prop, xml in (("w:tc", "cell_span", T.element("w:gridSpan", w_val="2")), ("pic:pic", "image_line", T.element("a:ln")), ("w:tbl", "table_indent", T.element("w:tblInd"))):
        tree = D.set_property(tree, prop, D.elements(tree, owner).select(*T.KEY, "path", xml.alias("xml")))
    names = [r["name"] for r in tree.orderBy("path").collect()]
    assert names == ["w:document", "w:tc", "w:tcPr", "w:gridSpan", "w:p", "pic:pic", "pic:blipFill", "pic:spPr", "a:ln", "w:tbl", "w:tblPr", "w:tblInd", "w:tblGrid"]


def test_many_inserts_at_one_place(spark, monkeypatch):
    """Each insert after the first node leaves a quarter of the gap; siblings get new numbers when it is used up, and no two share a path."""
    monkeypatch.setattr(T, "LEAST_GAP", 2.0**-3)
    tree = _one(spark, "<w:body><w:p/><w:p><w:r/></w:p><w:sectPr/></w:body>")
    for k in range(6):
        at = tree.where((F.col("name") == "w:p") & (F.size("path") == 3)).groupBy(*T.KEY).agg(F.min("path").alias("path"))
        tree = T.insert(tree, at.select(*T.KEY, "path", F.lit("after").alias("where"), T.element("w:p", w_n=str(k)).alias("xml")), ["path"])
    rows = tree.orderBy("path").collect()
    assert len({tuple(r["path"]) for r in rows}) == len(rows)
    assert [r["attrs"][0]["value"] for r in rows if r["attrs"] and r["attrs"][0]["name"] == "w:n"] == [str(k) for k in range(5, -1, -1)]
    assert [r["name"] for r in rows][-3:] == ["w:p", "w:r", "w:sectPr"]
    places = [r["path"][2] for r in rows if len(r["path"]) == 3]
    assert min(b - a for a, b in zip(places, places[1:], strict=False)) > 2.0**-5


def test_last_in_a_body_stands_before_its_section(spark):
    tree = _one(spark, "<w:body><w:p/><w:sectPr/></w:body>")
    body = tree.where("name = 'w:body'").select(*T.KEY, "path", F.lit("last").alias("where"))
    tree = T.insert(tree, body.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).withColumn("xml", T.element("w:tbl", w_n=F.col("k"))), ["k"])
    assert [r["name"] for r in tree.orderBy("path").collect()] == ["w:document", "w:body", "w:p", "w:tbl", "w:tbl", "w:sectPr"]


def test_rows_go_with_their_own_mark(spark):
    """A row marked as deleted goes when that is accepted, an inserted one when it is rejected; a table goes with its last row."""
    row = lambda text, mark="": f"<w:tr>{f'<w:trPr><w:{mark} w:id={chr(39)}1{chr(39)}/></w:trPr>' if mark else ''}<w:tc><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc></w:tr>"
    body = f"<w:tbl>{row('a')}{row('b', 'del')}{row('c', 'ins')}</w:tbl><w:p><w:r><w:t>between</w:t></w:r></w:p><w:tbl>{row('d', 'del')}</w:tbl>"
    xml = f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'.encode()
    tree = T.tree_of(P.xml_nodes(spark.createDataFrame([("x", "word/document.xml", xml)], "doc_id string, part_path string, content binary"))).cache()
    accepted, rejected = T.part_bytes(D.settle_revisions(tree, True)).first(), T.part_bytes(D.settle_revisions(tree, False)).first()
    shown = lambda part: bytes(part["content"]).decode()
    assert [t for t in "abcd" if f">{t}<" in shown(accepted)] == ["a", "c"] and shown(accepted).count("<w:tbl>") == 1
    assert [t for t in "abcd" if f">{t}<" in shown(rejected)] == ["a", "b", "d"] and "w:ins" not in shown(rejected) and "w:del" not in shown(rejected)
