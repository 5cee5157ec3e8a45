"""Formulas copied between documents, and text replaced beside them."""

import pytest
from pyspark.sql import functions as F

from quirespark.operators import formula_splice as S
from quirespark.operators import formulas as M
from quirespark.operators import tree as T
from quirespark.sources import packages as P

PART = "word/document.xml"
NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:mm="http://schemas.openxmlformats.org/officeDocument/2006/math"'
PAIRS = "id int, doc_id string, part_path string, path array<double>, source_doc string, source_part string, source_path array<double>"


def t(text, mark=""):
    return f'<w:r><w:rPr>{mark}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'


def math(text, m="m"):
    return f"<{m}:oMath><{m}:r><{m}:t>{text}</{m}:t></{m}:r></{m}:oMath>"


def nodes_of(spark, **docs):
    rows = [(d, PART, f"<w:document {NS}><w:body>{body}</w:body></w:document>".encode()) for d, body in docs.items()]
    return P.xml_nodes(spark.createDataFrame(rows, "doc_id string, part_path string, content binary"))


def p(n):
    return [0.0, 0.0, float(n)]


def shown(tree):
    """{doc: display texts of its paragraphs}, read from the written bytes."""
    out = {}
    for r in M.display_texts(P.xml_nodes(T.part_bytes(tree))).orderBy("doc_id", "node_id").collect():
        out.setdefault(r["doc_id"], []).append(r["text"])
    return out


def bodies(tree):
    return {r["doc_id"]: bytes(r["content"]).decode().partition("<w:body>")[2].partition("</w:body>")[0] for r in T.part_bytes(tree).collect()}


def splices(spark, *rows):
    """(path, index, where, anchor, instance) from paragraph 0 of document a into b."""
    return spark.createDataFrame([(k, "b", PART, p(to), "a", PART, p(0), index, where, anchor, n) for k, (to, index, where, anchor, n) in enumerate(rows)], f"{PAIRS}, index int, where string, anchor string, instance int")


SOURCE = f"<w:p>{t('one ')}{math('x')}{t('two ')}<w:r><w:rPr><w:b/><w:color w:val='FF0000'/></w:rPr>{math('y')}</w:r></w:p>"


def test_places(spark):
    target = f"<w:p><w:pPr><w:jc w:val='left'/></w:pPr>{t('ab', '<w:i/>')}{t('cabd')}</w:p><w:p/>"
    tree = T.tree_of(nodes_of(spark, a=SOURCE, b=target)).cache()
    after = S.splice(tree, splices(spark, (0, 0, "start", None, None), (0, 1, "end", None, None), (0, 0, "after", "bc", 1), (0, 1, "before", "ab", 2), (0, 1, "after", "a", 1), (0, 0, "after", "a", 1), (1, 0, "start", None, None)))
    assert shown(after) == {"a": ["one xtwo y"], "b": ["xa" + "yx" + "bc" + "xy" + "abdy", "x"]}
    assert bodies(after)["b"].startswith('<w:p><w:pPr><w:jc w:val="left"/></w:pPr><m:oMath>')
    assert bodies(after)["a"] == bodies(tree)["a"]


def test_ids_are_a_paragraphs_own(spark):
    """Equal ids in different paragraphs and documents mix nothing up."""
    tree = T.tree_of(nodes_of(spark, a=SOURCE, b=f"<w:p>{t('a')}</w:p><w:p>{t('a')}</w:p>", c=f"<w:p>{t('a')}</w:p>")).cache()
    rows = splices(spark, (0, 0, "after", "a", 1), (1, 1, "after", "a", 1), (0, 1, "before", "a", 1)).withColumn("doc_id", F.when(F.col("id") == 2, "c").otherwise("b")).withColumn("id", F.lit(0))
    after = shown(S.splice(tree, rows))
    assert after["b"] == ["ax", "ay"] and after["c"] == ["ya"]


def test_properties_of_the_run(spark):
    tree = T.tree_of(nodes_of(spark, a=SOURCE, b="<w:p/>")).cache()
    held = {mode: bodies(S.splice(tree, splices(spark, (0, 1, "end", None, None)), mode))["b"] for mode in ("all", "formula", "none")}
    assert '<w:rPr><w:b/><w:color w:val="FF0000"/></w:rPr><m:oMath>' in held["all"]
    assert "<w:rPr><w:b/></w:rPr><m:oMath>" in held["formula"]
    assert "rPr" not in held["none"] and "<m:t>y</m:t>" in held["none"]


@pytest.mark.parametrize(("row", "message"), [((0, 2, "end", None, None), "no formula 2"), ((0, 0, "after", "zz", 1), "not found: zz"), ((0, 0, "after", "b", 2), "not found: b"), ((7, 0, "end", None, None), "no paragraph"), ((0, 0, "beside", None, None), "no such place")])
def test_errors(spark, row, message):
    tree = T.tree_of(nodes_of(spark, a=SOURCE, b=f"<w:p>{t('b')}</w:p>"))
    with pytest.raises(Exception, match=message):
        S.splice(tree, splices(spark, row))


def test_all_formulas_of_a_paragraph_by_their_context(spark):
    nodes = nodes_of(spark, a=SOURCE + f"<w:p>{math('z', 'mm')}{t('tail')}</w:p>", b=f"<w:p>{t('It is one ')}{t('or two things')}</w:p><w:p>{t('t')}</w:p>").cache()
    pairs = spark.createDataFrame([(0, "b", PART, p(0), "a", PART, p(0)), (1, "b", PART, p(1), "a", PART, p(1))], PAIRS)
    tree = T.tree_of(nodes)
    with pytest.raises(Exception, match="not found"):  # what stands before y is "one two ", which the target has not
        S.splice(tree, S.contexts(tree, pairs))
    nodes = nodes_of(spark, a=SOURCE + f"<w:p>{math('z', 'mm')}{t('tail')}</w:p>", b=f"<w:p>{t('Say one ')}{t('two things')}</w:p><w:p>{t('t')}</w:p>").cache()
    tree = T.tree_of(nodes)
    assert shown(S.splice(tree, S.contexts(tree, pairs)))["b"] == ["Say one xtwo ythings", "tz"]
    assert [(r["id"], r["source_prefix"], r["target_prefix"]) for r in S.prefixes_differ(nodes, pairs).collect()] == [(1, "mm", "m")]


def test_replacement_beside_formulas(spark):
    body = f"<w:p>{t('a needle, need')}{math('le')}{t(' and nee', '<w:b/>')}{t('dle ')}<w:r>{math('needle')}</w:r>{t('needle')}</w:p><w:p>{math('ne')}{t('edle')}</w:p>"
    tree, refused = S.replace_beside_formulas(nodes_of(spark, d=body), "needle", "pin")
    assert shown(tree) == {"d": ["a pin, needle and pin needlepin", "needle"]}
    assert {tuple(r["surface"]): r["n"] for r in refused.collect()} == {tuple(p(0)): 2, tuple(p(1)): 1}


def both(spark, rows, properties="all", **docs):
    """What stands in the bodies and what is read, by splices of node tables and of parts."""
    parts = spark.createDataFrame([(d, PART, f"<w:document {NS}><w:body>{body}</w:body></w:document>".encode()) for d, body in docs.items()] + [("b", "word/media/i.png", b"\x89")], "doc_id string, part_path string, content binary")
    of_nodes = S.splice(T.tree_of(P.xml_nodes(parts)), rows, properties)
    out = S.splice_parts(parts, rows, properties)
    assert out.where("part_path LIKE '%png'").collect()[0].content == b"\x89" and out.count() == len(docs) + 1
    again = T.tree_of(P.xml_nodes(out))
    texts = {}
    for r in M.texts_of_parts(out).orderBy("doc_id", "ord").collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    return bodies(of_nodes), bodies(again), shown(of_nodes), texts, {r.doc_id: bytes(r.content).decode() for r in out.where("part_path LIKE '%xml'").collect()}


def test_parts_are_spliced_as_node_tables_are(spark):
    atoms = "<w:p><w:r><w:rPr><w:i/></w:rPr><w:t>ab</w:t><w:tab/><w:t/><w:drawing/><w:t>cab</w:t><w:br/></w:r><w:ins><w:r><w:t>abc</w:t></w:r></w:ins><w:hyperlink><w:r><w:t>ab</w:t></w:r></w:hyperlink><w:r><w:t> ab</w:t></w:r></w:p>"
    target = f"<w:p><w:pPr><w:jc w:val='left'/></w:pPr>{t('ab', '<w:i/>')}{t('cabd')}</w:p><w:p/>{atoms}"
    rows = splices(
        spark, (0, 0, "start", None, None), (0, 1, "end", None, None), (0, 0, "after", "bc", 1), (0, 1, "before", "ab", 2), (0, 1, "after", "a", 1), (0, 0, "after", "a", 1), (1, 0, "start", None, None), (1, 1, "end", None, 1),
        (2, 0, "before", "ab", 1), (2, 1, "after", "ab\t", 1), (2, 0, "before", "cab", 1), (2, 1, "after", "cab\n", 1), (2, 0, "before", "c ab", 1), (2, 1, "after", " ab", 1), (2, 0, "after", "b", 3), (2, 1, "start", None, None),
    )
    for properties in ("all", "formula", "none"):
        nodes, parts, read, texts, content = both(spark, rows, properties, a=SOURCE, b=target, c=SOURCE)
        assert parts == nodes and texts == read
        assert content["c"] == content["a"] == f"<w:document {NS}><w:body>{SOURCE}</w:body></w:document>"


@pytest.mark.parametrize(("row", "message"), [((0, 2, "end", None, None), "no formula 2"), ((0, 0, "after", "zz", 1), "not found: zz"), ((0, 0, "after", "b", 2), "not found: b"), ((7, 0, "end", None, None), "no paragraph"), ((0, 0, "beside", None, None), "no such place")])
def test_errors_of_parts(spark, row, message):
    parts = spark.createDataFrame([(d, PART, f"<w:document {NS}><w:body>{body}</w:body></w:document>".encode()) for d, body in (("a", SOURCE), ("b", f"<w:p>{t('b')}</w:p>"))], "doc_id string, part_path string, content binary")
    with pytest.raises(Exception, match=message):
        S.splice_parts(parts, splices(spark, row)).collect()
    with pytest.raises(Exception, match="no formula"):
        S.splice_parts(parts.where("doc_id = 'b'"), splices(spark, (0, 0, "end", None, None))).collect()


def test_a_part_in_another_encoding(spark):
    """What comes into it may have characters that its encoding lacks."""
    xml = f'<?xml version="1.0" encoding="ISO-8859-1"?><w:document {NS}><w:body><w:p>{t("é")}</w:p></w:body></w:document>'
    source = f"<w:document {NS}><w:body><w:p>{math('∑')}</w:p></w:body></w:document>"
    parts = spark.createDataFrame([("a", PART, source.encode()), ("b", PART, xml.encode("latin-1")), ("c", PART, xml.encode("latin-1"))], "doc_id string, part_path string, content binary")
    got = {r.doc_id: bytes(r.content) for r in S.splice_parts(parts, splices(spark, (0, 0, "after", "é", 1))).collect()}
    assert got["c"] == xml.encode("latin-1")
    assert got["b"].decode() == xml.replace("ISO-8859-1", "UTF-8").replace("</w:r></w:p>", f"</w:r>{math('∑')}</w:p>")
