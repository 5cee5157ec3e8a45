"""Text that runs through runs, against slicing of strings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quirespark.operators import document_edits as D
from quirespark.operators import inline as I
from quirespark.operators import tree as T
from quirespark.sources import packages as P

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
SCHEMA = "doc_id string, part_path string, content binary"


def run(text, mark=None):
    """A run of pieces: tabs are elements, and the text is in two w:t where it has a bar."""
    inner = "".join("<w:tab/>" if x == "\t" else f'<w:t xml:space="preserve">{x}</w:t>' for x in re.split("(\t)|\\|", text) if x)
    return f'<w:r><w:rPr><w:{mark}/></w:rPr>{inner}</w:r>' if mark else f"<w:r>{inner}</w:r>"


def tree_of(spark, **docs):
    rows = [(d, "word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>".encode()) for d, body in docs.items()]
    return T.tree_of(P.xml_nodes(spark.createDataFrame(rows, SCHEMA))).cache()


def seen(tree):
    """{doc: [(name of the wrapper, mark, text) of each run in order]}, read from the written bytes; deleted text too."""
    out = {}
    for r in T.part_bytes(tree).collect():
        xml = bytes(r["content"]).decode()
        stack, rows = [], []
        for m in re.finditer(r"<(/?)([\w:]+)([^>]*?)(/?)>|([^<]+)", xml[xml.index("<w:body>") :]):
            close, name, _, empty, text = m.groups()
            if text is not None:
                if stack[-1] in ("w:t", "w:delText"):
                    rows[-1][2] += text
                continue
            if close:
                stack = stack[:-1]
                continue
            if name == "w:r":
                rows.append([next((x for x in reversed(stack) if x not in ("w:sdtContent",)), None), None, ""])
            if stack and stack[-1] == "w:rPr":
                rows[-1][1] = name
            if name == "w:tab":
                rows[-1][2] += "\t"
            if not empty:
                stack.append(name)
        out[r["doc_id"]] = [tuple(x) for x in rows]
    return out


def test_replacement_over_runs(spark):
    """Needles over two and three runs; the first run's formatting is kept, links and controls are texts of their own."""
    link = f'<w:hyperlink r:id="rId1">{run("see need", "u")}{run("le here")}</w:hyperlink>'
    control = f"<w:sdt><w:sdtPr/><w:sdtContent>{run('a needle')}</w:sdtContent></w:sdt>"
    gone = "<w:del w:id='1'><w:r><w:delText>needle</w:delText></w:r></w:del>"
    tree = tree_of(spark, a=f"<w:p>{run('x nee', 'b')}{run('d', 'i')}{run('le y needle z')}</w:p><w:p>{link}{run('nee')}{control}{run('dle')}{gone}</w:p>", b=f"<w:p>{run('n|eed|le need', 'b')}{run(chr(9))}{run('le')}</w:p>")
    got = seen(I.replace_in_runs(tree, "needle", "$pin"))
    assert got["a"] == [("w:p", "w:b", "x $pin"), ("w:p", "w:i", ""), ("w:p", None, " y $pin z"), ("w:hyperlink", "w:u", "see $pin"), ("w:hyperlink", None, " here"), ("w:p", None, "$pin"), ("w:sdt", None, "a $pin"), ("w:p", None, ""), ("w:del", None, "needle")]
    assert got["b"] == [("w:p", "w:b", "$pin need"), ("w:p", None, "\t"), ("w:p", None, "le")]
    got = seen(I.replace_in_runs(tree, "(N)(eed)\\s*(le)", "$3-$1", regex=True, match_case=False))
    assert got["b"] == [("w:p", "w:b", "le-n le-n"), ("w:p", None, ""), ("w:p", None, "")]
    assert seen(I.replace_in_runs(tree, "", "x")) == seen(tree) == seen(I.replace_in_runs(tree, "absent", "x"))
    with pytest.raises(ValueError, match="empty text"):
        I.replace_in_runs(tree, "x*", "y", regex=True)


def test_random_replacements_equal_strings(spark):
    rng = random.Random(3)
    docs, flats = {}, {}
    for k in range(30):
        texts = ["".join(rng.choice("ab <&é") for _ in range(rng.randrange(7))) for _ in range(rng.randrange(1, 6))]
        docs[f"d{k}"] = "<w:p>" + "".join(run(t.replace("&", "&amp;").replace("<", "&lt;"), rng.choice(["b", None])) for t in texts) + "</w:p>"
        flats[f"d{k}"] = "".join(texts)
    tree = tree_of(spark, **docs)
    for find, new in (("ab", "X"), ("a", ""), ("<&", "a<b"), (" ", "__")):
        rows = P.paragraphs(P.xml_nodes(T.part_bytes(I.replace_in_runs(tree, find, new)))).collect()
        assert {r["doc_id"]: r["text"] for r in rows} == {d: t.replace(find, new) for d, t in flats.items()}


def changes(spark, tree, rows, columns):
    """Rows (doc, nth paragraph, ...) with the paragraph's path as the surface."""
    at = D.elements(tree, "w:p").select(*T.KEY, F.col("path").alias("surface"), "ord")
    return spark.createDataFrame(rows, f"doc_id string, ord int, {columns}").join(at, ["doc_id", "ord"]).drop("ord").withColumn("date", F.lit("2024-01-01T00:00:00Z"))


def test_splits_keep_properties_and_what_is_no_text(spark):
    tree = tree_of(spark, a=f"<w:p><w:r><w:rPr><w:b/></w:rPr><w:drawing/><w:t>abc</w:t><w:fldChar/><w:t>de</w:t><w:tab/></w:r>{run('tail')}</w:p>")
    path = tree.where("name = 'w:r'").orderBy("path").first()["path"]
    cuts = spark.createDataFrame([("a", "word/document.xml", path, n) for n in (0, 1, 3, 4, 6, 99)], "doc_id string, part_path string, path array<double>, at int")
    rows = I.split_runs(tree, cuts).where(F.size("path") > 3).orderBy("path").collect()
    shape = "".join({"w:r": "\n", "w:rPr": "{", "w:b": "}", "w:t": "", "w:drawing": "D", "w:fldChar": "F", "w:tab": "T"}.get(r["name"], "") if r["kind"] == "element" else r["text"] for r in rows)
    assert shape == "\n{}Da\n{}bcF\n{}d\n{}eT\ntail"


def test_deleted_inserted_and_moved_text(spark):
    """Offsets inside runs: both halves keep their properties; accepting and rejecting give what slicing of strings gives."""
    body = f"<w:p>{run('Hello ', 'b')}{run('wide', 'i')}{run(' world')}</w:p><w:p>{run('second')}</w:p><w:p/>"
    tree = tree_of(spark, a=body, b=body)
    deleted = I.delete_text(tree, changes(spark, tree, [("a", 0, 3, 8, 7, "ann"), ("b", 1, 2, 2, 8, "bob")], "start int, end int, id int, author string"))
    got = seen(deleted)
    assert got["a"][:5] == [("w:p", "w:b", "Hel"), ("w:del", "w:b", "lo "), ("w:del", "w:i", "wi"), ("w:p", "w:i", "de"), ("w:p", None, " world")] and got["b"][3:] == [("w:p", None, "se"), ("w:p", None, "cond")]
    assert deleted.where("name = 'w:del' AND doc_id = 'a'").count() == 1
    inserted = I.insert_text(tree, changes(spark, tree, [("a", 0, 8, "NEW <", 3, "ann"), ("a", 1, 0, "at first ", 4, "ann"), ("b", 1, 6, " last", 5, "ann"), ("b", 2, 0, "alone", 6, "ann")], "position int, text string, id int, author string"))
    got = seen(inserted)
    assert got["a"] == [("w:p", "w:b", "Hello "), ("w:p", "w:i", "wi"), ("w:ins", None, "NEW &lt;"), ("w:p", "w:i", "de"), ("w:p", None, " world"), ("w:ins", None, "at first "), ("w:p", None, "second")]
    assert got["b"][3:] == [("w:p", None, "second"), ("w:ins", None, " last"), ("w:ins", None, "alone")]
    texts = lambda t: {(r["doc_id"], r["ord"]): r["text"] for r in P.paragraphs(P.xml_nodes(T.part_bytes(t))).collect()}
    was = {("a", 0): "Hello wide world", ("a", 1): "second", ("a", 2): "", ("b", 0): "Hello wide world", ("b", 1): "second", ("b", 2): ""}
    assert texts(D.settle_revisions(deleted, True)) == was | {("a", 0): "Helde world"} and texts(D.settle_revisions(deleted, False)) == was
    assert texts(D.settle_revisions(inserted, True)) == was | {("a", 0): "Hello wiNEW <de world", ("a", 1): "at first second", ("b", 1): "second last", ("b", 2): "alone"}
    assert texts(D.settle_revisions(inserted, False)) == was


def test_moves_and_errors(spark):
    body = f"<w:p>{run('one ', 'b')}{run('two three')}</w:p><w:p>{run('goal')}</w:p>"
    tree = tree_of(spark, a=body)
    at = D.elements(tree, "w:p").select(*T.KEY, F.col("path").alias("to"), F.col("ord").alias("_o"))
    moves = changes(spark, tree, [("a", 0, 2, 7, 2, 10, "ann")], "start int, end int, position int, id int, author string").join(at.where("_o = 1").drop("_o"), T.KEY)
    got = I.move_text(tree, moves)
    assert seen(got)["a"] == [("w:p", "w:b", "on"), ("w:moveFrom", "w:b", "e "), ("w:moveFrom", None, "two"), ("w:p", None, " three"), ("w:p", None, "go"), ("w:moveTo", None, "e two"), ("w:p", None, "al")]
    with pytest.raises(Exception, match="not in its text"):
        I.delete_text(tree, changes(spark, tree, [("a", 0, 3, 99, 7, "ann")], "start int, end int, id int, author string")).collect()
    with pytest.raises(Exception, match="inside its own"):
        I.move_text(tree, moves.withColumn("to", F.col("surface"))).collect()
