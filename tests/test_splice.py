"""The writer that keeps bytes: an edit changes its own range, however oddly the rest is written."""

import pytest
from pyspark.sql import functions as F

from quirespark.operators import document_edits as D
from quirespark.operators import splice
from quirespark.operators import tree as T
from quirespark.sources import packages as P

NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
HEAD = f"<?xml version='1.0'?>\r\n<!-- first --><x:document   xmlns:x='{NS}' xmlns:o=\"urn:o\"><x:body >"
ONE = "<x:p  x:rsidR = '1'><x:r><x:t>a &#38; <![CDATA[<b>]]></x:t></x:r></x:p>"
TWO = "<x:p><x:pPr><x:b></x:b></x:pPr><x:r ><x:t>two</x:t ></x:r></x:p>"
SAME = "<x:p><x:r><x:t>é</x:t></x:r></x:p>"
TAIL = "<x:sectPr /></x:body></x:document >\n<?end?>"
DOC = HEAD + ONE + "\n  " + TWO + SAME + "<!-- c -->" + SAME + TAIL


@pytest.fixture(scope="module")
def parts(spark):
    return spark.createDataFrame([("d", "word/document.xml", DOC.encode()), ("e", "word/document.xml", DOC.encode())], "doc_id string, part_path string, content binary").cache()


@pytest.fixture(scope="module")
def nodes(parts):
    return P.xml_nodes(parts).cache()


def written(parts, nodes, tree):
    return {r["doc_id"]: bytes(r["content"]).decode() for r in splice.spliced(parts, nodes, tree).collect()}


def test_no_edit_changes_nothing(parts, nodes):
    assert written(parts, nodes, T.tree_of(nodes)) == {"d": DOC, "e": DOC}


def test_an_edit_changes_its_own_range(parts, nodes):
    tree = T.tree_of(nodes)
    second = D.elements(tree, "w:t").where("ord = 1 AND doc_id = 'd'").withColumn("text", F.lit("new <"))
    got = written(parts, nodes, T.set_text(tree, second))
    assert got["e"] == DOC
    assert got["d"] == HEAD + ONE + "\n  " + TWO.replace("<x:t>two</x:t >", "<x:t>new &lt;</x:t>") + SAME + "<!-- c -->" + SAME + TAIL.replace("</x:document >", "</x:document>")


def test_moved_and_removed_subtrees_keep_their_bytes(parts, nodes):
    tree = T.tree_of(nodes)
    at = D.elements(tree, "w:p").where("doc_id = 'd'")
    last = at.where("ord = 3").select(*T.KEY, "path").join(at.where("ord = 0").select("doc_id", F.col("path").alias("to")), "doc_id").withColumn("where", F.lit("before"))
    moved = written(parts, nodes, T.move(tree, last, ["path"]))["d"]
    assert moved == HEAD + SAME + ONE + "\n  " + TWO + SAME + "<!-- c -->" + TAIL.replace("</x:document >", "</x:document>")
    gone = written(parts, nodes, T.remove(tree, at.where("ord = 1")))["d"]
    assert gone == HEAD + ONE + "\n  " + SAME + "<!-- c -->" + SAME + TAIL.replace("</x:document >", "</x:document>")


def test_new_elements_and_new_parts(parts, nodes):
    tree = T.tree_of(nodes)
    at = D.elements(tree, "w:p").where("ord = 1 AND doc_id = 'd'").select(*T.KEY, "path", F.lit("after").alias("where"), T.element("w:p", w_rsidP="9").alias("xml"))
    tree = T.insert(tree, at, ["path"])
    other = tree.where("doc_id = 'e'").withColumn("part_path", F.lit("word/new.xml"))
    got = {(r["doc_id"], r["part_path"]): bytes(r["content"]).decode() for r in splice.spliced(parts, nodes, tree.unionByName(other)).collect()}
    document = got["d", "word/document.xml"]
    declared = HEAD.replace("<x:body >", "").rstrip(">") + f' xmlns:w="{NS}"><x:body >'
    assert document.startswith(declared + ONE + "\n  " + TWO + '<w:p w:rsidP="9"/>' + SAME) and document.endswith(SAME + "<!-- c -->" + SAME + TAIL.replace("</x:document >", "</x:document>"))
    assert got["e", "word/document.xml"] == DOC and got["e", "word/new.xml"].startswith(T.DECLARATION)
    again = P.paragraphs(P.xml_nodes(parts.limit(0).unionByName(parts.sparkSession.createDataFrame([("d", "word/document.xml", document.encode())], parts.schema))))
    assert [r["text"] for r in again.orderBy("ord").collect()] == ["a & <b>", "two", "", "é", "é"]
