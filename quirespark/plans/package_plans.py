"""Queries over packages: parts are written as XML from the customer table, parsed into nodes, and read, edited and written by the package operators.

Document d holds the customers d * 50 to d * 50 + 49, a paragraph each, and a table of four cells after every tenth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import document_edits as D
from ..operators import field_update as U
from ..operators import inline as I
from ..operators import reduction as R
from ..operators import reverse as V
from ..operators import tree as T
from ..operators.styles import chains, heading_levels
from ..sources import package_tables as X
from ..sources import generations as G
from ..sources import packages as P
from ..sources import snapshots as N
from ..sources.scratch import scratch_path, stored
from ..sources.tables import table

DOC_ROWS = 50
_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" xmlns:w15="http://schemas.microsoft.com/office/word/2012/wordml"'
_STYLES = "".join(
    f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{n}"/>{b}</w:style>'
    for i, n, b in (("AUTOMOBILE", "heading 2", ""), ("BUILDING", "plain", '<w:basedOn w:val="AUTOMOBILE"/>'), ("FURNITURE", "other", '<w:basedOn w:val="BUILDING"/>'), ("HOUSEHOLD", "list", '<w:basedOn w:val="Missing"/>'))
)
# %1$s is the customer's number, %2$s the name, %3$s the market segment, %4$s the nation, %5$s 1 where the account is above 5000
_PARAGRAPH = [
    ("true", '<w:p w14:paraId="P%1$s"><w:pPr><w:pStyle w:val="%3$s"/>'),
    ("c % 4 = 0", '<w:numPr><w:ilvl w:val="1"/><w:numId w:val="%4$s"/></w:numPr>'),
    ("true", '</w:pPr><w:bookmarkStart w:id="%1$s" w:name="b%1$s"/>'),
    ("c % 13 = 0", '<w:commentRangeStart w:id="%1$s"/>'),
    ("true", '<w:r><w:rPr><w:b w:val="%5$s"/><w:sz w:val="24"/></w:rPr><w:t>%2$s</w:t></w:r>'),
    ("c % 7 = 0", '<w:ins w:id="%1$s" w:author="%3$s"><w:r><w:t> added</w:t></w:r></w:ins>'),
    ("c % 11 = 0", '<w:del w:id="%1$s9" w:author="%3$s"><w:r><w:delText> gone</w:delText></w:r></w:del>'),
    ("c % 5 = 0", '<w:hyperlink r:id="rId%1$s"><w:r><w:t> link</w:t></w:r></w:hyperlink>'),
    ("c % 3 = 0", '<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> SEQ Figure \\* ARABIC </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>%1$s</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r>'),
    ("c % 17 = 0", '<w:r><w:footnoteReference w:id="%1$s"/></w:r>'),
    ("c % 13 = 0", '<w:commentRangeEnd w:id="%1$s"/>'),
    ("true", '<w:bookmarkEnd w:id="%1$s"/></w:p>'),
    ("c % 10 = 9", '<w:tbl><w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>%1$s</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>%3$s</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t>%4$s</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'),
]


def package_parts(spark, sf_dir) -> DataFrame:
    """(doc_id, part_path, content) of a package for every DOC_ROWS customers."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), "c_name", "c_mktsegment", "c_nationkey", (F.col("c_acctbal") > 5000).cast("int").alias("rich"), F.floor(F.col("c_custkey") / DOC_ROWS).alias("d"))
    args = [F.col(x).cast("string") for x in ("c", "c_name", "c_mktsegment", "c_nationkey", "rich")]
    made = lambda template: F.format_string(template, *args)
    pieces = F.concat(*(F.when(F.expr(when), made(xml)).otherwise("") for when, xml in _PARAGRAPH))
    group = lambda when, xml: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.expr(when), F.struct("c", made(xml).alias("x"))))), lambda s: s["x"]), "")
    docs = c.withColumn("x", pieces).groupBy("d").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "x"))), lambda s: s["x"]), "").alias("body"),
        group("c % 5 = 0", '<Relationship Id="rId%1$s" Type="t/hyperlink" Target="http://site/%1$s" TargetMode="External"/>').alias("rels"),
        group("c % 13 = 0", '<w:comment w:id="%1$s" w:author="%3$s" w:date="2024-01-02T03:04:05Z"><w:p w14:paraId="C%1$s"><w:r><w:t>about %2$s</w:t></w:r></w:p></w:comment>').alias("comments"),
        group("c % 13 = 0", '<w15:commentEx w15:paraId="C%1$s" w15:done="%5$s"/>').alias("threads"),
        group("c % 17 = 0", '<w:footnote w:id="%1$s"><w:p><w:r><w:t>note %1$s</w:t></w:r></w:p></w:footnote>').alias("notes"),
    )
    n = table(spark, sf_dir, "nation")
    numbers = n.agg(
        F.array_join(F.transform(F.array_sort(F.collect_set("n_regionkey")), lambda r: F.format_string('<w:abstractNum w:abstractNumId="%1$s"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="%2$s"/><w:lvlText w:val="%%1."/></w:lvl></w:abstractNum>', r.cast("string"), F.when(r % 2 == 0, "bullet").otherwise("decimal"))), "").alias("abstract"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_regionkey"))), lambda s: F.format_string('<w:num w:numId="%1$s"><w:abstractNumId w:val="%2$s"/></w:num>', s["n_nationkey"].cast("string"), s["n_regionkey"].cast("string"))), "").alias("nums"),
    )  # one row: the nations
    docs = docs.join(F.broadcast(numbers))
    part = lambda path, open_, body, close: F.struct(F.lit(path).alias("p"), F.concat(F.lit(open_), body, F.lit(close)).alias("x"))
    size = F.format_string('<w:sectPr><w:pgSz w:w="%d" w:h="9000"/></w:sectPr>', F.col("d") + 10000)
    parts = F.array(
        part("word/document.xml", f"<w:document {_NS}><w:body>", F.concat("body", size), "</w:body></w:document>"),
        part("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">', F.col("rels"), "</Relationships>"),
        part("word/comments.xml", f"<w:comments {_NS}>", F.col("comments"), "</w:comments>"),
        part("word/commentsExtended.xml", f"<w15:commentsEx {_NS}>", F.col("threads"), "</w15:commentsEx>"),
        part("word/footnotes.xml", f'<w:footnotes {_NS}><w:footnote w:id="0"/>', F.col("notes"), "</w:footnotes>"),
        part("word/numbering.xml", f"<w:numbering {_NS}>", F.concat("abstract", "nums"), "</w:numbering>"),
        part("word/styles.xml", f"<w:styles {_NS}>", F.lit(_STYLES), "</w:styles>"),
        part("word/settings.xml", f"<w:settings {_NS}>", F.when(F.col("d") % 2 == 0, "<w:trackRevisions/>").otherwise(""), "</w:settings>"),
        part("docProps/core.xml", '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/">', F.format_string("<dc:title>Document %d</dc:title>", "d"), "</cp:coreProperties>"),
    )
    return docs.select(F.col("d").cast("string").alias("doc_id"), F.explode(parts).alias("s")).select("doc_id", F.col("s.p").alias("part_path"), F.encode("s.x", "UTF-8").alias("content"))


def nodes_of(spark, sf_dir, *parts: str, columns=None, within=None) -> DataFrame:
    """The nodes of these parts, or of all: written, as most queries read them more than once. columns, within: what the query reads of them, see `xml_nodes`."""
    made = package_parts(spark, sf_dir)
    return stored(P.xml_nodes(made.where(F.col("part_path").isin(*parts)) if parts else made, True, columns, within), "nodes")


def tree_rows(spark, sf_dir) -> DataFrame:
    """The trees of the bodies, written."""
    return T.tree_of(nodes_of(spark, sf_dir, DOC, columns=T.TREE))


DOC, RELS, STYLES, NUMBERS = "word/document.xml", "word/_rels/document.xml.rels", "word/styles.xml", "word/numbering.xml"


def package_paragraphs(spark, sf_dir):
    return P.paragraphs(nodes_of(spark, sf_dir, DOC)).select("doc_id", F.col("ord").cast("long").alias("ord"), "in_table", "style", "num_id", "ilvl", "para_id", "text")


def package_runs(spark, sf_dir):
    return P.runs(nodes_of(spark, sf_dir, DOC)).select("doc_id", F.col("run_idx").cast("long").alias("run_idx"), "text", "bold", "size_half_points", F.col("revision_id").cast("long").alias("revision_id"), "revision")


def package_styles(spark, sf_dir):
    return P.styles(nodes_of(spark, sf_dir, STYLES)).select("doc_id", "id", "name", "type", "based_on")


def package_style_chain(spark, sf_dir):
    s = P.styles(nodes_of(spark, sf_dir, STYLES)).select("doc_id", "id", F.col("based_on").alias("parent"))
    return chains(s, ["doc_id"])


def package_semantics(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir, DOC, STYLES, NUMBERS, columns=P.READ, within=(*P.OF_PARAGRAPHS, "w:style", "w:num", "w:abstractNum", "w:lvl"))
    rows = X.semantics(P.paragraphs(nodes), heading_levels(P.styles(nodes)), X.bullet_lists(*X.numbering(nodes)))
    return rows.groupBy("doc_id", "kind", "level").agg(F.count("*").alias("n"))


def package_relationships(spark, sf_dir):
    return P.relationships(nodes_of(spark, sf_dir, RELS)).select("doc_id", "part", "r_id", "type", "target", "mode")


def package_hyperlinks(spark, sf_dir):
    return X.hyperlinks(nodes_of(spark, sf_dir, DOC, RELS)).select("doc_id", F.col("ord").cast("long").alias("ord"), "r_id", "text", "url", "kind")


def package_bookmarks(spark, sf_dir):
    return X.bookmarks(nodes_of(spark, sf_dir, DOC)).select("doc_id", F.col("id").cast("long").alias("id"), "name", F.col("paragraph_index").cast("long").alias("paragraph_index"))


def package_comments(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir, DOC, "word/comments.xml", "word/commentsExtended.xml")
    return P.comments(nodes).join(X.comment_anchors(nodes), ["doc_id", "id"]).join(X.comment_threads(nodes).select("doc_id", "id", "done"), ["doc_id", "id"]).select("doc_id", F.col("id").cast("long").alias("id"), "author", "text", F.col("paragraph_index").cast("long").alias("paragraph_index"), "done")


def package_revisions(spark, sf_dir):
    return P.revisions(nodes_of(spark, sf_dir, DOC, columns=P.READ, within=P.OF_REVISIONS)).select("doc_id", F.col("id").cast("long").alias("id"), "kind", "author", "text", F.col("paragraph_index").cast("long").alias("paragraph_index"))


def package_bullets(spark, sf_dir):
    return X.bullet_lists(*X.numbering(nodes_of(spark, sf_dir, NUMBERS)))


def package_unused_numbering(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir, DOC, NUMBERS)
    return X.unused_numbering(nodes, X.numbering(nodes)[0])


def package_sections(spark, sf_dir):
    return X.sections(nodes_of(spark, sf_dir, DOC)).select("doc_id", "width", "height", "landscape", "columns", "break_type")


def package_notes(spark, sf_dir):
    return X.notes(nodes_of(spark, sf_dir, "word/footnotes.xml")).withColumn("id", F.col("id").cast("long"))


def package_fields(spark, sf_dir):
    f = X.fields(nodes_of(spark, sf_dir, DOC, columns=P.READ, within=("w:fldSimple", "w:instrText", "w:t")))
    return f.withColumn("p", X.parsed_code(F.col("code"))).select("doc_id", "code", "result", "form", "closed", "depth", F.col("p.kind").alias("kind"), F.col("p.argument").alias("argument"), F.col("p.format").alias("format"))


def package_cells(spark, sf_dir):
    cells = X.cells(nodes_of(spark, sf_dir, DOC))
    nth = F.dense_rank().over(P.Window.partitionBy("doc_id").orderBy("table_id")) - 1
    return cells.select("doc_id", nth.cast("long").alias("table_no"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "v_merge", "nest_depth", "text")


def package_properties(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir, "docProps/core.xml", "word/settings.xml")
    title = X.core_properties(nodes).where("name = 'title'").select("doc_id", F.col("value").alias("title"))
    return title.join(X.settings(nodes), "doc_id").select("doc_id", "title", "track_changes")


def package_round_trip(spark, sf_dir):
    """Every part parsed, written, parsed again: the same tree."""
    read = (*T.TREE, "node_id", "depth", "local_name", "ns_uri")
    nodes = nodes_of(spark, sf_dir, columns=read)
    new = P.fingerprints(P.xml_nodes(T.part_bytes(T.tree_of(nodes)), True, read)).withColumnRenamed("fingerprint", "new")
    return P.fingerprints(nodes).join(new, ["doc_id", "part_path"], "full_outer").groupBy("part_path").agg(F.count("*").alias("parts"), F.count_if(F.col("fingerprint") == F.col("new")).alias("same"))


def _after(tree: DataFrame) -> DataFrame:
    return P.paragraphs(P.xml_nodes(T.part_bytes(tree), True, P.READ, P.OF_PARAGRAPHS))


def package_accept(spark, sf_dir):
    tree = D.settle_revisions(tree_rows(spark, sf_dir), True)
    return _after(tree).select("doc_id", F.col("ord").cast("long").alias("ord"), "para_id", "text")


def package_reject(spark, sf_dir):
    tree = D.settle_revisions(tree_rows(spark, sf_dir), False)
    return _after(tree).select("doc_id", F.col("ord").cast("long").alias("ord"), "para_id", "text")


def package_set_style(spark, sf_dir):
    """Every third paragraph of a body gets another style, every fourth none."""
    tree = tree_rows(spark, sf_dir)
    at = D.elements(tree, "w:p", depth=3)
    style = F.when(F.col("ord") % 3 == 0, T.element("w:pStyle", w_val=F.concat(F.lit("S"), "ord")))
    tree = D.set_property(tree, "paragraph_style", at.where("ord % 3 = 0 OR ord % 4 = 0").select(*T.KEY, "path", style.alias("xml")))
    return _after(tree).select("doc_id", F.col("ord").cast("long").alias("ord"), "para_id", "style")


def package_insert(spark, sf_dir):
    """A paragraph and a table after every fifth paragraph of a body."""
    tree = tree_rows(spark, sf_dir)
    at = D.elements(tree, "w:p", depth=3).where("ord % 5 = 0").select(*T.KEY, "path", F.lit("after").alias("where"), "ord")
    new = F.array(F.struct(F.lit(0).alias("k"), D.paragraph_xml(F.concat(F.lit("after "), "ord")).alias("xml")), F.struct(F.lit(1).alias("k"), D.table_xml(F.array(F.array(F.lit("x"), F.lit("y")))).alias("xml")))
    tree = T.insert(tree, at.select("*", F.explode(new).alias("n")).select(*T.KEY, "path", "where", "n.k", "n.xml"), ["k"])
    rows = _after(tree)
    return rows.where("para_id IS NULL").select("doc_id", F.col("ord").cast("long").alias("ord"), "in_table", "text")


def package_delete_table(spark, sf_dir):
    tree = tree_rows(spark, sf_dir)
    tree = T.remove(tree, D.elements(tree, "w:tbl").where("ord % 2 = 0"))
    return _after(tree).groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.count_if("in_table").alias("in_tables"))


def package_move(spark, sf_dir):
    """Each body's last paragraph comes first."""
    tree = tree_rows(spark, sf_dir)
    at = D.elements(tree, "w:p", depth=3)
    ends = at.groupBy(*T.KEY).agg(F.max_by("path", "ord").alias("path"), F.min_by("path", "ord").alias("to")).withColumn("where", F.lit("before"))
    return _after(T.move(tree, ends, ["path"])).select("doc_id", F.col("ord").cast("long").alias("ord"), "para_id")


def package_delete_marks(spark, sf_dir):
    """Bookmarks of every other customer, all comments and all footnotes go."""
    nodes = nodes_of(spark, sf_dir, DOC, "word/comments.xml", "word/footnotes.xml", columns=(*P.READ, "path"), within=("w:p", "w:tbl", "w:comment", "w:footnote", "w:endnote", "w:t"))
    tree = T.tree_of(nodes)
    tree = D.delete_bookmarks(tree, X.bookmarks(nodes).where("id % 2 = 0"))
    tree = D.delete_notes(D.delete_comments(tree, P.comments(nodes)), X.notes(nodes))
    left = P.xml_nodes(T.part_bytes(tree), True, ("doc_id", "kind", "name")).where("kind = 'element'")
    names = "name IN ('w:bookmarkStart', 'w:bookmarkEnd', 'w:comment', 'w:commentRangeStart', 'w:commentRangeEnd', 'w:footnote', 'w:footnoteReference')"
    return left.where(names).groupBy("doc_id", "name").agg(F.count("*").alias("n"))


def package_replace(spark, sf_dir):
    """A pattern that begins in a paragraph's first run and ends in the one after it, an insertion: all paragraphs, and the text of their first run."""
    tree = tree_rows(spark, sf_dir)
    nodes = stored(P.xml_nodes(T.part_bytes(I.replace_in_runs(tree, r"0(\d) a", "X$1Y", regex=True)), True, P.READ, {*P.OF_PARAGRAPHS, *P.OF_RUNS}), "nodes")
    first = P.runs(nodes).where("run_idx = 0").select("doc_id", F.col("paragraph_id").alias("node_id"), F.col("text").alias("first_run"))
    return P.paragraphs(nodes).join(first, ["doc_id", "node_id"], "left").select("doc_id", F.col("ord").cast("long").alias("ord"), "para_id", "text", "first_run")


def _tracked(nodes: DataFrame) -> DataFrame:
    marks = P.revisions(nodes).where("id >= 100000000").select("doc_id", F.col("paragraph_index").alias("ord"), F.col("kind"), F.col("text").alias("changed"))
    return P.paragraphs(nodes).join(marks, ["doc_id", "ord"], "left").select("doc_id", F.col("ord").cast("long").alias("ord"), "para_id", "text", "kind", "changed")


def _spots(tree: DataFrame, rest: int) -> DataFrame:
    """The paragraphs of customers whose number leaves this rest by 4, as surfaces, with a revision's id, author and date."""
    at = D.elements(tree, "w:p", depth=3).withColumn("c", F.substring(D.value_of("w14:paraId"), 2, 20).cast("int")).where(F.col("c") % 4 == rest)
    return at.select(*T.KEY, F.col("path").alias("surface"), "c", (F.col("c") + 100_000_000).alias("id"), F.lit("ann").alias("author"), F.lit("2024-01-02T03:04:05Z").alias("date"))


def package_delete_revision(spark, sf_dir):
    """Characters 3 to 8 of every fourth paragraph, inside its first run, are deleted as a tracked change."""
    tree = tree_rows(spark, sf_dir)
    tree = I.delete_text(tree, _spots(tree, 1).withColumns({"start": F.lit(3), "end": F.lit(8)}))
    return _tracked(stored(P.xml_nodes(T.part_bytes(tree), True, P.READ, {*P.OF_PARAGRAPHS, *P.OF_REVISIONS}), "nodes"))


def package_insert_revision(spark, sf_dir):
    """Text comes into every fourth paragraph after its fifth character, inside its first run, as a tracked change."""
    tree = tree_rows(spark, sf_dir)
    tree = I.insert_text(tree, _spots(tree, 2).withColumns({"position": F.lit(5), "text": F.concat(F.lit("<"), F.col("c").cast("string"), F.lit(">"))}))
    return _tracked(stored(P.xml_nodes(T.part_bytes(tree), True, P.READ, {*P.OF_PARAGRAPHS, *P.OF_REVISIONS}), "nodes"))


def package_update_fields(spark, sf_dir):
    """The figures of every document numbered from 1 in the fields' results: all paragraphs."""
    tree = U.update_fields(nodes_of(spark, sf_dir, DOC, "word/footnotes.xml", columns=(*P.READ, "path"), within=("w:fldSimple", "w:instrText", "w:t")))
    return _after(tree).select("doc_id", F.col("ord").cast("long").alias("ord"), "para_id", "text")


def package_page_setup(spark, sf_dir):
    tree = tree_rows(spark, sf_dir)
    at = D.elements(tree, "w:sectPr")
    tree = D.set_property(tree, "page_margins", at.select(*T.KEY, "path", T.element("w:pgMar", w_top="700", w_left="800").alias("xml")))
    tree = D.turned(tree, at.where("doc_id % 3 = 0"), False)
    rows = X.sections(P.xml_nodes(T.part_bytes(tree), True, P.READ, ("w:sectPr",)))
    return rows.select("doc_id", "width", "height", "landscape", F.col("margins.top").alias("top"), F.col("margins.left").alias("left"))


def package_log(spark, sf_dir) -> DataFrame:
    """A log of an operation a customer on the packages: texts, styles, paragraphs beside others that came before, removals, runs, undo."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), (F.col("c_custkey") % 10).alias("m"))
    at = lambda prefix, back=0: F.concat(F.lit(prefix), (F.col("c") - back).cast("string"))
    ops = {
        0: ("insertRun", {"in": at("w14:paraId=P"), "position": F.lit(0), "run": F.struct(at("R").alias("text"))}),
        1: ("setText", {"target": at("w14:paraId=P"), "text": at("T")}),
        2: ("insertParagraphAfter", {"after": at("w14:paraId=P"), "paragraph": F.struct(at("new").alias("text"), at("N").alias("paraId"), F.lit("NS").alias("styleId"))}),
        3: ("removeParagraph", {"id": at("w14:paraId=P")}),
        4: ("setParagraphStyle", {"target": at("w14:paraId=P"), "styleId": F.concat(F.lit("ST"), (F.col("c") % 7).cast("string"))}),
        5: ("insertParagraphBefore", {"before": at("w14:paraId=N", 3), "paragraph": F.struct(at("before").alias("text"), at("M").alias("paraId"))}),
        6: ("setText", {"target": at("w14:paraId=N", 4), "text": at("edited")}),
        7: ("appendParagraph", {"in": F.lit(None).cast("string"), "paragraph": F.struct(at("end").alias("text"), at("E").alias("paraId"))}),
        8: ("undo", {"targetOpID": at("op", 7)}),
        9: ("updateAttribute", {"target": at("w14:paraId=P"), "prefix": F.lit("w14"), "localName": F.lit("textId"), "value": at("A")}),
    }
    kind, payload = F.lit(None).cast("string"), F.lit(None).cast("string")
    for m, (name, fields) in ops.items():
        kind = F.when(F.col("m") == m, name).otherwise(kind)
        payload = F.when(F.col("m") == m, F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))).otherwise(payload)
    return c.select(F.floor(F.col("c") / DOC_ROWS).cast("string").alias("doc_id"), F.col("c").alias("seq"), at("op").alias("op_id"), kind.alias("op_type"), F.parse_json(payload).alias("payload"))


def operation_tree(spark, sf_dir):
    """The packages after their logs: all paragraphs, read from the bytes of the parts."""
    parts = R.materialised_parts(package_parts(spark, sf_dir).where(F.col("part_path") == DOC), package_log(spark, sf_dir))
    return P.paragraphs(P.xml_nodes(parts, columns=P.READ, within=P.OF_PARAGRAPHS)).select("doc_id", F.col("ord").cast("long").alias("ord"), "in_table", "style", "para_id", "text")


_LEAN = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml"'


def package_reversed(spark, sf_dir):
    """Packages of one part turned into logs and these replayed on nothing: what comes back, and how many operations say it. Every second document has a tab, which no operation says, in its first paragraph."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), "c_name", "c_mktsegment", F.floor(F.col("c_custkey") / DOC_ROWS).alias("d"))
    tab = F.when((F.col("d") % 2 == 1) & (F.col("c") % DOC_ROWS == 0), "<w:r><w:tab/></w:r>").otherwise("")
    xml = F.format_string('<w:p w14:paraId="P%s"><w:pPr><w:pStyle w:val="%s"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>%s</w:t></w:r>%s</w:p>', F.col("c").cast("string"), F.col("c_mktsegment"), F.col("c_name"), tab)
    body = c.withColumn("x", xml).groupBy("d").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "x"))), lambda s: s["x"]), "").alias("body"))
    parts = stored(body.select(F.col("d").cast("string").alias("doc_id"), F.lit(DOC).alias("part_path"), F.encode(F.concat(F.lit(f"<w:document {_LEAN}><w:body>"), "body", F.lit("</w:body></w:document>")), "UTF-8").alias("content")), "parts")
    log = stored(V.reversed_log(parts), "log")
    back = R.materialised_parts(V.skeleton(parts), log).select("doc_id", F.sha2("content", 256).alias("sha256"))
    share = V.typed_share(parts, log)
    return back.join(share.hint("merge"), "doc_id").select("doc_id", "sha256", (F.col("typed_bytes") == F.col("bytes")).alias("typed"), "operations")


def package_snapshots(spark, sf_dir):
    """Every third package changes after it was saved: one part of it, and all of its log's later half is still to come."""
    parts = package_parts(spark, sf_dir).where(F.col("part_path").isin(DOC, STYLES, "docProps/core.xml"))
    log = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / DOC_ROWS).cast("string").alias("doc_id"), F.col("c_custkey").alias("seq"), F.col("c_custkey").cast("string").alias("op_id"), F.when(F.col("c_custkey") % 2 == 0, "swift").otherwise("word").alias("source"))
    saved = stored(N.snapshots(parts, P.xml_nodes(parts), log.where(f"seq % {DOC_ROWS} < 20"), "2024-01-01 00:00:00"), "snapshots")
    later = parts.withColumn("content", F.when((F.col("doc_id").cast("int") % 3 == 0) & (F.col("part_path") == STYLES), F.lit(b"<x/>")).otherwise(F.col("content")))
    return N.checked(saved, later, log).select("doc_id", "state", F.array_join("changed", ",").alias("changed"), "tail")


def package_commits(spark, sf_dir):
    """Three writers have read the first commit of all packages: one changes every third, one others, and the last is refused as it changes the first one's. Then all is compacted."""
    parts = package_parts(spark, sf_dir).where(F.col("part_path").isin("docProps/core.xml", STYLES))
    log = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / DOC_ROWS).cast("string").alias("doc_id"), F.col("c_custkey").alias("seq"), F.col("c_custkey").cast("string").alias("op_id"), F.lit("swift").alias("source"))
    parts, log = stored(parts, "parts"), stored(log, "log")
    root, at = scratch_path(spark, "packages"), "2024-01-01 00:00:00"
    first = G.commit(spark, root, parts, log.where(f"seq % {DOC_ROWS} < 10"), 0, at)
    refused = 0
    for nth in (0, 1, 0):
        mine = F.col("doc_id").cast("int") % 3 == nth
        changed = parts.where(mine & (F.col("part_path") == STYLES) if nth else mine)
        try:
            G.commit(spark, root, changed, log.where(mine), first, at)
        except G.Conflict:
            refused += 1
    G.compact(spark, root, at)
    old, new = G.read(spark, root, 2), G.read(spark, root)
    counts = new["parts"].groupBy("doc_id").agg(F.count("*").alias("parts")).join(new["snapshots"].select("doc_id", F.col("op_count").alias("operations"), F.size("pending").cast("long").alias("pending")), "doc_id")
    return counts.join(old["documents"].select("doc_id", F.col("commit").alias("second")), "doc_id").join(new["documents"], "doc_id").select("doc_id", "second", "commit", "parts", "operations", "pending", F.lit(refused).cast("long").alias("refused"))


QUERIES = {
    f.__name__: f
    for f in (
        package_commits, operation_tree, package_update_fields, package_reversed, package_replace, package_delete_revision, package_insert_revision, package_snapshots, package_paragraphs, package_runs, package_styles, package_style_chain, package_semantics, package_relationships, package_hyperlinks, package_bookmarks, package_comments, package_revisions, package_bullets, package_unused_numbering,
        package_sections, package_notes, package_fields, package_cells, package_properties, package_round_trip, package_accept, package_reject, package_set_style, package_insert, package_delete_table, package_move, package_delete_marks, package_page_setup,
    )
}

_C = "(SELECT c_custkey AS c, c_name, c_mktsegment AS seg, c_nationkey AS nk, c_acctbal > 5000 AS rich, CAST(c_custkey // 50 AS VARCHAR) AS d, c_custkey % 50 AS k FROM customer)"
_TEXT = "c_name || CASE WHEN c % 7 = 0 THEN ' added' ELSE '' END || CASE WHEN c % 5 = 0 THEN ' link' ELSE '' END || CASE WHEN c % 3 = 0 THEN CAST(c AS VARCHAR) ELSE '' END"
_OLD = "c_name || CASE WHEN c % 11 = 0 THEN ' gone' ELSE '' END || CASE WHEN c % 5 = 0 THEN ' link' ELSE '' END || CASE WHEN c % 3 = 0 THEN CAST(c AS VARCHAR) ELSE '' END"
_TABLE_CELLS = f"(SELECT d, k // 10 AS t, r, x, CASE WHEN x = 0 AND r = 0 THEN CAST(c AS VARCHAR) WHEN x = 0 THEN '' WHEN r = 0 THEN seg ELSE CAST(nk AS VARCHAR) END AS text FROM {_C}, (SELECT unnest([0, 1]) AS r) a, (SELECT unnest([0, 1]) AS x) b WHERE c % 10 = 9)"
_CHAINS = "(VALUES ('AUTOMOBILE', 0, 'AUTOMOBILE'), ('BUILDING', 1, 'AUTOMOBILE'), ('FURNITURE', 2, 'AUTOMOBILE'), ('HOUSEHOLD', 0, 'HOUSEHOLD')) v(id, depth, root)"
_AFTER = "CASE WHEN c % 5 = 0 THEN ' link' ELSE '' END || CASE WHEN c % 3 = 0 THEN CAST(c AS VARCHAR) ELSE '' END"
_ADDED = "CASE WHEN c % 7 = 0 THEN ' added' ELSE '' END"
SQL = {
    "package_update_fields": f"""
        SELECT d AS doc_id, k + 4 * (k // 10) AS ord, 'P' || c AS para_id, c_name || {_ADDED} || CASE WHEN c % 5 = 0 THEN ' link' ELSE '' END || CASE WHEN c % 3 = 0 THEN CAST(sum(CASE WHEN c % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY c) AS VARCHAR) ELSE '' END AS text FROM {_C}
        UNION ALL SELECT d, 14 * t + 10 + 2 * r + x, NULL, text FROM {_TABLE_CELLS}""",
    "package_reversed": f"""
        SELECT d AS doc_id, sha256('<w:document {_LEAN}><w:body>' || string_agg('<w:p w14:paraId="P' || c || '"><w:pPr><w:pStyle w:val="' || seg || '"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>' || c_name || '</w:t></w:r>'
                   || CASE WHEN CAST(d AS INT) % 2 = 1 AND k = 0 THEN '<w:r><w:tab/></w:r>' ELSE '' END || '</w:p>', '' ORDER BY c) || '</w:body></w:document>') AS sha256,
               CAST(d AS INT) % 2 = 0 AS typed, CASE WHEN CAST(d AS INT) % 2 = 0 THEN 2 + 2 * count(*) ELSE 1 END AS operations FROM {_C} GROUP BY d""",
    "package_replace": rf"""
        SELECT d AS doc_id, k + 4 * (k // 10) AS ord, 'P' || c AS para_id, regexp_replace(c_name || {_ADDED}, '0(\d) a', 'X\1Y') || {_AFTER} AS text, CASE WHEN c % 7 = 0 THEN regexp_replace(c_name, '0(\d)$', 'X\1Y') ELSE c_name END AS first_run FROM {_C}
        UNION ALL SELECT d, 14 * t + 10 + 2 * r + x, NULL, text, CASE WHEN r = 1 AND x = 0 THEN NULL ELSE text END FROM {_TABLE_CELLS}""",
    "package_delete_revision": f"""
        SELECT d AS doc_id, k + 4 * (k // 10) AS ord, 'P' || c AS para_id, CASE WHEN c % 4 = 1 THEN left(c_name, 3) || substr(c_name, 9) ELSE c_name END || {_ADDED} || {_AFTER} AS text,
               CASE WHEN c % 4 = 1 THEN 'deletion' END AS kind, CASE WHEN c % 4 = 1 THEN substr(c_name, 4, 5) END AS changed FROM {_C}
        UNION ALL SELECT d, 14 * t + 10 + 2 * r + x, NULL, text, NULL, NULL FROM {_TABLE_CELLS}""",
    "package_insert_revision": f"""
        SELECT d AS doc_id, k + 4 * (k // 10) AS ord, 'P' || c AS para_id, CASE WHEN c % 4 = 2 THEN left(c_name, 5) || '<' || c || '>' || substr(c_name, 6) ELSE c_name END || {_ADDED} || {_AFTER} AS text,
               CASE WHEN c % 4 = 2 THEN 'insertion' END AS kind, CASE WHEN c % 4 = 2 THEN '<' || c || '>' END AS changed FROM {_C}
        UNION ALL SELECT d, 14 * t + 10 + 2 * r + x, NULL, text, NULL, NULL FROM {_TABLE_CELLS}""",
    "operation_tree": f"""
        WITH n AS (SELECT *, c % 10 AS m FROM {_C}), top AS (SELECT max(c) AS last FROM n),
        r AS (SELECT d, 0 AS z, c, 0 AS g, false AS in_table, CASE WHEN m = 4 THEN 'ST' || (c % 7) ELSE seg END AS style, 'P' || c AS para_id,
                     CASE WHEN m = 0 THEN 'R' || c ELSE '' END || CASE WHEN m = 1 AND c + 7 > last THEN 'T' || c ELSE {_TEXT} END AS text FROM n, top WHERE m <> 3
              UNION ALL SELECT d, 0, c - 3, 1, false, NULL, 'M' || c, 'before' || c FROM n WHERE m = 5
              UNION ALL SELECT d, 0, c, 2, false, 'NS', 'N' || c, CASE WHEN c + 4 > last THEN 'new' || c ELSE 'edited' || (c + 4) END FROM n, top WHERE m = 2
              UNION ALL SELECT d, 1, c, 0, false, NULL, 'E' || c, 'end' || c FROM n WHERE m = 7
              UNION ALL SELECT d, 0, CAST(d AS BIGINT) * 50 + t * 10 + 9, 3 + 2 * r + x, true, NULL, NULL, text FROM {_TABLE_CELLS})
        SELECT d AS doc_id, row_number() OVER (PARTITION BY d ORDER BY z, c, g) - 1 AS ord, in_table, style, para_id, text FROM r""",
    "package_snapshots": f"SELECT d AS doc_id, CASE WHEN CAST(d AS INT) % 3 = 0 THEN 'changed' ELSE 'same' END AS state, CASE WHEN CAST(d AS INT) % 3 = 0 THEN 'word/styles.xml' ELSE '' END AS changed, count(*) - 20 AS tail FROM {_C} GROUP BY d",
    "package_paragraphs": f"""
        SELECT d AS doc_id, k + 4 * (k // 10) AS ord, false AS in_table, seg AS style, CASE WHEN c % 4 = 0 THEN nk END AS num_id, CASE WHEN c % 4 = 0 THEN 1 END AS ilvl, 'P' || c AS para_id, {_TEXT} AS text FROM {_C}
        UNION ALL SELECT d, 14 * t + 10 + 2 * r + x, true, NULL, NULL, NULL, NULL, text FROM {_TABLE_CELLS}""",
    "package_runs": f"""
        WITH r AS (SELECT d, c, unnest(list_concat(list_concat(list_concat(list_concat(list_concat(
                     [{{'t': c_name, 'b': rich, 's': 24, 'i': NULL, 'r': NULL}}],
                     CASE WHEN c % 7 = 0 THEN [{{'t': ' added', 'b': NULL, 's': NULL, 'i': c, 'r': 'insertion'}}] ELSE [] END),
                     CASE WHEN c % 11 = 0 THEN [{{'t': ' gone', 'b': NULL, 's': NULL, 'i': c * 10 + 9, 'r': 'deletion'}}] ELSE [] END),
                     CASE WHEN c % 5 = 0 THEN [{{'t': ' link', 'b': NULL, 's': NULL, 'i': NULL, 'r': NULL}}] ELSE [] END),
                     CASE WHEN c % 3 = 0 THEN list_transform(['', '', '', CAST(c AS VARCHAR), ''], lambda x: {{'t': x, 'b': CAST(NULL AS BOOLEAN), 's': CAST(NULL AS INTEGER), 'i': CAST(NULL AS BIGINT), 'r': CAST(NULL AS VARCHAR)}}) ELSE [] END),
                     CASE WHEN c % 17 = 0 THEN [{{'t': '', 'b': NULL, 's': NULL, 'i': NULL, 'r': NULL}}] ELSE [] END)) AS x, generate_subscripts(range(CAST(1 + (c % 7 = 0)::INT + (c % 11 = 0)::INT + (c % 5 = 0)::INT + 5 * (c % 3 = 0)::INT + (c % 17 = 0)::INT AS BIGINT)), 1) - 1 AS n FROM {_C})
        SELECT d AS doc_id, CAST(n AS BIGINT) AS run_idx, x.t AS text, x.b AS bold, x.s AS size_half_points, x.i AS revision_id, x.r AS revision FROM r
        UNION ALL SELECT d, 0, text, NULL, NULL, NULL, NULL FROM {_TABLE_CELLS} WHERE r = 0 OR x = 1""",
    "package_styles": f"""
        SELECT d AS doc_id, id, name, 'paragraph' AS type, based_on FROM (SELECT DISTINCT d FROM {_C}) x,
        (VALUES ('AUTOMOBILE', 'heading 2', NULL), ('BUILDING', 'plain', 'AUTOMOBILE'), ('FURNITURE', 'other', 'BUILDING'), ('HOUSEHOLD', 'list', 'Missing')) v(id, name, based_on)""",
    "package_style_chain": f"SELECT d AS doc_id, id, CAST(depth AS BIGINT) AS depth, root FROM (SELECT DISTINCT d FROM {_C}) x, {_CHAINS}",
    "package_semantics": f"""
        WITH p AS (SELECT d, seg, CASE WHEN seg IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN 'heading' WHEN c % 4 = 0 THEN CASE WHEN n_regionkey % 2 = 0 THEN 'bulletListItem' ELSE 'numberedListItem' END ELSE 'paragraph' END AS kind
                   FROM {_C} JOIN nation ON n_nationkey = nk UNION ALL SELECT d, NULL, 'paragraph' FROM {_TABLE_CELLS})
        SELECT d AS doc_id, kind, CASE kind WHEN 'heading' THEN 2 WHEN 'paragraph' THEN NULL ELSE 1 END AS level, count(*) AS n FROM p GROUP BY 1, 2, 3""",
    "package_relationships": f"SELECT d AS doc_id, 'word/document.xml' AS part, 'rId' || c AS r_id, 't/hyperlink' AS type, 'http://site/' || c AS target, 'External' AS mode FROM {_C} WHERE c % 5 = 0",
    "package_hyperlinks": f"SELECT d AS doc_id, k // 5 AS ord, 'rId' || c AS r_id, ' link' AS text, 'http://site/' || c AS url, 'external' AS kind FROM {_C} WHERE c % 5 = 0",
    "package_bookmarks": f"SELECT d AS doc_id, c AS id, 'b' || c AS name, k AS paragraph_index FROM {_C}",
    "package_comments": f"SELECT d AS doc_id, c AS id, seg AS author, 'about ' || c_name AS text, k + 4 * (k // 10) AS paragraph_index, rich AS done FROM {_C} WHERE c % 13 = 0",
    "package_revisions": f"""
        SELECT d AS doc_id, c AS id, 'insertion' AS kind, seg AS author, ' added' AS text, k + 4 * (k // 10) AS paragraph_index FROM {_C} WHERE c % 7 = 0
        UNION ALL SELECT d, c * 10 + 9, 'deletion', seg, ' gone', k + 4 * (k // 10) FROM {_C} WHERE c % 11 = 0""",
    "package_bullets": f"SELECT d AS doc_id, n_nationkey AS num_id, n_regionkey % 2 = 0 AS is_bullet FROM (SELECT DISTINCT d FROM {_C}) x, nation",
    "package_unused_numbering": f"SELECT d AS doc_id, n_nationkey AS num_id FROM (SELECT DISTINCT d FROM {_C}) x, nation WHERE (d, n_nationkey) NOT IN (SELECT (d, nk) FROM {_C} WHERE c % 4 = 0)",
    "package_sections": f"SELECT DISTINCT d AS doc_id, CAST(d AS INT) + 10000 AS width, 9000 AS height, false AS landscape, 1 AS columns, 'nextPage' AS break_type FROM {_C}",
    "package_notes": f"SELECT d AS doc_id, 'footnote' AS kind, c AS id, 'note ' || c AS text FROM {_C} WHERE c % 17 = 0 AND c > 0",
    "package_fields": rf"SELECT d AS doc_id, 'SEQ Figure \* ARABIC' AS code, CAST(c AS VARCHAR) AS result, 'spread' AS form, true AS closed, 0 AS depth, 'SEQ' AS kind, 'Figure' AS argument, 'ARABIC' AS format FROM {_C} WHERE c % 3 = 0",
    "package_cells": f"SELECT d AS doc_id, t AS table_no, CAST(r AS BIGINT) AS row, CAST(x AS BIGINT) AS col, CASE WHEN x = 0 AND r = 0 THEN 'restart' WHEN x = 0 THEN 'continue' END AS v_merge, 0 AS nest_depth, text FROM {_TABLE_CELLS}",
    "package_properties": f"SELECT DISTINCT d AS doc_id, 'Document ' || d AS title, CAST(d AS INT) % 2 = 0 AS track_changes FROM {_C}",
    "package_round_trip": f"""
        SELECT unnest(['word/document.xml', 'word/_rels/document.xml.rels', 'word/comments.xml', 'word/commentsExtended.xml', 'word/footnotes.xml', 'word/numbering.xml', 'word/styles.xml', 'word/settings.xml', 'docProps/core.xml']) AS part_path,
               count(DISTINCT d) AS parts, count(DISTINCT d) AS same FROM {_C}""",
    "package_accept": f"SELECT d AS doc_id, k + 4 * (k // 10) AS ord, 'P' || c AS para_id, {_TEXT} AS text FROM {_C} UNION ALL SELECT d, 14 * t + 10 + 2 * r + x, NULL, text FROM {_TABLE_CELLS}",
    "package_reject": f"SELECT d AS doc_id, k + 4 * (k // 10) AS ord, 'P' || c AS para_id, {_OLD} AS text FROM {_C} UNION ALL SELECT d, 14 * t + 10 + 2 * r + x, NULL, text FROM {_TABLE_CELLS}",
    "package_set_style": f"""
        SELECT d AS doc_id, k + 4 * (k // 10) AS ord, 'P' || c AS para_id, CASE WHEN k % 3 = 0 THEN 'S' || k WHEN k % 4 = 0 THEN NULL ELSE seg END AS style FROM {_C}
        UNION ALL SELECT d, 14 * t + 10 + 2 * r + x, NULL, NULL FROM {_TABLE_CELLS}""",
    "package_insert": f"""
        SELECT d AS doc_id, k + 4 * (k // 10) + 3 * ((k + 4) // 5) + 1 + n AS ord, n > 0 AS in_table, CASE n WHEN 0 THEN 'after ' || k WHEN 1 THEN 'x' ELSE 'y' END AS text FROM {_C}, (SELECT unnest([0, 1, 2]) AS n) a WHERE k % 5 = 0
        UNION ALL SELECT d, 14 * t + 10 + 6 * (t + 1) + 2 * r + x, true, text FROM {_TABLE_CELLS}""",
    "package_delete_table": f"SELECT d AS doc_id, count(*) + 8 AS paragraphs, CAST(8 AS BIGINT) AS in_tables FROM {_C} GROUP BY 1",
    "package_move": f"""
        SELECT d AS doc_id, CASE WHEN k = 49 THEN 0 ELSE k + 4 * (k // 10) + 1 END AS ord, 'P' || c AS para_id FROM {_C}
        UNION ALL SELECT d, 14 * t + 10 + 2 * r + x + CASE WHEN t < 4 THEN 1 ELSE 0 END, NULL FROM {_TABLE_CELLS}""",
    "package_delete_marks": f"""
        SELECT d AS doc_id, 'w:bookmarkStart' AS name, count(*) AS n FROM {_C} WHERE c % 2 = 1 GROUP BY 1 UNION ALL SELECT d, 'w:bookmarkEnd', count(*) FROM {_C} WHERE c % 2 = 1 GROUP BY 1
        UNION ALL SELECT DISTINCT d, 'w:footnote', CASE WHEN d = '0' THEN 2 ELSE 1 END FROM {_C} UNION ALL SELECT '0', 'w:footnoteReference', 1""",
    "package_page_setup": f"""
        SELECT DISTINCT d AS doc_id, CASE WHEN CAST(d AS INT) % 3 = 0 THEN 9000 ELSE CAST(d AS INT) + 10000 END AS width, CASE WHEN CAST(d AS INT) % 3 = 0 THEN CAST(d AS INT) + 10000 ELSE 9000 END AS height, false AS landscape,
               700 AS top, 800 AS "left" FROM {_C}""",
    "package_commits": f"""
        SELECT d AS doc_id, CAST(CASE WHEN CAST(d AS INT) % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS second, CAST(4 AS BIGINT) AS commit, CAST(CASE WHEN CAST(d AS INT) % 3 = 1 THEN 1 ELSE 2 END AS BIGINT) AS parts,
               count(*) FILTER (WHERE CAST(d AS INT) % 3 < 2 OR k < 10) AS operations, count(*) FILTER (WHERE CAST(d AS INT) % 3 < 2 OR k < 10) AS pending, CAST(1 AS BIGINT) AS refused FROM {_C} GROUP BY d""",
}
