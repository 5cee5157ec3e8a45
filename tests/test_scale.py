"""What keeps large inputs within memory and time: plans and passes, tried on small trees."""

from pyspark.sql import functions as F

from quirespark.operators import tree as T
from quirespark.sources.packages import xml_nodes
from quirespark.sources.scratch import stored


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tree(spark, *xml):
    rows = [(str(k), "word/document.xml", x.encode()) for k, x in enumerate(xml)]
    return stored(T.tree_of(xml_nodes(spark.createDataFrame(rows, "doc_id string, part_path string, content binary"))), "tree")


def test_written_tables_are_not_broadcast(spark):
    """Files of a few MB may hold a GB of paths: such a table must not pass through the driver."""
    t = tree(spark, "<a><b/><c/></a>")
    plan = plan_of(t.join(t.select(*T.KEY, "path").where("size(path) = 2"), [*T.KEY, "path"], "left_anti"))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_subtree_edits_pass_once_without_a_row_for_each_ancestor(spark):
    t = tree(spark, "<a><b><c><d/></c>x</b><b/></a>", "<a><b/></a>")
    at = t.where("name IN ('b', 'c') AND doc_id = '0'").select(*T.KEY, "path")
    plan = plan_of(T.remove(t, at))
    assert "Generate" not in plan and "Join" not in plan
    assert {(r.doc_id, r.name) for r in T.remove(t, at).collect()} == {("0", "a"), ("1", "a"), ("1", "b")}
    assert sorted(r.name or r.text for r in T.subtrees(t, at).collect()) == ["b", "b", "c", "d", "x"]
    # of targets in each other the outermost counts, also for what comes after the inner one's end
    kept = T.set_text(t, at.withColumn("text", F.lit("new")))
    assert sorted(r.name or r.text for r in kept.where("doc_id = '0'").collect()) == ["a", "b", "b", "new", "new"]


def test_rows_for_each_ancestor_are_not_broadcast(spark):
    """Trees put together from written ones have no sizes of their own either, and a row for each ancestor is more than the tree."""
    t = tree(spark, "<a><b/><c/></a>")
    both = t.unionByName(t.withColumn("part_path", F.lit("+1.0")))
    plan = plan_of(T._prefixes(both).join(both.where("name = 'b'").select(*T.KEY, F.col("path").alias("_up")), [*T.KEY, "_up"], "left_semi"))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_only_the_columns_that_are_read_are_made(spark):
    """A row of all columns has a dozen entries in `within` alone: queries name what they read, and the trees made so are not written again."""
    xml = b'<w:a xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p w:x="1"><w:r><w:p>t</w:p></w:r></w:p><!--c--></w:a>'
    parts = spark.createDataFrame([(str(k), "word/document.xml", xml) for k in range(3)], "doc_id string, part_path string, content binary")
    every, few = xml_nodes(parts), xml_nodes(parts, columns=["doc_id", "node_id", "within", "path"], within=["w:p"])
    assert few.columns == ["doc_id", "node_id", "within", "path"] and few.count() == every.count() == 18
    kept = F.map_filter("within", lambda k, v: k == "w:p")
    want = {(r.doc_id, r.node_id): (r.path, r.w) for r in every.select("doc_id", "node_id", "path", kept.alias("w")).collect()}
    assert {(r.doc_id, r.node_id): (r.path, r.within) for r in few.collect()} == want
    assert max(r.w["w:p"].nest for r in every.select(kept.alias("w")).collect() if r.w) == 1
    t = stored(xml_nodes(parts, columns=T.TREE), "tree")
    assert stored(T.tree_of(t), "tree") is t


def test_formulas_are_copied_without_a_row_for_each_ancestor(spark):
    from quirespark.operators import formula_splice as S

    t = tree(spark, "<a><b><c><b><d/></b></c></b><b/></a>")
    at = t.where("name = 'b' AND size(path) <> 1").select(*T.KEY, "path", F.lit(True).alias("in_run"))
    got = S._carried(t, at)
    assert sorted((len(r._up), r.name) for r in got.collect()) == [(2, "b"), (2, "b"), (2, "b"), (2, "c"), (2, "d"), (4, "b"), (4, "d")]
    plan = plan_of(got)
    assert "Generate" not in plan and "Join" not in plan


def broadcasts(spark, work):
    """The broadcasts of all queries that ran meanwhile, as their plans describe them."""
    store = spark._jsparkSession.sharedState().statusStore()
    done = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    work()
    out = []
    for i in range(store.executionsList().size()):
        execution = store.executionsList().apply(i).executionId()
        if execution not in done:
            nodes = store.planGraph(execution).allNodes()
            out += [nodes.apply(k).desc() for k in range(nodes.size()) if nodes.apply(k).name().startswith("BroadcastExchange")]
    return out


def test_logs_are_replayed_and_reversed_without_a_broadcast(spark):
    """A list for each paragraph of all documents is as much as the documents: written small, it would fill the driver."""
    from quirespark.operators import reduction as R
    from quirespark.operators import reverse as V

    w = f'<w:document xmlns:w="{V.USUAL["w"]}" xmlns:w14="{V.USUAL["w14"]}"><w:body>'
    xml = [f'{w}<w:p w14:paraId="A{k}"><w:pPr><w:pStyle w:val="S"/></w:pPr><w:r>{tab}<w:t>t</w:t></w:r></w:p></w:body></w:document>' for k, tab in enumerate(("", "<w:tab/>"))]
    parts = stored(spark.createDataFrame([(str(k), "word/document.xml", x.encode()) for k, x in enumerate(xml)], "doc_id string, part_path string, content binary"), "parts")
    back = []

    def work():
        log = stored(V.reversed_log(parts), "log")
        back.extend(R.materialised_parts(V.skeleton(parts), log).collect())
        V.typed_share(parts, log).collect()

    assert broadcasts(spark, work) == []
    assert {r.doc_id: bytes(r.content).decode() for r in back} == {str(k): x for k, x in enumerate(xml)}


def test_only_what_is_read_of_a_part_is_noted(spark):
    """Most queries read neither bytes nor what stands around a node; noting it costs as much as the parse."""
    from quirespark.sources import packages as P

    xml = b'<w:p xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:r w:x="1">a&amp;b<!--c--></w:r>d<w:t/></w:p>'
    few, every = P._Parsed("d", "p.xml", xml, frozenset(), ("path", "ord", "parent_id", "name", "attrs", "text")), P._Parsed("d", "p.xml", xml)
    assert not few.start and not few.end and not few.around
    for c in ("path", "ord", "parent_id", "name", "attrs", "text"):
        assert few.column(c).equals(every.column(c)), c
    assert every.column("path").to_pylist() == [[0], [0, 0], [0, 0, 0], [0, 0, 1], [0, 1], [0, 2]]


def test_edited_parts_are_written_in_the_pass_that_edits_them(spark):
    """Rows of a part that an edit has brought together are not shuffled or written again for their bytes."""
    t = tree(spark, '<a x="1"><b>t</b><c/></a>', '<w:a xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><b/></w:a>')
    parts = T.part_bytes(T.remove(t, t.where("name = 'b'").select(*T.KEY, "path")))
    assert plan_of(parts).count("Exchange hashpartitioning") == 1 and "Join" not in plan_of(parts)
    wrote = {r.doc_id: bytes(r.content).decode().partition("\n")[2] for r in parts.collect()}
    assert wrote == {"0": '<a x="1"><c/></a>', "1": '<w:a xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"/>'}


def test_properties_that_are_there_are_replaced_in_one_pass(spark):
    from quirespark.operators import document_edits as D

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    t = tree(spark, f'<w:a {w}><w:p><w:pPr><w:pStyle w:val="x"/><w:jc/></w:pPr></w:p><w:p><w:pPr><w:pStyle w:val="y"/></w:pPr></w:p></w:a>')
    style = F.when(F.element_at("path", -1) == 0, T.element("w:pStyle", w_val="z"))
    out = D.set_property(t, "paragraph_style", t.where("name = 'w:p'").select(*T.KEY, "path", style.alias("xml")))
    assert "Join" not in plan_of(out)
    assert bytes(T.part_bytes(out).first().content).decode().endswith('<w:p><w:pPr><w:pStyle w:val="z"/><w:jc/></w:pPr></w:p><w:p><w:pPr/></w:p></w:a>')


def test_accepted_changes_go_in_one_pass(spark):
    from quirespark.operators import document_edits as D

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    t = tree(spark, f"<w:p {w}><w:ins><w:r>a</w:r></w:ins><w:del><w:r>b</w:r></w:del><w:r><w:rPr><w:rPrChange><w:b/></w:rPrChange></w:rPr></w:r></w:p>")
    out = D.settle_revisions(t, True)
    assert plan_of(out).count("SortMergeJoin") == 3  # of rows with marks of their own (twice), and of their tables; none of the tree
    assert bytes(T.part_bytes(out).first().content).decode().endswith("<w:r>a</w:r><w:r><w:rPr/></w:r></w:p>")


def test_texts_are_rewritten_in_one_pass(spark):
    from quirespark.operators import inline as I

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    t = tree(spark, f'<w:p {w}><w:r><w:t xml:space="default">one</w:t><w:tab/></w:r><w:r><w:t>two</w:t></w:r></w:p>')
    own = stored(I.pieces(t), "pieces")
    out = I.rewritten(t, I.matches_in(I._flat(own), "e\ttw", " x "), own)
    assert plan_of(out).count("SortMergeJoin") == 1  # pieces and edits
    assert bytes(T.part_bytes(out).first().content).decode().endswith('<w:p xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:r><w:t xml:space="preserve">on x </w:t></w:r><w:r><w:t>o</w:t></w:r></w:p>')


def test_a_log_is_replayed_in_one_shuffle_without_tables_between(spark, monkeypatch):
    """Rows for each ancestor and a table for each step took 15 KB of disk a paragraph; a document and its log need to come together once."""
    from quirespark.operators import reduction as R
    from quirespark.sources import scratch

    names = []
    path = scratch.scratch_path
    monkeypatch.setattr(scratch, "scratch_path", lambda s, name: names.append(name) or path(s, name))
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml"'
    parts = spark.createDataFrame([(d, "word/document.xml", f'<w:document {w}><w:body><w:p w14:paraId="A"/></w:body></w:document>'.encode()) for d in "xy"], "doc_id string, part_path string, content binary")
    log = spark.createDataFrame([("x", 1, "o", "setText", '{"target": "w14:paraId=A", "text": "t"}')], "doc_id string, seq long, op_id string, op_type string, p string").selectExpr("doc_id", "seq", "op_id", "op_type", "parse_json(p) AS payload")
    out = R.materialised_parts(parts, log)
    got = {r.doc_id: bytes(r.content).decode() for r in out.collect()}
    assert "<w:r><w:t>t</w:t></w:r>" in got["x"] and got["y"].endswith('<w:p w14:paraId="A"/></w:body></w:document>')
    plan = plan_of(out)
    above = plan[: plan.index("Union")]
    assert names == [] and above.count("Exchange") == 1 and above.count("MapInArrow") == 1 and "Join" not in above


def test_formulas_come_into_parts_without_a_row_for_each_node(spark, monkeypatch):
    """Node rows of both documents were joined a dozen times; a part is read where its formulas are, and where formulas come in."""
    from quirespark.operators import formula_splice as S
    from quirespark.operators import formulas as M
    from quirespark.plans import formula_plans

    def never(*_, **__):
        raise AssertionError("nodes became rows")

    part = spark.range(200).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size", "'b' AS p_brand")
    monkeypatch.setattr(formula_plans, "table", lambda *_: part)
    monkeypatch.setattr(formula_plans.P, "xml_nodes", never)
    out = formula_plans.package_formula_splice(spark, "")
    assert out.where("spliced = 1").count() == 150 and out.count() == 200
    parts = stored(formula_plans.formula_parts(spark, ""), "parts")
    splices = spark.createDataFrame([(0, "1", "word/document.xml", [0.0, 0.0, 0.0], "0", "word/document.xml", [0.0, 0.0, 0.0], 0, "end", None, 1)], "id int, doc_id string, part_path string, path array<double>, source_doc string, source_part string, source_path array<double>, index int, where string, anchor string, instance int")
    plan = plan_of(M.texts_of_parts(S.splice_parts(parts, splices)))
    assert plan.count("MapInArrow") == 3 and plan.count("SortMergeJoin") == 1 and "Broadcast" not in plan and "Window" not in plan
