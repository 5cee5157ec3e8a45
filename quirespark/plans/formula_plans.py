"""Queries over formulas: a paragraph for every part, with a formula of one of eight shapes, in documents of DOC_ROWS parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import formula_splice as S
from ..operators import formulas as M
from ..operators import tree as T
from ..sources import packages as P
from ..sources.scratch import stored
from ..sources.tables import table

DOC_ROWS = 50
_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
# %1$s is the part's number, %2$s its size, %3$s its brand, %4$s an operator's sign, %5$s 1 where the size is even
_K, _S, _B = ("<m:r><m:t>%" + f"{i}$s</m:t></m:r>" for i in (1, 2, 3))
_ROOT = f'<m:rad><m:radPr><m:degHide m:val="%5$s"/></m:radPr><m:deg>{_S}</m:deg><m:e>{_K}</m:e></m:rad>'
_SUM = f'<m:nary><m:naryPr><m:chr m:val="%4$s"/></m:naryPr><m:sub>{_K}</m:sub><m:sup>{_S}</m:sup><m:e>{_B}</m:e></m:nary>'
_SHAPES = (
    f"<m:oMath><m:f><m:num>{_K}</m:num><m:den>{_S}</m:den></m:f></m:oMath>",
    f"<m:oMath><m:sSubSup><m:sup>{_S}</m:sup><m:sub>{_K}</m:sub><m:e>{_B}</m:e></m:sSubSup></m:oMath>",
    f"<m:oMath>{_ROOT}</m:oMath>",
    f"<m:oMathPara><m:oMath>{_SUM}</m:oMath></m:oMathPara>",
    f"<m:oMath><m:m><m:mr><m:e>{_K}</m:e><m:e>{_S}</m:e></m:mr><m:mr><m:e>{_SUM}</m:e><m:e/></m:mr></m:m></m:oMath>",
    f"<m:oMath><m:f><m:den>{_SUM}</m:den><m:num>{_ROOT}{_B}</m:num></m:f></m:oMath>",
    f'<w:hyperlink><w:r><w:t>link </w:t></w:r><m:oMath><m:acc><m:accPr><m:chr m:val="^"/></m:accPr><m:e>{_K}</m:e></m:acc></m:oMath></w:hyperlink>',
    f"<mc:AlternateContent><mc:Choice><w:r><w:t>no</w:t></w:r><m:oMath>{_B}</m:oMath></mc:Choice><mc:Fallback><m:oMath>{_S}</m:oMath></mc:Fallback></mc:AlternateContent>",
)


#: What the queries read of the nodes.
COLUMNS = (*P.READ, "path", "ord")
WITHIN = ("w:p", "w:t", "w:tabs", "m:oMath", "mc:Choice", *M.HOLDERS)


def formula_parts(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"), "p_brand")
    args = [F.col("k").cast("string"), F.col("s").cast("string"), F.col("p_brand"), F.when(F.col("s") % 3 == 0, "∏").when(F.col("s") % 3 == 1, "?").otherwise("∑"), (F.col("s") % 2 == 0).cast("int").cast("string")]
    shape = F.coalesce(*(F.when(F.col("k") % len(_SHAPES) == i, F.format_string(xml, *args)) for i, xml in enumerate(_SHAPES)))
    xml = F.concat(F.lit("<w:p><w:r><w:t>see </w:t></w:r>"), shape, F.lit("<w:r><w:t> end</w:t></w:r></w:p>"))
    docs = p.select(F.floor(F.col("k") / DOC_ROWS).cast("string").alias("doc_id"), "k", xml.alias("x")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda r: r["x"]), "").alias("body"))
    content = F.encode(F.concat(F.lit(f"<w:document {_NS}><w:body>"), "body", F.lit("</w:body></w:document>")), "UTF-8")
    return docs.select("doc_id", F.lit("word/document.xml").alias("part_path"), content.alias("content"))


def formula_nodes(spark, sf_dir) -> DataFrame:
    return stored(P.xml_nodes(formula_parts(spark, sf_dir), True, COLUMNS, WITHIN), "nodes")


def package_formula_text(spark, sf_dir):
    """What each paragraph reads as, with its formulas."""
    rows = M.display_texts(formula_nodes(spark, sf_dir))
    order = F.row_number().over(P.Window.partitionBy("doc_id").orderBy("node_id")) - 1
    return rows.select("doc_id", order.cast("long").alias("ord"), "text")


def formula_components(spark, sf_dir):
    """How many components of each kind documents have, at which depth, and what they read as, in all."""
    rows = M.components(formula_nodes(spark, sf_dir))
    return rows.groupBy("doc_id", "kind", F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("n"), F.count_if(F.col("parent_id").isNull()).alias("outermost"), F.array_join(F.array_sort(F.collect_set("text")), " ").alias("texts"))


def _places(nodes: DataFrame) -> DataFrame:
    """(doc_id, part_path, path, ord) of paragraphs."""
    order = F.row_number().over(P.Window.partitionBy("doc_id").orderBy("path")) - 1
    return nodes.where("name = 'w:p'").select("doc_id", "part_path", "path", order.cast("long").alias("ord"))


def _read(tree: DataFrame) -> DataFrame:
    """(doc_id, ord, text) of the parts' bytes."""
    nodes = stored(P.xml_nodes(T.part_bytes(tree), True, COLUMNS, WITHIN), "nodes")
    texts = M.display_texts(nodes)
    return texts.select("doc_id", (F.row_number().over(P.Window.partitionBy("doc_id").orderBy("node_id")) - 1).cast("long").alias("ord"), "text")


def package_formula_splice(spark, sf_dir):
    """Documents 2n and 2n + 1 give each other's paragraphs their formulas, behind the first word, and the count of these."""
    parts = formula_parts(spark, sf_dir)
    # as many files as shuffles have partitions: of few bytes there would be one, and reading is work
    parts = stored(parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "part_path"), "parts")
    places = stored(S.paragraphs(parts), "places")
    source = places.where("formulas > 0").withColumn("index", F.explode(F.sequence(F.lit(0), F.col("formulas") - 1)))
    source = source.select(F.col("doc_id").alias("source_doc"), F.col("part_path").alias("source_part"), F.col("path").alias("source_path"), "index", "ord", F.col("doc_id").cast("long").bitwiseXOR(F.lit(1)).cast("string").alias("doc_id"))
    splices = source.join(places.drop("formulas"), ["doc_id", "ord"]).withColumns({"id": F.struct("ord", "index"), "where": F.lit("after"), "anchor": F.lit("see"), "instance": F.lit(1)})
    splices = stored(splices, "splices")
    given = splices.groupBy("doc_id", "ord").agg(F.count("*").alias("spliced"))
    texts = M.texts_of_parts(S.splice_parts(parts, splices)).hint("merge")
    return texts.join(given, ["doc_id", "ord"], "left").select("doc_id", "ord", "text", F.coalesce("spliced", F.lit(0)).alias("spliced"))


def package_formula_replace(spark, sf_dir):
    """A word, and a digit with what follows it: where that digit is a formula's the text stays."""
    nodes = formula_nodes(spark, sf_dir)
    tree, refused = S.replace_beside_formulas(nodes, "see|[0-9] end", "X", regex=True)
    refused = refused.withColumnRenamed("surface", "path").join(_places(nodes), ["doc_id", "part_path", "path"]).select("doc_id", "ord", F.col("n").cast("long").alias("refused"))
    return _read(tree).join(refused, ["doc_id", "ord"], "left").select("doc_id", "ord", "text", F.coalesce("refused", F.lit(0)).alias("refused"))


QUERIES = {f.__name__: f for f in (package_formula_text, formula_components, package_formula_splice, package_formula_replace)}

_P = "(SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS n, CAST(p_size AS VARCHAR) AS s, p_brand AS b, CASE WHEN p_size % 3 = 0 THEN '∏' ELSE '∑' END AS sign, p_size % 2 = 0 AS hidden, CAST(p_partkey // 50 AS VARCHAR) AS d FROM part)"
_ROOT_TEXT, _SUM_TEXT = "CASE WHEN hidden THEN n ELSE s || n END", "sign || n || s || b"
_ROWS = (
    (0, "m:f", 0, "n || s"), (0, "m:r", 1, "n"), (0, "m:r", 1, "s"), (1, "m:sSubSup", 0, "b || n || s"), (1, "m:r", 1, "b"), (1, "m:r", 1, "n"), (1, "m:r", 1, "s"), (2, "m:rad", 0, _ROOT_TEXT), (2, "m:r", 1, "n"), (2, "m:r", 1, "CASE WHEN NOT hidden THEN s END"),
    (3, "m:nary", 0, _SUM_TEXT), (3, "m:r", 1, "n"), (3, "m:r", 1, "s"), (3, "m:r", 1, "b"), (4, "m:m", 0, "n || s || n || s || b"), (5, "m:f", 0, f"{_ROOT_TEXT} || b || {_SUM_TEXT}"), (5, "m:rad", 1, _ROOT_TEXT), (5, "m:r", 1, "b"), (5, "m:nary", 1, _SUM_TEXT),
    (5, "m:r", 2, "n"), (5, "m:r", 2, "CASE WHEN NOT hidden THEN s END"), (5, "m:r", 2, "n"), (5, "m:r", 2, "s"), (5, "m:r", 2, "b"), (6, "m:acc", 0, "n"), (6, "m:r", 1, "n"), (7, "m:r", 0, "s"),
)
_COMPONENTS = " UNION ALL ".join(f"SELECT d, '{kind}' AS kind, {depth} AS depth, {text} AS text FROM {_P} WHERE k % 8 = {shape}" for shape, kind, depth, text in _ROWS)
_FORMULA = f"CASE k % 8 WHEN 0 THEN n || s WHEN 1 THEN b || n || s WHEN 2 THEN {_ROOT_TEXT} WHEN 3 THEN {_SUM_TEXT} WHEN 4 THEN n || s || n || s || b WHEN 5 THEN {_ROOT_TEXT} || b || {_SUM_TEXT} ELSE '' END"
_TAIL = "CASE k % 8 WHEN 6 THEN 'link ' || n WHEN 7 THEN s ELSE '' END"
SQL = {
    "package_formula_splice": f"""
        WITH f AS (SELECT k, CAST(d AS BIGINT) AS d, k % 50 AS ord, {_FORMULA} AS own, {_TAIL} AS tail FROM {_P})
        SELECT CAST(f.d AS VARCHAR) AS doc_id, f.ord, 'see' || coalesce(g.own, '') || ' ' || f.own || ' end' || f.tail AS text, CAST(CASE WHEN g.k % 8 < 6 THEN 1 ELSE 0 END AS BIGINT) AS spliced
        FROM f LEFT JOIN f g ON g.d = xor(f.d, 1) AND g.ord = f.ord""",
    "package_formula_replace": f"SELECT d AS doc_id, k % 50 AS ord, 'X ' || {_FORMULA} || ' end' || {_TAIL} AS text, CAST(CASE WHEN k % 8 < 6 THEN 1 ELSE 0 END AS BIGINT) AS refused FROM {_P}",
    "package_formula_text": f"""
        SELECT d AS doc_id, k % 50 AS ord, CASE k % 8 WHEN 6 THEN 'see  endlink ' || n WHEN 7 THEN 'see  end' || s ELSE 'see ' || CASE k % 8 WHEN 0 THEN n || s WHEN 1 THEN b || n || s WHEN 2 THEN {_ROOT_TEXT}
               WHEN 3 THEN {_SUM_TEXT} WHEN 4 THEN n || s || n || s || b ELSE {_ROOT_TEXT} || b || {_SUM_TEXT} END || ' end' END AS text FROM {_P}""",
    "formula_components": f"SELECT d AS doc_id, kind, CAST(depth AS BIGINT) AS depth, count(*) AS n, count(*) FILTER (WHERE depth = 0) AS outermost, string_agg(DISTINCT text, ' ' ORDER BY text) AS texts FROM ({_COMPONENTS}) c WHERE text IS NOT NULL GROUP BY 1, 2, 3",
}
