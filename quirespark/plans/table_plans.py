"""Queries over table cells, styles, numbering, comments, parts and units."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.units import EMU_PER_PIXEL, TWIPS_PER_POINT, emu_from_cm, emu_from_inches
from ..operators import compare as C
from ..operators import ordered as O
from ..operators import styles as S
from ..operators import text as T
from ..sources.packages import html_node_counts as count_nodes
from ..sources.tables import table

ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"
CELLS = f"(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS row_no FROM lineitem)"


def cells(spark, sf_dir):
    """Table rows: l_orderkey is the table, row_no the row."""
    w = Window.partitionBy("l_orderkey").orderBy(*ORDER.split(", "))
    return table(spark, sf_dir, "lineitem").withColumn("row_no", F.row_number().over(w).cast("long"))


def _above(name):
    def query(spark, sf_dir):
        value = O.above(cells(spark, sf_dir), ["l_orderkey"], "row_no", "l_extendedprice")[name]
        return cells(spark, sf_dir).select("l_orderkey", "row_no", value.alias("value"))

    query.__name__ = f"{name}_above"
    return query


def sum_left(spark, sf_dir):
    cents = [F.round(F.col(c) * 100).cast("long") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    return cells(spark, sf_dir).select("l_orderkey", "row_no", (sum(cents[1:], cents[0]) / 100).alias("value"))


def table_text(spark, sf_dir):
    rows = cells(spark, sf_dir).select("l_orderkey", "row_no", F.concat_ws("\t", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").alias("line"))
    return T.joined_text(rows, ["l_orderkey"], "row_no", "line", "\n", "body")


def merge_cells_vertical(spark, sf_dir):
    found = O.islands(cells(spark, sf_dir), ["l_orderkey"], "row_no", "l_returnflag")
    return found.where("size > 1").select("l_orderkey", "l_returnflag", F.col("first").alias("first_row"), F.col("size").alias("v_span"))


def merge_cells_horizontal(spark, sf_dir):
    same = F.col("l_returnflag") == F.col("l_linestatus")
    return cells(spark, sf_dir).select("l_orderkey", "row_no", F.when(same, 2).otherwise(1).cast("long").alias("grid_span"), F.when(same, F.lit(None)).otherwise(F.col("l_linestatus")).alias("second_cell"))


def max_nest_depth(spark, sf_dir):
    return S.chains(_turns(spark, sf_dir), ["conv_id"]).groupBy("conv_id").agg(F.max("depth").alias("depth"))


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("id"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent"))


def style_chain(spark, sf_dir):
    return S.chains(_turns(spark, sf_dir), ["conv_id"])


def comment_replies(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    replies = c.where("turn > 0").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("reply_author"))
    return c.select("conv_id", "turn", "role").join(replies, ["conv_id", "turn"])


def comment_roots(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", "role", F.length("text").cast("long").alias("characters"))


def next_id(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("next_id"))


def orphan_numbering(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 7").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


def bullet_list_detect(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.select("c_custkey", F.coalesce(F.col("r_name").rlike("^A"), F.lit(False)).alias("is_bullet"))


def relationship_resolve(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_custkey", F.col("c_name").alias("target"))


def unit_convert(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", (size * TWIPS_PER_POINT).cast("long").alias("twips"), emu_from_inches(size).alias("emu_in"), emu_from_cm(size).alias("emu_cm"), (size.cast("long") * EMU_PER_PIXEL).alias("emu_px")
    )


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").cast("string").alias("part_path"), F.col("text").alias("content"), "lang")


def part_compare(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    rebuilt = parts.where("lang <> 'es'").withColumn("content", F.when(F.col("lang") == "fr", F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    rebuilt = rebuilt.unionByName(parts.where("lang = 'de'").withColumn("part_path", F.concat(F.lit("new/"), "part_path")))
    return C.part_verdicts(parts, rebuilt)


def first_divergence(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", C.first_divergence(F.encode("text", "UTF-8"), F.encode(F.regexp_replace("text", "n.*", "?"), "UTF-8")).alias("at"))


def packages_equal(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    changed = parts.withColumn("content", F.when(F.contains("content", F.lit("license")), F.lit("")).otherwise(F.col("content")))
    return C.all_equal(parts, changed)


def part_coverage(spark, sf_dir):
    sized = _parts(spark, sf_dir).withColumn("total", F.octet_length("content")).withColumn("covered", F.when(F.col("lang") == "en", F.col("total")).otherwise(0))
    return C.coverage(sized, ["doc_id"], "covered", "total")


def part_hash(spark, sf_dir):
    return _parts(spark, sf_dir).select("doc_id", "part_path", F.sha2("content", 256).alias("sha256"))


def fingerprint_groups(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("fingerprint")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


def html_node_counts(spark, sf_dir):
    return count_nodes(table(spark, sf_dir, "pages"))


def word_diff(spark, sf_dir):
    from ..sources.tables import paragraphs

    p = paragraphs(table(spark, sf_dir, "documents")).withColumn("ord", F.col("ord").cast("long")).withColumn("stable_id", F.when(F.contains("text", F.lit("en")), F.col("ord")))
    new = p.where("NOT contains(text, ' | ')").withColumn("text", F.when(F.contains("text", F.lit("tion")), F.concat("text", F.lit("!"))).when(F.contains("text", F.lit("ung")), F.concat(F.lit("?"), "text")).otherwise(F.col("text")))
    return C.paragraph_diff(p, new)


QUERIES = {
    f.__name__: f
    for f in (
        *map(_above, ("sum", "avg", "count", "max", "min")), sum_left, table_text, merge_cells_vertical, merge_cells_horizontal, max_nest_depth, style_chain, comment_replies, comment_roots, next_id, orphan_numbering,
        bullet_list_detect, relationship_resolve, unit_convert, part_compare, first_divergence, packages_equal, part_coverage, part_hash, fingerprint_groups, word_diff, html_node_counts,
    )
}

_ABOVE = "(PARTITION BY l_orderkey ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
_PARTS = "(SELECT source AS doc_id, CAST(doc_id AS VARCHAR) AS part_path, text AS content, lang FROM documents)"
_CHAIN = """
    WITH RECURSIVE c AS (SELECT conv_id, turn AS id, CASE WHEN turn > 0 THEN turn - 1 END AS parent FROM conversations),
    k AS (SELECT conv_id, id, id AS far, 0 AS depth FROM c UNION ALL
          SELECT k.conv_id, k.id, p.id, k.depth + 1 FROM k JOIN c ON c.conv_id = k.conv_id AND c.id = k.far JOIN c p ON p.conv_id = c.conv_id AND p.id = c.parent)"""
SQL = {
    "sum_above": f"SELECT l_orderkey, row_no, CAST(sum({_CENTS}) OVER {_ABOVE} AS DOUBLE) / 100 AS value FROM {CELLS}",
    "avg_above": f"SELECT l_orderkey, row_no, CAST(sum({_CENTS}) OVER {_ABOVE} AS DOUBLE) / nullif(count(*) OVER {_ABOVE}, 0) / 100 AS value FROM {CELLS}",
    "count_above": f"SELECT l_orderkey, row_no, count(l_extendedprice) OVER {_ABOVE} AS value FROM {CELLS}",
    "max_above": f"SELECT l_orderkey, row_no, max(l_extendedprice) OVER {_ABOVE} AS value FROM {CELLS}",
    "min_above": f"SELECT l_orderkey, row_no, min(l_extendedprice) OVER {_ABOVE} AS value FROM {CELLS}",
    "sum_left": f"""
        SELECT l_orderkey, row_no, CAST(CAST(round(l_quantity * 100) AS BIGINT) + CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(round(l_discount * 100) AS BIGINT) + CAST(round(l_tax * 100) AS BIGINT) AS DOUBLE) / 100 AS value
        FROM {CELLS}""",
    "table_text": f"SELECT l_orderkey, string_agg(concat_ws(chr(9), l_linenumber, l_partkey, l_suppkey, l_returnflag), chr(10) ORDER BY row_no) AS body FROM {CELLS} GROUP BY l_orderkey",
    "merge_cells_vertical": f"""
        WITH m AS (SELECT l_orderkey, row_no, l_returnflag, CASE WHEN l_returnflag IS NOT DISTINCT FROM lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY row_no) THEN 0 ELSE 1 END AS c FROM {CELLS}),
        i AS (SELECT *, sum(c) OVER (PARTITION BY l_orderkey ORDER BY row_no) AS g FROM m)
        SELECT l_orderkey, l_returnflag, min(row_no) AS first_row, count(*) AS v_span FROM i GROUP BY l_orderkey, l_returnflag, g HAVING count(*) > 1""",
    "merge_cells_horizontal": f"""
        SELECT l_orderkey, row_no, CAST(CASE WHEN l_returnflag = l_linestatus THEN 2 ELSE 1 END AS BIGINT) AS grid_span, CASE WHEN l_returnflag = l_linestatus THEN NULL ELSE l_linestatus END AS second_cell FROM {CELLS}""",
    "max_nest_depth": f"{_CHAIN} SELECT conv_id, CAST(max(depth) AS BIGINT) AS depth FROM k GROUP BY conv_id",
    "style_chain": f"{_CHAIN} SELECT conv_id, id, CAST(max(depth) AS BIGINT) AS depth, arg_max(far, depth) AS root FROM k GROUP BY conv_id, id",
    "comment_replies": "SELECT a.conv_id, a.turn, a.role, b.role AS reply_author FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1",
    "comment_roots": "SELECT conv_id, role, CAST(length(text) AS BIGINT) AS characters FROM conversations WHERE turn = 0",
    "next_id": "SELECT conv_id, max(turn) + 1 AS next_id FROM conversations GROUP BY conv_id",
    "orphan_numbering": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 7)",
    "bullet_list_detect": "SELECT c_custkey, coalesce(starts_with(r_name, 'A'), false) AS is_bullet FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "relationship_resolve": "SELECT o_orderkey, o_custkey, c_name AS target FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    "unit_convert": "SELECT p_partkey, CAST(p_size * 20 AS BIGINT) AS twips, CAST(p_size AS BIGINT) * 914400 AS emu_in, CAST(p_size AS BIGINT) * 360000 AS emu_cm, CAST(p_size AS BIGINT) * 9525 AS emu_px FROM part",
    "part_compare": f"""
        WITH a AS {_PARTS}, b AS (SELECT doc_id, part_path, CASE WHEN lang = 'fr' THEN content || '!' ELSE content END AS content FROM a WHERE lang <> 'es'
                                  UNION ALL SELECT doc_id, 'new/' || part_path, content FROM a WHERE lang = 'de')
        SELECT doc_id, part_path, CASE WHEN b.content IS NULL THEN 'missing' WHEN a.content IS NULL THEN 'extra' WHEN a.content = b.content THEN 'equal' ELSE 'different' END AS verdict FROM a FULL JOIN b USING (doc_id, part_path)""",
    "first_divergence": r"""
        SELECT doc_id, CASE WHEN text <> regexp_replace(text, 'n.*', '?', 'g') THEN CAST(strlen(string_split(text, 'n')[1]) AS BIGINT) END AS at FROM documents""",
    "packages_equal": "SELECT source AS doc_id, bool_and(NOT contains(text, 'license')) AS equal FROM documents GROUP BY 1",
    "part_coverage": f"""
        SELECT doc_id, CAST(sum(CASE WHEN lang = 'en' THEN strlen(content) ELSE 0 END) AS BIGINT) AS covered, CAST(sum(strlen(content)) AS BIGINT) AS total,
               CASE WHEN sum(strlen(content)) = 0 THEN 0.0 ELSE round(CAST(sum(CASE WHEN lang = 'en' THEN strlen(content) ELSE 0 END) AS DOUBLE) / CAST(sum(strlen(content)) AS DOUBLE), 6) END AS ratio
        FROM {_PARTS} GROUP BY doc_id""",
    "part_hash": f"SELECT doc_id, part_path, sha256(content) AS sha256 FROM {_PARTS}",
    "fingerprint_groups": "SELECT sha256(text) AS fingerprint, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1",
    "html_node_counts": r"""
        WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?(?:-->|\z)', '', 'g'), '(?is)(<script\b[^>]*>).*?(?:</script\s*>|\z)', '\1', 'g'), '(?is)(<style\b[^>]*>).*?(?:</style\s*>|\z)', '\1', 'g') AS h FROM pages)
        SELECT page_id, lower(tag) AS tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(h, '<([A-Za-z][^\s/>]*)', 1)) AS tag FROM b) GROUP BY 1, 2""",
    "word_diff": """
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS ord FROM documents),
        p AS (SELECT *, contains(text, 'en') AS known FROM l),
        q AS (SELECT doc_id, ord, known, CASE WHEN contains(text, 'tion') THEN text || '!' WHEN contains(text, 'ung') THEN '?' || text ELSE text END AS text FROM p WHERE NOT contains(text, ' | ')),
        i AS (SELECT a.doc_id AS da, b.doc_id AS db, a.ord AS oa, b.ord AS ob, a.text AS ta, b.text AS tb FROM (SELECT * FROM p WHERE known) a FULL JOIN (SELECT * FROM q WHERE known) b ON a.doc_id = b.doc_id AND a.ord = b.ord),
        pa AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY ord) AS nth FROM p WHERE NOT known),
        qa AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY ord) AS nth FROM q WHERE NOT known),
        f AS (SELECT a.doc_id AS da, b.doc_id AS db, a.ord AS oa, b.ord AS ob, a.text AS ta, b.text AS tb FROM pa a FULL JOIN qa b ON a.doc_id = b.doc_id AND a.text = b.text AND a.nth = b.nth)
        SELECT coalesce(da, db) AS doc_id, CASE WHEN ob IS NULL THEN 'remove' WHEN oa IS NULL THEN 'insert' ELSE 'setText' END AS kind, oa AS old_ord, ob AS new_ord
        FROM (SELECT * FROM i UNION ALL SELECT * FROM f) WHERE oa IS NULL OR ob IS NULL OR ta <> tb""",
}
