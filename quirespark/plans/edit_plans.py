"""Queries that edit document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edits as E
from ..sources.tables import paragraphs, table
from .text_plans import PARAGRAPHS as P


def paras(spark, sf_dir):
    return paragraphs(table(spark, sf_dir, "documents")).withColumn("ord", F.col("ord").cast("long"))


def _digest(rows):
    return rows.select("doc_id", "ord", F.md5("text").alias("text_md5"))


def update_paragraph(spark, sf_dir):
    p = paras(spark, sf_dir)
    changes = table(spark, sf_dir, "documents").where("lang = 'fr'").select("doc_id", F.lit(1).cast("long").alias("ord"), F.concat(F.lit("new "), "source").alias("text"))
    return _digest(E.set_values(p, ["doc_id", "ord"], changes, ["text"]))


def delete_paragraph(spark, sf_dir):
    p = paras(spark, sf_dir)
    (left,) = E.delete(p, ["doc_id", "ord"], p.where("contains(text, '!!')"))
    return _digest(E.renumbered(left, "doc_id", ["ord"]))


def insert_paragraph(spark, sf_dir):
    new = table(spark, sf_dir, "documents").where("lang = 'de'").select("doc_id", F.lit("inserted").alias("text"), F.lit(1).cast("long").alias("ord"))
    return _digest(E.insert_at(paras(spark, sf_dir), new))


def insert_after_text(spark, sf_dir):
    p = paras(spark, sf_dir)
    return _digest(E.insert_at(p, E.anchor_after(p, "the").withColumn("text", F.lit("after"))))


def append_paragraph(spark, sf_dir):
    new = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("text"), F.lit(0).cast("long").alias("ord"))
    return _digest(E.append(paras(spark, sf_dir), new))


def apply_style(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("style"))
    changes = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("style"))
    return E.set_values(c, ["c_custkey"], changes, ["style"])


def delete_table(spark, sf_dir):
    o, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    left, cells = E.delete(o.select("o_orderkey"), ["o_orderkey"], o.where("o_orderstatus = 'F'"), i.select("o_orderkey"))
    return left.join(cells.groupBy("o_orderkey").agg(F.count("*").alias("cells")), "o_orderkey", "left").select("o_orderkey", F.coalesce("cells", F.lit(0)).cast("long").alias("cells"))


def content_types_merge(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    originals = part.where("p_size > 10").select(F.col("p_name").alias("name"), F.col("p_type").alias("kind")).groupBy("name").agg(F.min("kind").alias("kind"))
    typed = part.where("p_size > 40").groupBy(F.col("p_name").alias("name")).agg(F.max("p_brand").alias("kind"))
    return E.merged_declarations(originals, typed, ["name"], F.col("name").startswith("red"))


def allocate_id(spark, sf_dir):
    return E.next_number(table(spark, sf_dir, "part"), ["p_type"], F.col("p_brand"))


def settle_revisions(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "insertion").when(F.col("event_type") == "error", "deletion")
    runs = table(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("revision"))
    out = [E.revisions_settled(runs, accept).groupBy("user_id").agg(F.count("*").alias("runs"), F.sum("event_id").alias("ids")).withColumn("accepted", F.lit(accept)) for accept in (True, False)]
    return out[0].unionByName(out[1])


QUERIES = {f.__name__: f for f in (update_paragraph, delete_paragraph, insert_paragraph, insert_after_text, append_paragraph, apply_style, delete_table, content_types_merge, allocate_id, settle_revisions)}
_MERGE = "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY {0}) - 1 AS ord, md5(text) AS text_md5 FROM ({1})"
SQL = {
    "update_paragraph": f"SELECT p.doc_id, p.ord, md5(CASE WHEN d.lang = 'fr' AND p.ord = 1 THEN 'new ' || d.source ELSE p.text END) AS text_md5 FROM {P} p JOIN documents d USING (doc_id)",
    "delete_paragraph": _MERGE.format("ord", f"SELECT * FROM {P} WHERE NOT contains(text, '!!')").replace("(SELECT * FROM", "(SELECT doc_id, ord, text FROM", 1),
    "insert_paragraph": _MERGE.format("o, k", f"SELECT doc_id, text, ord AS o, 1 AS k FROM {P} UNION ALL SELECT doc_id, 'inserted', 1, 0 FROM documents WHERE lang = 'de'"),
    "insert_after_text": _MERGE.format("o, k", f"SELECT doc_id, text, ord AS o, 1 AS k FROM {P} UNION ALL SELECT doc_id, 'after', min(ord) + 1, 0 FROM {P} WHERE contains(text, 'the') GROUP BY doc_id"),
    "append_paragraph": _MERGE.format("k, o", f"SELECT doc_id, text, ord AS o, 0 AS k FROM {P} UNION ALL SELECT doc_id, source, 0, 1 FROM documents"),
    "apply_style": "SELECT c_custkey, coalesce(s, c_mktsegment) AS style FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS s FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey",
    "delete_table": "SELECT o_orderkey, count(l_orderkey) AS cells FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' GROUP BY 1",
    "content_types_merge": """
        WITH t AS (SELECT p_name AS name, max(p_brand) AS kind FROM part WHERE p_size > 40 GROUP BY 1)
        SELECT p_name AS name, min(p_type) AS kind FROM part WHERE p_size > 10 AND NOT starts_with(p_name, 'red') AND p_name NOT IN (SELECT name FROM t) GROUP BY 1 UNION ALL SELECT name, kind FROM t""",
    "allocate_id": "SELECT p_type, max(CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT)) + 1 AS next_id FROM part GROUP BY 1",
    "settle_revisions": """
        SELECT user_id, count(*) AS runs, CAST(sum(event_id) AS BIGINT) AS ids, true AS accepted FROM events WHERE event_type <> 'error' GROUP BY 1
        UNION ALL SELECT user_id, count(*), CAST(sum(event_id) AS BIGINT), false FROM events WHERE event_type <> 'click' GROUP BY 1""",
}
