"""Queries over the operations of logs: the event table gives each user a log of operations with JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import operations as L
from ..operators.ordered import nearest_before
from ..operators.replay import SCHEMA, replay
from ..sources.tables import oplog, table

OPS = ("view", "click", "purchase", "signup", "error")


def events(spark, sf_dir) -> DataFrame:
    return oplog(table(spark, sf_dir, "events")).withColumn("id", F.col("event_id").cast("string")).withColumn("e", F.concat(F.lit("e"), F.col("element")))


def _named(**fields: Column | str) -> Column:
    return F.to_json(F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items())))


def log_of(rows: DataFrame, **kinds: tuple[Column | str, Column] | None) -> DataFrame:
    """A log in which each event type is an operation: (its kind, its fields as JSON); event types without one are left out."""
    kind, payload = F.lit(None).cast("string"), F.lit(None).cast("string")
    for op, pair in kinds.items():
        name, fields = pair
        kind = F.when(F.col("op") == op, name if isinstance(name, Column) else F.lit(name)).otherwise(kind)
        payload = F.when(F.col("op") == op, fields).otherwise(payload)
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "seq", F.concat(F.lit("op"), "id").alias("op_id"), kind.alias("op_type"), F.parse_json(payload).alias("payload"))
    return rows.where("op_type IS NOT NULL")


def _of(prefix: str, c: str = "id") -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def edits(spark, sf_dir) -> DataFrame:
    """view sets a text, click a style, purchase an attribute, signup adds a relationship, error undoes the last view before it (without one it is of an unknown kind)."""
    rows = events(spark, sf_dir)
    rows = rows.withColumn("last", nearest_before(rows, ["doc_id"], "seq", F.when(F.col("op") == "view", F.col("id"))))
    return log_of(
        rows,
        view=("setText", _named(target=F.col("e"), text=_of("v"))),
        click=("setParagraphStyle", _named(target=F.col("e"), styleId=F.concat(F.lit("s"), (F.col("event_id") % 5).cast("string")))),
        purchase=("updateAttribute", _named(target=F.col("e"), localName=F.concat(F.lit("a"), (F.col("event_id") % 3).cast("string")), value=F.when(F.col("event_id") % 4 != 0, _of("x")))),
        signup=("addRelationship", _named(part="word/document.xml", id=_of("rId"), type="t", target=_of("u"))),
        error=(F.when(F.col("last").isNull(), "brandNew").otherwise("undo"), _named(targetOpID=F.concat(F.lit("op"), "last"))),
    )


def operation_texts(spark, sf_dir):
    return L.texts(L.taking_part(edits(spark, sf_dir)))


def operation_styles(spark, sf_dir):
    return L.paragraph_styles(L.taking_part(edits(spark, sf_dir)))


def operation_attributes(spark, sf_dir):
    return L.attributes(edits(spark, sf_dir)).select("doc_id", "element", "name", "value")


def operation_relationships(spark, sf_dir):
    return L.relationships_added(edits(spark, sf_dir))


def operation_elements(spark, sf_dir):
    return L.elements(edits(spark, sf_dir)).groupBy("doc_id", "op_type", "element").agg(F.count("*").alias("n"))


def operation_unknown(spark, sf_dir):
    return L.unknown(edits(spark, sf_dir)).select("doc_id", "seq", "op_type")


def operation_batches(spark, sf_dir):
    """Undo of whole batches: signup begins one, error ends the innermost open one, a click undoes the last begun one if it has ended."""
    rows = events(spark, sf_dir)
    base = log_of(rows, view=("setText", _named(target=F.col("e"), text=_of("v"))), signup=("batchBegin", _named(label="b")), error=("batchEnd", _named(label="b")))
    closed = L.batches(base).withColumn("undone_by", F.col("end") + 1)
    clicks = rows.where("op = 'click'").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("seq").alias("undone_by"), "id")
    begun = base.select("doc_id", F.col("seq").alias("begin"), F.col("op_id").alias("named"))
    undo = clicks.join(closed, ["doc_id", "undone_by"]).join(begun, ["doc_id", "begin"]).select("doc_id", F.col("undone_by").alias("seq"), F.concat(F.lit("op"), "id").alias("op_id"), F.lit("undo").alias("op_type"), F.parse_json(F.to_json(F.struct(F.col("named").alias("targetOpID")))).alias("payload"))
    return L.texts(L.taking_part(base.unionByName(undo)))


def operation_inline(spark, sf_dir):
    rows = log_of(
        events(spark, sf_dir), view=("setText", _named(target=F.col("e"), text=_of("v"))), click=("insertTab", F.to_json(F.struct(F.col("e").alias("in")))), error=("insertBreak", F.to_json(F.struct(F.col("e").alias("in")))),
        purchase=("insertRun", F.to_json(F.struct(F.col("e").alias("in"), F.lit(0).alias("position"), F.struct(_of("r").alias("text")).alias("run")))),
        signup=("setRuns", _named(target=F.col("e"), runs=F.array(F.struct(_of("p").alias("text")), F.struct(F.lit("q").alias("text"))))),
    )
    runs = L.inline_content(rows)
    return runs.select("doc_id", "element", F.array_join("runs", "|").alias("content"))


def operation_cells(spark, sf_dir):
    return L.cell_texts(log_of(events(spark, sf_dir), view=("setCellText", _named(table=F.col("e"), row=F.col("event_id") % 3, column=F.col("event_id") % 2, text=_of("v"))))).withColumns({c: F.col(c).cast("long") for c in ("row", "column")})


def operation_run_formats(spark, sf_dir):
    rows = log_of(events(spark, sf_dir), view=("setRunFormat", _named(target=F.col("e"), format=F.struct((F.col("event_id") % 2 == 0).alias("bold")))), click=("setRunFormat", _named(target=F.col("e"), format=F.struct(_of("c").alias("color")))))
    return L.run_formats(rows, ("bold", "color"))


def operation_styles_defined(spark, sf_dir):
    return L.styles_defined(log_of(events(spark, sf_dir), signup=("defineStyle", _named(payload=F.struct(F.col("e").alias("styleId"), _of("n").alias("name"))))))


def operation_parts(spark, sf_dir):
    rows = log_of(events(spark, sf_dir), view=("carryPart", _named(partPath=_of("p/", "element"), xml=_of("<x>"))), click=("carryBinaryPart", _named(partPath=_of("p/", "element"), base64=F.base64(F.encode(_of("b"), "UTF-8")))))
    return L.carried_parts(rows).select("doc_id", "part_path", F.sha2("content", 256).alias("sha256"))


def operation_marks(spark, sf_dir):
    rows = log_of(events(spark, sf_dir), view=("insertBookmark", _named(at=F.col("e"), bookmarkId=F.col("event_id"), name=_of("n"))), click=("insertComment", _named(anchor=F.col("e"), commentId=F.col("event_id"), text=_of("t"), author="ann")))
    marks = L.bookmarks_inserted(rows).select("doc_id", "element", "id", F.col("name").alias("text"), F.lit("bookmark").alias("kind"))
    return marks.unionByName(L.comments_inserted(rows).select("doc_id", "element", "id", "text", F.lit("comment").alias("kind"))).withColumn("id", F.col("id").cast("long"))


def operation_components(spark, sf_dir):
    rows = log_of(events(spark, sf_dir), signup=("beginComponent", _named(id=F.col("e"), type="T")), error=("endComponent", _named(id=F.col("e"))))
    return L.components(rows)


def operation_sections(spark, sf_dir):
    rows = log_of(events(spark, sf_dir), view=("setSectionProperties", _named(at=F.when(F.col("element") > 0, F.col("e")), section=F.struct(F.col("event_id").alias("width")))))
    return L.sections(rows).select("doc_id", "element", F.try_variant_get("value", "$.width", "long").alias("width"))


def operation_roots(spark, sf_dir):
    rows = log_of(events(spark, sf_dir), view=("setDocumentProlog", _named(prolog=_of("p"))), click=("setDocumentRoot", _named(attributes=F.array(F.struct(_of("a").alias("name"))))))
    return L.roots(rows)


def operation_links(spark, sf_dir):
    return L.links_wrapped(log_of(events(spark, sf_dir), click=("wrapWithHyperlink", _named(target=F.col("e"), rId=_of("rId"))))).withColumnRenamed("value", "r_id")


def operation_blocks(spark, sf_dir):
    """view appends a paragraph, click puts one after the last appended, purchase sets that one's text, error removes what a click just before it put in."""
    rows = events(spark, sf_dir)
    rows = rows.withColumn("last", nearest_before(rows, ["doc_id"], "seq", F.when(F.col("op") == "view", F.col("id"))))
    w = L.Window.partitionBy("doc_id").orderBy("seq")
    rows = rows.withColumn("before", F.lag("op").over(w)).withColumn("before_id", F.lag("id").over(w)).where("op = 'view' OR (last IS NOT NULL AND (op <> 'error' OR before = 'click'))")
    log = log_of(
        rows,
        view=("appendParagraph", _named(paragraph=F.struct(_of("p").alias("paraId"), _of("v").alias("text")))),
        click=("insertParagraphAfter", _named(after=_of("p", "last"), paragraph=F.struct(_of("p").alias("paraId"), _of("c").alias("text"), F.lit("S").alias("styleId")))),
        purchase=("setText", _named(target=_of("p", "last"), text=_of("t"))),
        error=("removeParagraph", _named(id=_of("p", "before_id"))),
    )
    base = table(spark, sf_dir, "events").limit(0).select(F.lit("").alias("doc_id"), F.lit(0).alias("ord"), *(F.lit("").alias(c) for c in ("element", "text", "style", "kind")))
    return replay(L.blocks(log), base.to(replay_schema())).select("doc_id", F.col("ord").cast("long").alias("ord"), "element", "text", "style")


def replay_schema():
    from pyspark.sql.types import StructType

    return StructType.fromDDL(SCHEMA)


QUERIES = {
    f.__name__: f
    for f in (
        operation_texts, operation_styles, operation_attributes, operation_relationships, operation_elements, operation_unknown, operation_batches, operation_inline, operation_cells, operation_run_formats, operation_styles_defined, operation_parts,
        operation_marks, operation_components, operation_sections, operation_roots, operation_links, operation_blocks,
    )
}

_E = """(SELECT CAST(user_id AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS el,
         'e' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 7) AS element, event_type AS op, event_id AS id FROM events)"""
_UNDONE = f"(SELECT doc_id, last_value(CASE WHEN op = 'view' THEN seq END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seq, op FROM {_E})"
_ACTIVE = f"(SELECT * FROM {_E} WHERE (doc_id, seq) NOT IN (SELECT (doc_id, seq) FROM {_UNDONE} WHERE op = 'error' AND seq IS NOT NULL))"
SQL = {
    "operation_texts": f"SELECT doc_id, element, arg_max('v' || id, seq) AS value FROM {_ACTIVE} WHERE op = 'view' GROUP BY 1, 2",
    "operation_styles": f"SELECT doc_id, element, arg_max('s' || (id % 5), seq) AS value FROM {_E} WHERE op = 'click' GROUP BY 1, 2",
    "operation_attributes": f"SELECT doc_id, element, 'a' || (id % 3) AS name, nullif(arg_max(CASE WHEN id % 4 = 0 THEN '~' ELSE 'x' || id END, seq), '~') AS value FROM {_E} WHERE op = 'purchase' GROUP BY 1, 2, 3",
    "operation_relationships": f"SELECT doc_id, 'word/document.xml' AS part, 'rId' || id AS r_id, 't' AS type, 'u' || id AS target, 'Internal' AS mode FROM {_E} WHERE op = 'signup'",
    "operation_elements": f"""
        WITH u AS (SELECT doc_id, count(*) FILTER (seq IS NULL) AS n_none, count(*) FILTER (seq IS NOT NULL) AS n_some FROM {_UNDONE} WHERE op = 'error' GROUP BY 1)
        SELECT doc_id, CASE op WHEN 'view' THEN 'setText' WHEN 'click' THEN 'setParagraphStyle' ELSE 'updateAttribute' END AS op_type, element, count(*) AS n FROM {_E} WHERE op IN ('view', 'click', 'purchase') GROUP BY 1, 2, 3
        UNION ALL SELECT doc_id, 'addRelationship', NULL, count(*) FROM {_E} WHERE op = 'signup' GROUP BY 1
        UNION ALL SELECT doc_id, 'brandNew', NULL, n_none FROM u WHERE n_none > 0 UNION ALL SELECT doc_id, 'undo', NULL, n_some FROM u WHERE n_some > 0""",
    "operation_unknown": f"SELECT e.doc_id, e.seq, 'brandNew' AS op_type FROM {_E} e JOIN (SELECT doc_id, min(seq) AS first FROM {_E} WHERE op = 'view' GROUP BY 1) v ON v.doc_id = e.doc_id WHERE e.op = 'error' AND e.seq < v.first UNION ALL SELECT doc_id, seq, 'brandNew' FROM {_E} WHERE op = 'error' AND doc_id NOT IN (SELECT doc_id FROM {_E} WHERE op = 'view')",
    "operation_batches": f"""
        WITH m AS (SELECT doc_id, seq, op = 'signup' AS b, sum(CASE WHEN op = 'signup' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY seq) AS d FROM {_E} WHERE op IN ('signup', 'error')),
        l AS (SELECT *, d + CASE WHEN b THEN 0 ELSE 1 END AS v FROM m),
        e AS (SELECT doc_id, seq AS lo, b, lead(seq) OVER (PARTITION BY doc_id, v ORDER BY seq) AS hi, lead(b) OVER (PARTITION BY doc_id, v ORDER BY seq) AS nb FROM l),
        u AS (SELECT e.doc_id, lo, hi FROM e JOIN {_E} c ON c.doc_id = e.doc_id AND c.seq = hi + 1 AND c.op = 'click' WHERE b AND NOT nb)
        SELECT doc_id, element, arg_max('v' || id, seq) AS value FROM {_E} x WHERE op = 'view' AND NOT EXISTS (SELECT 1 FROM u WHERE u.doc_id = x.doc_id AND x.seq BETWEEN lo AND hi) GROUP BY 1, 2""",
    "operation_inline": f"""
        WITH r AS (SELECT *, coalesce(max(CASE WHEN op IN ('view', 'signup') THEN seq END) OVER (PARTITION BY doc_id, element), 0) AS s FROM {_E}),
        k AS (SELECT doc_id, element, CASE op WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 WHEN 'signup' THEN 1 ELSE 2 END AS g, CASE op WHEN 'purchase' THEN -seq ELSE seq END AS o,
                     CASE op WHEN 'purchase' THEN 'r' || id WHEN 'view' THEN 'v' || id WHEN 'signup' THEN 'p' || id || '|q' WHEN 'click' THEN chr(9) ELSE chr(10) END AS x FROM r WHERE seq >= s)
        SELECT doc_id, element, string_agg(x, '|' ORDER BY g, o) AS content FROM k GROUP BY 1, 2""",
    "operation_cells": f"SELECT doc_id, element, id % 3 AS row, id % 2 AS column, arg_max('v' || id, seq) AS value FROM {_E} WHERE op = 'view' GROUP BY 1, 2, 3, 4",
    "operation_run_formats": f"SELECT doc_id, element, CAST(arg_max(id % 2 = 0, seq) FILTER (op = 'view') AS VARCHAR) AS bold, arg_max('c' || id, seq) FILTER (op = 'click') AS color FROM {_E} WHERE op IN ('view', 'click') GROUP BY 1, 2",
    "operation_styles_defined": f"SELECT doc_id, element AS style_id, arg_min('n' || id, seq) AS name, CAST(NULL AS VARCHAR) AS based_on FROM {_E} WHERE op = 'signup' GROUP BY 1, 2",
    "operation_parts": f"SELECT doc_id, 'p/' || el AS part_path, sha256(arg_max(CASE op WHEN 'view' THEN '<x>' ELSE 'b' END || id, seq)) AS sha256 FROM {_E} WHERE op IN ('view', 'click') GROUP BY 1, 2",
    "operation_marks": f"SELECT doc_id, element, id, CASE op WHEN 'view' THEN 'n' ELSE 't' END || id AS text, CASE op WHEN 'view' THEN 'bookmark' ELSE 'comment' END AS kind FROM {_E} WHERE op IN ('view', 'click')",
    "operation_components": f"""
        WITH x AS (SELECT doc_id, element AS id, seq AS begin, op, lead(seq) OVER w AS nx, lead(op) OVER w AS nop FROM {_E} WHERE op IN ('signup', 'error') WINDOW w AS (PARTITION BY doc_id, element ORDER BY seq))
        SELECT doc_id, id, 'T' AS type, begin, CASE WHEN nop = 'error' THEN nx END AS "end" FROM x WHERE op = 'signup'""",
    "operation_sections": f"SELECT doc_id, CASE WHEN el > 0 THEN element END AS element, arg_max(id, seq) AS width FROM {_E} WHERE op = 'view' GROUP BY 1, 2",
    "operation_roots": f"""SELECT doc_id, arg_max('p' || id, seq) FILTER (op = 'view') AS prolog, arg_max('[{{"name":"a' || id || '"}}]', seq) FILTER (op = 'click') AS attributes FROM {_E} WHERE op IN ('view', 'click') GROUP BY 1""",
    "operation_links": f"SELECT doc_id, element, arg_max('rId' || id, seq) AS r_id FROM {_E} WHERE op = 'click' GROUP BY 1, 2",
    "operation_blocks": f"""
        WITH l AS (SELECT *, last_value(CASE WHEN op = 'view' THEN id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last, lead(op) OVER (PARTITION BY doc_id ORDER BY seq) AS nx FROM {_E}),
        t AS (SELECT doc_id, last, arg_max('t' || id, seq) AS text FROM l WHERE op = 'purchase' AND last IS NOT NULL GROUP BY 1, 2),
        b AS (SELECT doc_id, id, last, 0 AS g, 0 AS o, 'v' || id AS text, NULL AS style FROM l WHERE op = 'view' UNION ALL
              SELECT doc_id, id, last, 1, -seq, 'c' || id, 'S' FROM l WHERE op = 'click' AND last IS NOT NULL AND coalesce(nx, '') <> 'error'),
        f AS (SELECT doc_id, last, min(seq) AS at FROM l WHERE op = 'view' GROUP BY 1, 2)
        SELECT b.doc_id, row_number() OVER (PARTITION BY b.doc_id ORDER BY f.at, g, o) - 1 AS ord, 'p' || id AS element, CASE WHEN g = 0 THEN coalesce(t.text, b.text) ELSE b.text END AS text, style
        FROM b JOIN f ON f.doc_id = b.doc_id AND f.last = b.last LEFT JOIN t ON t.doc_id = b.doc_id AND t.last = b.last""",
}
