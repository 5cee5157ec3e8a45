"""Queries over the operation log: replay, control, fields, revisions, conflicts, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import oplog as L
from ..operators import ordered as O
from ..sources.scratch import scratch_path
from ..sources.tables import oplog, table
from ..streaming.oplog_stream import streamed_state
from ..streaming.undo_stream import streamed_texts

SETS = "op IN ('view', 'click')"
LOG = """(SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS element,
          event_type AS op, value, ts, event_id FROM events)"""
CUT = "2024-01-15 00:00:00"


def log(spark, sf_dir):
    return oplog(table(spark, sf_dir, "events"))


def sets(spark, sf_dir):
    return log(spark, sf_dir).where(SETS)


def oplog_materialize(spark, sf_dir):
    return L.materialized(sets(spark, sf_dir))


def oplog_state_at_index(spark, sf_dir):
    return L.at_index(sets(spark, sf_dir), 20)


def oplog_state_at_time(spark, sf_dir):
    return L.at_time(sets(spark, sf_dir), CUT)


def oplog_undo_redo(spark, sf_dir):
    all_ = log(spark, sf_dir)
    target = O.nearest_before(all_, ["doc_id", "element"], "seq", F.when(F.expr(SETS), F.col("seq")))
    controls = all_.withColumn("target", target).where("op IN ('error', 'signup') AND target IS NOT NULL").select("doc_id", "target", "seq", F.when(F.col("op") == "error", "undo").otherwise("redo").alias("kind"))
    return L.materialized(L.active(all_.where(SETS), controls))


def oplog_stream_undo(spark, sf_dir):
    """oplog_undo_redo as a stream: controls name operations by their ids, in files of no order, four files a batch."""
    all_ = log(spark, sf_dir)
    is_set, op = F.expr(SETS), F.col("event_id").cast("string")
    target = O.nearest_before(all_, ["doc_id", "element"], "seq", F.when(is_set, F.col("seq")))
    named = all_.select("doc_id", F.col("seq").alias("_named"), op.alias("target"))
    rows = all_.withColumn("_named", F.when(F.col("op").isin("error", "signup"), target)).where(is_set | F.col("_named").isNotNull()).join(named, ["doc_id", "_named"], "left")
    kind = F.when(is_set, "setText").when(F.col("op") == "error", "undo").otherwise("redo")
    flat = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "seq", op.alias("op_id"), kind.alias("op_type"), F.when(is_set, F.col("element").cast("string")).alias("element"), F.when(is_set, F.col("value").cast("string")).alias("value"), "target")
    path = scratch_path(spark, "undo-log")
    flat.write.parquet(path)
    return streamed_texts(spark, path, files=4).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("element").cast("long").alias("element"), F.col("value").cast("double").alias("value"), "seq")


def oplog_batch_members(spark, sf_dir):
    found = O.nested_pairs(log(spark, sf_dir), ["doc_id"], "seq", F.col("op") == "signup", F.col("op") == "error")
    return found.select("doc_id", "begin", "end", (F.col("end") - F.col("begin") - 1).alias("members"))


def oplog_blame(spark, sf_dir):
    return L.blame(log(spark, sf_dir))


def oplog_previous_value(spark, sf_dir):
    return L.previous_values(sets(spark, sf_dir)).select("doc_id", "element", "seq", "value", "previous")


def define_style_first(spark, sf_dir):
    return L.first_definitions(log(spark, sf_dir).where("op = 'purchase'"), "element")


def _sides(spark, sf_dir):
    all_ = log(spark, sf_dir)
    return all_.where("op = 'click' AND value > 40"), all_.where("op = 'purchase'")


def conflict_detect(spark, sf_dir):
    return L.conflicts(*_sides(spark, sf_dir))


def conflict_swift_wins(spark, sf_dir):
    return L.resolved(*_sides(spark, sf_dir), "local_wins").select("doc_id", "element", "seq")


def conflict_word_wins(spark, sf_dir):
    return L.resolved(*_sides(spark, sf_dir), "outside_wins").select("doc_id", "element", "seq")


def _fields(spark, sf_dir):
    return O.seq_counter(log(spark, sf_dir), ["doc_id"], "op", "seq", (F.col("op") == "signup").cast("int"))


def seq_counter(spark, sf_dir):
    return _fields(spark, sf_dir).select("doc_id", "seq", "op", F.col("value").alias("number"))


def seq_final_value(spark, sf_dir):
    return _fields(spark, sf_dir).groupBy("doc_id", "op").agg(F.max_by("value", "seq").alias("number"))


def field_parse_seq(spark, sf_dir):
    code = F.concat(F.lit("SEQ "), F.col("op"), F.when(F.col("op") == "view", F.lit(r" \* ARABIC")).when(F.col("op") == "click", F.lit(r" \* ROMAN \s 2")).otherwise(F.lit(r" \x 1")))
    rows = log(spark, sf_dir).select("doc_id", "seq", code.alias("code"))
    grammar = r"^SEQ ([A-Za-z_]+)( \\\* (ARABIC|ROMAN))?( \\s ([0-9]+))?$"
    part = lambda k: F.when(F.col("code").rlike(grammar), F.nullif(F.regexp_extract("code", grammar, k), F.lit("")))
    return rows.select("doc_id", "seq", part(1).alias("identifier"), part(3).alias("format"), part(5).cast("long").alias("reset_level"))


def if_field(spark, sf_dir):
    return log(spark, sf_dir).select("event_id", F.when(F.col("value") >= 50, "large").otherwise("small").alias("shown"))


def date_field(spark, sf_dir):
    return log(spark, sf_dir).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("shown"))


def style_ref_nearest(spark, sf_dir):
    all_ = log(spark, sf_dir)
    return all_.select("doc_id", "seq", O.nearest_before(all_, ["doc_id"], "seq", F.when(F.col("op") == "signup", F.col("event_id"))).alias("heading"))


def adjacent_run_groups(spark, sf_dir):
    return O.islands(log(spark, sf_dir), ["doc_id"], "seq", "op")


def revisions_by_author(spark, sf_dir):
    return log(spark, sf_dir).where("op IN ('click', 'error')").groupBy("doc_id", "op").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


def revisions_by_type(spark, sf_dir):
    return log(spark, sf_dir).groupBy("op").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("authors"))


def _revised(spark, sf_dir, dropped):
    kept = log(spark, sf_dir).where(F.col("op") != dropped)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "event_id"))), lambda x: x["event_id"].cast("string")), " ")
    return kept.groupBy("doc_id").agg(text.alias("body"), F.count("*").alias("runs"))


def accept_revisions(spark, sf_dir):
    """Insertions (click) stay, deletions (error) go, all else is text."""
    return _revised(spark, sf_dir, "error")


def reject_revisions(spark, sf_dir):
    """Deletions come back, insertions go."""
    return _revised(spark, sf_dir, "click")


def oplog_resumed(spark, sf_dir):
    early = L.materialized(sets(spark, sf_dir).where("seq <= 30"))
    return L.resumed(early, sets(spark, sf_dir).where("seq > 30"))


def cell_text_state(spark, sf_dir):
    rows = log(spark, sf_dir).where(SETS).withColumn("row", F.col("event_id") % 3).withColumn("col", F.col("element") % 2)
    return rows.groupBy("doc_id", "row", "col").agg(F.max_by("value", "seq").alias("value"))


def run_format_state(spark, sf_dir):
    rows = log(spark, sf_dir).select("doc_id", "element", "seq", F.when(F.col("op") == "view", F.col("value")).alias("size"), F.when(F.col("op") == "click", F.col("event_id")).alias("color"))
    return L.attribute_state(rows, ["doc_id", "element"], ["size", "color"])


def touches_element(spark, sf_dir):
    hot = log(spark, sf_dir).where("op = 'purchase' AND value > 100")
    return L.touching(log(spark, sf_dir), hot).select("doc_id", "element", "seq", "op")


def oplog_stream_state(spark, sf_dir):
    return streamed_state(spark, f"{sf_dir}/events.parque[t]")  # a pattern, as a stream takes a single file by no other name


QUERIES = {
    f.__name__: f
    for f in (
        oplog_materialize, oplog_state_at_index, oplog_state_at_time, oplog_undo_redo, oplog_stream_undo, oplog_batch_members, oplog_blame, oplog_previous_value, define_style_first, conflict_detect, conflict_swift_wins, conflict_word_wins,
        seq_counter, seq_final_value, field_parse_seq, if_field, date_field, style_ref_nearest, adjacent_run_groups, revisions_by_author, revisions_by_type, accept_revisions, reject_revisions, oplog_resumed, cell_text_state, run_format_state, touches_element, oplog_stream_state,
    )
}


def _state(where: str) -> str:
    return f"SELECT doc_id, element, arg_max(value, seq) AS value, max(seq) AS seq FROM {LOG} WHERE op IN ('view', 'click'){where} GROUP BY doc_id, element"


_NUMBERED = f"""
    WITH h AS (SELECT *, sum(CASE WHEN op = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS h FROM {LOG}),
    p AS (SELECT *, lag(h) OVER (PARTITION BY doc_id, op ORDER BY seq) AS ph FROM h WHERE op <> 'signup'),
    g AS (SELECT *, sum(CASE WHEN h <> coalesce(ph, -1) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, op ORDER BY seq) AS g FROM p),
    n AS (SELECT doc_id, seq, op, row_number() OVER (PARTITION BY doc_id, op, g ORDER BY seq) AS number FROM g)"""
_CONFLICT = f"WITH l AS (SELECT doc_id, element, min(seq) AS local_seq FROM {LOG} WHERE op = 'click' AND value > 40 GROUP BY 1, 2), o AS (SELECT doc_id, element, seq FROM {LOG} WHERE op = 'purchase')"
_REVISED = "SELECT doc_id, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY seq) AS body, count(*) AS runs FROM {0} WHERE op <> '{1}' GROUP BY doc_id"
SQL = {
    "oplog_materialize": _state(""),
    "oplog_state_at_index": _state(" AND seq <= 20"),
    "oplog_state_at_time": _state(f" AND ts <= TIMESTAMP '{CUT}'"),
    "oplog_undo_redo": f"""
        WITH l AS {LOG}, t AS (SELECT *, last_value(CASE WHEN op IN ('view', 'click') THEN seq END IGNORE NULLS) OVER (PARTITION BY doc_id, element ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS target FROM l),
        c AS (SELECT doc_id, target, arg_max(op, seq) AS last FROM t WHERE op IN ('error', 'signup') AND target IS NOT NULL GROUP BY 1, 2),
        a AS (SELECT l.* FROM l LEFT JOIN c ON c.doc_id = l.doc_id AND c.target = l.seq WHERE l.op IN ('view', 'click') AND coalesce(c.last, 'signup') = 'signup')
        SELECT doc_id, element, arg_max(value, seq) AS value, max(seq) AS seq FROM a GROUP BY 1, 2""",
    "oplog_batch_members": f"""
        WITH m AS (SELECT doc_id, seq, op = 'signup' AS b, sum(CASE WHEN op = 'signup' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY seq) AS d FROM {LOG} WHERE op IN ('signup', 'error')),
        l AS (SELECT *, d + CASE WHEN b THEN 0 ELSE 1 END AS v FROM m),
        e AS (SELECT doc_id, seq AS begin, b, lead(seq) OVER (PARTITION BY doc_id, v ORDER BY seq) AS "end" FROM l)
        SELECT doc_id, begin, "end", "end" - begin - 1 AS members FROM e WHERE b AND "end" IS NOT NULL""",
    "oplog_blame": f"SELECT doc_id, element, max(seq) AS seq, arg_max(op, seq) AS op FROM {LOG} GROUP BY 1, 2",
    "oplog_previous_value": f"SELECT doc_id, element, seq, value, lag(value) OVER (PARTITION BY doc_id, element ORDER BY seq) AS previous FROM {LOG} WHERE op IN ('view', 'click')",
    "define_style_first": f"SELECT doc_id, element, arg_min(value, seq) AS value, min(seq) AS seq FROM {LOG} WHERE op = 'purchase' GROUP BY 1, 2",
    "conflict_detect": f"{_CONFLICT} SELECT o.doc_id, o.element, o.seq AS outside_seq, l.local_seq FROM o JOIN l ON l.doc_id = o.doc_id AND l.element = o.element",
    "conflict_swift_wins": f"{_CONFLICT} SELECT o.doc_id, o.element, o.seq FROM o LEFT JOIN l ON l.doc_id = o.doc_id AND l.element = o.element WHERE l.doc_id IS NULL",
    "conflict_word_wins": f"SELECT doc_id, element, seq FROM {LOG} WHERE op = 'purchase'",
    "seq_counter": f"{_NUMBERED} SELECT doc_id, seq, op, number FROM n",
    "seq_final_value": f"{_NUMBERED} SELECT doc_id, op, arg_max(number, seq) AS number FROM n GROUP BY 1, 2",
    "field_parse_seq": f"""
        WITH c AS (SELECT doc_id, seq, op, CASE op WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS k FROM {LOG})
        SELECT doc_id, seq, CASE WHEN k < 2 THEN op END AS identifier, CASE k WHEN 0 THEN 'ARABIC' WHEN 1 THEN 'ROMAN' END AS format, CAST(CASE WHEN k = 1 THEN 2 END AS BIGINT) AS reset_level FROM c""",
    "if_field": "SELECT event_id, CASE WHEN value >= 50 THEN 'large' ELSE 'small' END AS shown FROM events",
    "date_field": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS shown FROM events",
    "style_ref_nearest": f"SELECT doc_id, seq, last_value(CASE WHEN op = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM {LOG}",
    "adjacent_run_groups": f"""
        WITH c AS (SELECT *, CASE WHEN op IS NOT DISTINCT FROM lag(op) OVER (PARTITION BY doc_id ORDER BY seq) THEN 0 ELSE 1 END AS c FROM {LOG}),
        g AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY seq) AS g FROM c)
        SELECT doc_id, op, min(seq) AS first, count(*) AS size FROM g GROUP BY doc_id, op, g""",
    "revisions_by_author": f"SELECT doc_id, op, count(*) AS n, min(seq) AS first FROM {LOG} WHERE op IN ('click', 'error') GROUP BY 1, 2",
    "revisions_by_type": "SELECT event_type AS op, count(*) AS n, count(DISTINCT user_id) AS authors FROM events GROUP BY 1",
    "accept_revisions": _REVISED.format(LOG, "error"),
    "reject_revisions": _REVISED.format(LOG, "click"),
    "oplog_resumed": _state(""),
    "cell_text_state": f"SELECT doc_id, event_id % 3 AS row, element % 2 AS col, arg_max(value, seq) AS value FROM {LOG} WHERE op IN ('view', 'click') GROUP BY 1, 2, 3",
    "run_format_state": f"""
        SELECT doc_id, element, arg_max(value, seq) FILTER (op = 'view') AS size, arg_max(event_id, seq) FILTER (op = 'click') AS color FROM {LOG} GROUP BY 1, 2""",
    "touches_element": f"""
        WITH l AS {LOG} SELECT doc_id, element, seq, op FROM l WHERE (doc_id, element) IN (SELECT doc_id, element FROM l WHERE op = 'purchase' AND value > 100)""",
    "oplog_stream_state": """
        SELECT user_id AS doc_id, element, arg_max(value, (ts, event_id)) AS value, count(*) AS operations
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS element FROM events WHERE event_type IN ('view', 'click')) GROUP BY 1, 2""",
}
SQL["oplog_stream_undo"] = SQL["oplog_undo_redo"]
