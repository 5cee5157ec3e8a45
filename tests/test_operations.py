"""Operations of a log, small cases and errors; text and header functions."""

import struct

import pytest
from pyspark.sql import functions as F

from quirespark.operators import operations as L
from quirespark.operators import text as T
from quirespark.sources import package_tables as X
from quirespark.sources import packages as P


def log(spark, *rows):
    """(op_id, op_type, JSON of its fields) in order, one document."""
    df = spark.createDataFrame([("d", k, i, t, j) for k, (i, t, j) in enumerate(rows)], "doc_id string, seq long, op_id string, op_type string, j string")
    return df.withColumn("payload", F.parse_json("j")).drop("j")


SET = '{{"target":"{0}","text":"{1}"}}'.format


def state(df):
    return {r["element"]: r["value"] for r in L.texts(L.taking_part(df)).collect()}


def test_undo_of_operations_and_batches(spark):
    rows = [("a", "setText", SET("e", "1")), ("b", "batchBegin", "{}"), ("c", "setText", SET("e", "2")), ("x", "batchBegin", "{}"), ("y", "setText", SET("f", "3")), ("z", "batchEnd", "{}"), ("w", "batchEnd", "{}")]
    undo = lambda i, t="undo": (f"{t}{i}", t, f'{{"targetOpID":"{i}"}}')
    assert state(log(spark, *rows)) == {"e": "2", "f": "3"}
    assert state(log(spark, *rows, undo("b"))) == {"e": "1"}
    assert state(log(spark, *rows, undo("x"))) == {"e": "2"}
    assert state(log(spark, *rows, undo("b"), undo("b", "redo"))) == {"e": "2", "f": "3"}
    assert state(log(spark, *rows, undo("a"), undo("b"))) == {}
    for bad in (undo("q"), undo("z"), undo("a", "redo")):
        with pytest.raises(Exception, match="can't"):
            state(log(spark, *rows, bad))
    with pytest.raises(Exception, match="can't"):
        state(log(spark, *rows[:2], undo("b")))  # not closed yet
    whole = log(spark, *rows, undo("b"))
    control = spark.createDataFrame([("d", "undob")], "doc_id string, op_id string")
    assert {(r["element"], r["text"]) for r in L.replacements(whole, control).collect()} == {("e", "1"), ("f", "")}


def test_content_of_a_paragraph(spark):
    rows = [("a", "setText", SET("e", "one")), ("b", "insertRun", '{"in":"e","position":0,"run":{"text":"zero"}}'), ("c", "insertTab", '{"in":"e"}'), ("d", "insertRun", '{"in":"e","position":99,"run":{"text":"end"}}'), ("e", "insertNoBreakHyphen", '{"in":"f"}')]
    got = {r["element"]: r["runs"] for r in L.inline_content(log(spark, *rows)).collect()}
    assert got == {"e": ["zero", "one", "\t", "end"], "f": ["‑"]}
    rows += [("g", "setRuns", '{"target":"e","runs":[{"text":"p"},{"text":"q"}]}')]
    assert {r["element"]: r["runs"] for r in L.inline_content(log(spark, *rows)).collect()}["e"] == ["p", "q"]


def test_relationships_twice(spark):
    one = '{"part":"p","id":"r","type":"t","target":"u"}'
    assert L.relationships_added(log(spark, ("a", "addRelationship", one), ("b", "addRelationship", one))).count() == 1
    with pytest.raises(Exception, match="two relationships"):
        L.relationships_added(log(spark, ("a", "addRelationship", one), ("b", "addRelationship", one.replace('"u"', '"v"')))).collect()


def test_literals_are_no_patterns(spark):
    df = spark.createDataFrame([(1, 0, "axb a.b a.b"), (1, 1, ""), (1, 2, None)], "doc_id int, ord int, text string")
    assert {(r["ord"], r["lo"], r["hi"]) for r in T.literal_matches(df, "a.b").collect()} == {(0, 4, 7), (0, 8, 11)} and T.literal_matches(df, "").count() == 0
    spans = spark.createDataFrame([(1, 0, 6, 9)], "doc_id int, ord int, lo long, hi long")
    assert {(r["lo"], r["hit"]) for r in T.flagged(T.literal_matches(df, "a.b"), spans, 4).collect()} == {(4, True), (8, True)}


def test_names_and_image_headers(spark):
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"x" * 14 + b"\xff\xdb" + struct.pack(">H", 5) + b"abc" + b"\xff\xc2" + struct.pack(">HBHH", 17, 8, 300, 640) + b"y" * 20
    df = spark.createDataFrame([(jpeg,), (b"\xff\xd8\xff",), (b"",), (None,)], "content binary")
    sizes = [r["s"] and (r["s"]["width"], r["s"]["height"]) for r in df.select(P.image_size(F.col("content")).alias("s")).collect()]
    assert sizes == [(640, 300), None, None, None]
    names = spark.createDataFrame([("media/a.JPG",), ("x.png",), ("noend",)], "p string")
    assert [r[0] for r in names.select(X.image_type(F.col("p"))).collect()] == ["image/jpeg", "image/png", "application/octet-stream"]
    marks = spark.createDataFrame([("ok",), ("1a",), ("a b",), ("",), ("x" * 41,)], "n string")
    assert [r[0] for r in marks.select(T.valid_bookmark_name(F.col("n"))).collect()] == [True, False, False, False, False]
