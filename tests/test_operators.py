"""Laws and small cases of the operators."""

import pytest
from pyspark.sql import functions as F

from quirespark.operators import compare, oplog, ordered, replay, styles, text

LOG = "doc_id int, seq long, element string, op string, value string, ts string"


def test_replay_of_a_prefix_and_its_tail(spark):
    ops = "doc_id string, seq int, op string, target string, element string, text string"
    base = spark.createDataFrame([("d", k, e, e.upper(), None, None) for k, e in enumerate("abc")], replay.SCHEMA)
    ops += ", style string"
    steps = [("d", 1, "insertAfter", "a", "x", "new", None), ("d", 2, "move", "c", None, None, None), ("d", 3, "setText", "b", None, "bee", None), ("d", 4, "remove", "a", None, None, None), ("d", 5, "append", None, "z", "end", None), ("d", 6, "setStyle", "z", None, None, "H1")]
    whole = replay.replay(spark.createDataFrame(steps, ops), base).orderBy("ord").collect()
    part = replay.replay(spark.createDataFrame(steps[3:], ops), replay.replay(spark.createDataFrame(steps[:3], ops), base)).orderBy("ord").collect()
    assert whole == part
    assert [(r["element"], r["text"], r["style"]) for r in whole] == [("c", "C", None), ("x", "new", None), ("b", "bee", None), ("z", "end", "H1")]
    with pytest.raises(Exception, match="no element"):
        replay.replay(spark.createDataFrame([("d", 1, "remove", "q", None, None, None)], ops), base).collect()
    odd = spark.createDataFrame([("d", 1, "shuffle", "a", None, None, None)], ops)
    with pytest.raises(Exception, match="does not know"):
        replay.replay(odd, base).collect()
    assert replay.replay(odd, base, ("shuffle",)).count() == 3


def test_replay_is_a_plain_fold(spark):
    """A random log against list edits."""
    import random

    rng, order, steps, n = random.Random(4), ["a", "b"], [], 0
    for seq in range(400):
        kind = rng.choice(["insertAfter", "insertBefore", "append", "remove", "move"])
        if kind == "append" or not order:
            order.append(f"n{n}")
            steps.append(("d", seq, "append", None, f"n{n}", "t"))
            n += 1
        elif kind in ("insertAfter", "insertBefore"):
            at = rng.choice(order)
            order.insert(order.index(at) + (kind == "insertAfter"), f"n{n}")
            steps.append(("d", seq, kind, at, f"n{n}", "t"))
            n += 1
        elif kind == "remove":
            order.remove(gone := rng.choice(order))
            steps.append(("d", seq, kind, gone, None, None))
        elif len(order) > 1:
            moved, to = rng.sample(order, 2)
            order.remove(moved)
            order.insert(order.index(to) + 1, moved)
            steps.append(("d", seq, kind, moved, to, None))
    base = spark.createDataFrame([("d", k, e, "", None, None) for k, e in enumerate("ab")], replay.SCHEMA)
    got = replay.replay(spark.createDataFrame(steps, "doc_id string, seq int, op string, target string, element string, text string"), base)
    assert [r["element"] for r in got.orderBy("ord").collect()] == order


def test_undo_then_redo_is_the_identity(spark):
    log = spark.createDataFrame([(1, 1, "a", "set", "x", ""), (1, 2, "a", "set", "y", ""), (1, 3, "b", "set", "z", "")], LOG)
    control = "doc_id int, target long, seq long, kind string"
    state = lambda rows: {(r["element"], r["value"]) for r in oplog.materialized(oplog.active(log, spark.createDataFrame(rows, control))).collect()}
    assert state([(1, 2, 4, "undo")]) == {("a", "x"), ("b", "z")}
    assert state([(1, 2, 4, "undo"), (1, 2, 5, "redo")]) == state([]) == {("a", "y"), ("b", "z")}
    assert state([(1, 2, 1, "undo")]) == state([])


def test_conflict_policies(spark):
    log = spark.createDataFrame([(1, 1, "a", "set", "x", ""), (1, 2, "b", "set", "y", "")], LOG)
    local = log.where("element = 'a'")
    assert [r["element"] for r in oplog.resolved(local, log, "local_wins").collect()] == ["b"]
    assert oplog.resolved(local, log, "outside_wins").count() == 2
    with pytest.raises(Exception, match="conflicts"):
        oplog.resolved(local, log, "abort").collect()


def test_a_generation_does_not_differ_from_itself(spark):
    p = spark.createDataFrame([(1, k, k if k % 2 else None, t) for k, t in enumerate(["x", "y", "x", "z", None])], "doc_id int, ord int, stable_id int, text string")
    assert compare.paragraph_diff(p, p).count() == 0
    moved = p.withColumn("ord", 10 - F.col("ord"))
    assert compare.paragraph_diff(p, moved).count() == 0


def test_coverage_of_nothing_is_zero(spark):
    p = spark.createDataFrame([(1, 0, 0)], "doc_id int, covered int, total int")
    assert compare.coverage(p, ["doc_id"], "covered", "total").first()["ratio"] == 0


def test_chains_deep_and_broken(spark):
    rows = [(1, k, k - 1 if k else None) for k in range(40)] + [(2, 5, 99)]
    got = {(r["g"], r["id"]): (r["depth"], r["root"]) for r in styles.chains(spark.createDataFrame(rows, "g int, id int, parent int"), ["g"]).collect()}
    assert all(got[1, k] == (k, 0) for k in range(40)) and got[2, 5] == (0, 5)


def test_chains_past_64_and_cycles(spark):
    rows = [(1, k, k - 1 if k else None) for k in range(200)] + [(2, 0, 2), (2, 1, 0), (2, 2, 1), (2, 3, 2), (2, 4, None), (2, 5, 4)]
    got = {(r["g"], r["id"]): (r["depth"], r["root"]) for r in styles.chains(spark.createDataFrame(rows, "g int, id int, parent int"), ["g"]).collect()}
    assert all(got[1, k] == (k, 0) for k in range(200))
    assert [got[2, k] for k in range(6)] == [(None, None)] * 4 + [(0, 4), (1, 4)]


def test_nested_pairs(spark):
    log = spark.createDataFrame([(1, k, c) for k, c in enumerate("e(a(b)(c)d)(", 1)], "d int, seq int, c string")
    got = ordered.nested_pairs(log, ["d"], "seq", F.col("c") == "(", F.col("c") == ")").collect()
    assert {(r["begin"], r["end"]) for r in got} == {(2, 11), (4, 6), (7, 9)}


def test_fold_and_names(spark):
    df = spark.createDataFrame([("Être x²",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.folded("t")).collect()] == ["Etre x2", None, ""]
    one = spark.createDataFrame([("1 a/b",)], "t string").select(text.bookmark_name(F.col("t")), text.escape_xml(F.lit("<a b='c'>&")), text.safe_relative_path(F.lit("a/../b")), text.safe_relative_path(F.lit("word/a.xml"))).first()
    assert tuple(one) == ("_1_a_b", "&lt;a b=&apos;c&apos;&gt;&amp;", False, True)


def test_import_keeps_local_edits(spark):
    schema = "doc_id int, ord int, stable_id string, text string"
    old = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "b", "y"), (1, 2, None, "z")], schema)
    new = spark.createDataFrame([(1, 0, "a", "x!"), (1, 1, "b", "y!"), (1, 2, None, "z"), (1, 3, None, "w")], schema)
    pending = spark.createDataFrame([(1, "a", 7)], "doc_id int, element string, seq int")
    kinds = lambda policy: sorted((r["kind"], r["element"]) for r in oplog.imported(old, new, pending, policy).select("kind", F.coalesce("element", F.lit("-")).alias("element")).collect())
    assert kinds("local_wins") == [("insert", "-"), ("setText", "b")]
    assert kinds("outside_wins") == [("insert", "-"), ("setText", "a"), ("setText", "b")]


def test_first_divergence(spark):
    df = spark.createDataFrame([(b"abc", b"abd"), (b"ab", b"abc"), (b"x", b"x"), (None, b"")], "a binary, b binary")
    assert [r[0] for r in df.select(compare.first_divergence(F.col("a"), F.col("b"))).collect()] == [2, 2, None, None]
