from quirespark.sources import packages as P
from quirespark.sources import snapshots as S

PARTS = "doc_id string, part_path string, content binary"
LOG = "doc_id string, seq long, op_id string, source string"


def test_snapshots(spark, tmp_path):
    rows = [("a", "x.xml", b"<x/>"), ("a", "y.xml", b"<y/>"), ("b", "x.xml", b"<x/>"), ("c", "x.xml", b"<x/>")]
    parts = spark.createDataFrame(rows, PARTS)
    log = spark.createDataFrame([("a", 0, "p", "swift"), ("a", 1, "q", "word"), ("a", 2, "r", "swift")], LOG)
    made = S.snapshots(parts, P.xml_nodes(parts), log, "2024-01-01 00:00:00")
    S.write_snapshots(made, str(tmp_path / "s"))
    saved = S.read_snapshots(spark, str(tmp_path / "s"))
    first = {r["doc_id"]: r for r in saved.collect()}
    assert first["a"]["op_count"] == 3 and first["a"]["pending"] == ["p", "r"] and first["b"]["pending"] == [] and set(first["a"]["part_fingerprints"]) == {"x.xml", "y.xml"}
    assert {(r["doc_id"], r["state"], r["tail"]) for r in S.checked(saved, parts, log).collect()} == {("a", "same", 0), ("b", "same", 0), ("c", "same", 0)}
    later = spark.createDataFrame([("a", "x.xml", b"<x/>"), ("a", "y.xml", b"<y>1</y>"), ("a", "z.xml", b"<z/>"), ("b", "x.xml", b"<x/>"), ("d", "x.xml", b"<x/>")], PARTS)
    more = log.unionByName(spark.createDataFrame([("b", 0, "s", "swift")], LOG))
    got = {r["doc_id"]: (r["state"], r["changed"], r["tail"]) for r in S.checked(saved, later, more).collect()}
    assert got == {"a": ("changed", ["y.xml", "z.xml"], 0), "b": ("same", [], 1), "c": ("gone", [], 0), "d": ("new", [], 0)}
