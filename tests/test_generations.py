"""Commits of packages, logs and snapshots: whole or not at all, and one of two writers first."""

import pytest

from quirespark.sources import generations as G

PARTS, LOG = "doc_id string, part_path string, content binary", "doc_id string, seq long, op_id string, source string"


def given(spark, docs):
    """A part and an operation for each document; its text is the value."""
    parts = spark.createDataFrame([(d, "word/document.xml", f"<d>{t}</d>".encode()) for d, t in docs.items()], PARTS)
    return parts, spark.createDataFrame([(d, 0, t, "swift") for d, t in docs.items()], LOG)


def saved(spark, root, docs, expected, **more):
    return G.commit(spark, root, *given(spark, docs), expected, "2024-01-01 00:00:00", **more)


def seen(spark, root, number=None):
    now = G.read(spark, root, number)
    texts = {r["doc_id"]: bytes(r["content"]).decode()[3:-4] for r in now["parts"].collect()}
    assert texts == {r["doc_id"]: r["op_id"] for r in now["log"].collect()} == {r["doc_id"]: r["pending"][0] for r in now["snapshots"].collect()}
    assert set(texts) == {r["doc_id"] for r in now["documents"].collect()}
    return texts


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/store"


def test_commits_and_what_they_saw(spark, root):
    assert G.head(spark, root) == 0
    with pytest.raises(ValueError, match="no commit"):
        G.read(spark, root)
    assert saved(spark, root, {"a": "1", "b": "1"}, 0) == 1
    assert saved(spark, root, {"b": "2", "c": "2"}, 1, removed=spark.createDataFrame([("a",)], "doc_id string")) == 2
    assert seen(spark, root, 1) == {"a": "1", "b": "1"} and seen(spark, root) == {"b": "2", "c": "2"}
    assert G.compact(spark, root, "2024-01-02 00:00:00") == 3
    assert seen(spark, root) == {"b": "2", "c": "2"}
    assert saved(spark, root, {"c": "4"}, 3) == 4 and seen(spark, root) == {"b": "2", "c": "4"} and seen(spark, root, 1) == {"a": "1", "b": "1"}


def test_a_writer_that_dies_leaves_the_old_or_the_new(spark, root):
    saved(spark, root, {"a": "1", "b": "1"}, 0)
    for stop in ("parts", "log", "snapshots", "documents", "manifest"):

        def die(name, stop=stop):
            if name == stop:
                raise KeyboardInterrupt

        with pytest.raises(KeyboardInterrupt):
            saved(spark, root, {"a": "new"}, 1, step=die)
        assert seen(spark, root) == {"a": "new" if stop == "manifest" else "1", "b": "1"}, stop


def test_two_writers(spark, root):
    """Both have read commit 1; the second one's documents decide."""
    saved(spark, root, {"a": "1", "b": "1"}, 0)
    assert saved(spark, root, {"a": "2"}, 1) == 2
    with pytest.raises(G.Conflict):
        saved(spark, root, {"a": "3"}, 1)
    with pytest.raises(G.Conflict):
        saved(spark, root, {"b": "3"}, 1, full=True)
    assert saved(spark, root, {"b": "3"}, 1) == 3
    assert seen(spark, root) == {"a": "2", "b": "3"}


def test_a_number_goes_once(spark, root):
    """A commit that comes between another's look and its manifest."""
    saved(spark, root, {"a": "1"}, 0)

    def other(name):
        if name == "documents":
            saved(spark, root, {"b": "2"}, 1)

    assert saved(spark, root, {"c": "3"}, 1, step=other) == 3
    assert not G._publish(spark, root, 3, "late", False)
    assert seen(spark, root) == {"a": "1", "b": "2", "c": "3"}
