"""The streamed state equals the batch's, however the rows are cut into files."""

from quirespark.streaming.oplog_stream import element_state, streamed_state

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(EVENTS)
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in streamed_state(spark, str(tmp_path / "in")).collect()}
    assert got == {tuple(r) for r in element_state(events).collect()}


def test_a_content_comes_once(spark, tmp_path):
    from quirespark.streaming.changes import changed_files

    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    run = lambda: changed_files(spark, str(inbox)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start(out).awaitTermination()
    (inbox / "a.bin").write_bytes(b"one")
    run()
    (inbox / "b.bin").write_bytes(b"two")
    run()
    rows = [(r["path"].rpartition("/")[2], r["sha256"]) for r in spark.read.parquet(out).collect()]
    assert sorted(n for n, _ in rows) == ["a.bin", "b.bin"] and len({h for _, h in rows}) == 2
