import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirespark.llm import fingerprints as P
from quirespark.llm import warc as A


def runs(text, size=P.SHINGLE):
    """The set of a text's shingles as tuples of words, by plain Python."""
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


@pytest.fixture(scope="module")
def hash_of_run():
    """The one hash of a shingle that stands alone, with every hash kept."""
    seen = {}

    def look(run):
        if run not in seen:
            (seen[run],) = P.sketch(b" ".join(run), share=1).tolist()
        return seen[run]

    return look


def test_fingerprints(docs, empty, hash_of_run):
    """Against sets of word tuples: fingerprints hold the hash of each shingle below the threshold and no other."""
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    rows = {r["doc_id"]: r for r in P.fingerprints(docs).collect()}
    assert len(rows) == len(texts)
    top = 2**P.BITS // P.SHARE

    def plain(text):
        return {h for h in map(hash_of_run, runs(text)) if h < top}

    def alike(x, y):
        a, b = plain(x), plain(y)
        return len(a & b) / len(a | b) if a | b else float(runs(x) == runs(y))

    ids = sorted(texts)
    for k, i in enumerate(ids):
        follows = texts[ids[(k + 1) % len(ids)]]
        cut = len(texts[i]) // 2
        e, r = texts[i][: len(texts[i]) - cut] + follows[:cut], rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(texts[i]), hashlib.sha256(e.encode()).hexdigest())
        assert r["fingerprint"] == "".join(f"{h:012x}" for h in sorted(plain(texts[i]))) and r["edited_fingerprint"] == "".join(f"{h:012x}" for h in sorted(plain(e)))
        assert abs(r["near_edited"] - alike(texts[i], e)) < 1e-12 and abs(r["near_next"] - alike(texts[i], follows)) < 1e-12
        mine = plain(texts[i])
        for held, other in (("held_edited", e), ("held_next", follows)):
            assert r[held] == (len(mine & plain(other)) / len(mine) if mine else None)
        assert set(P.from_text(r["fingerprint"]).tolist()) == mine
    assert P.fingerprints(empty).count() == 0


def test_containment_of_small_texts_is_whole_or_unknown():
    rng = random.Random(3)
    w = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    big = P.sketch(" ".join(w).encode())
    for n in (6, 8, 10, 15, 20):
        held = [P.containment(P.sketch(" ".join(w[k : k + n]).encode()), big) for k in range(0, 2900, 7)]
        known = [x for x in held if x is not None]
        assert set(known) == {1.0} and abs(len(known) / len(held) - (1 - (1 - 1 / P.SHARE) ** (n - P.SHINGLE + 1))) < 0.08


def test_sketches_estimate_and_merge():
    rng = random.Random(7)
    w = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    big, small = " ".join(w).encode(), " ".join(w[1000:1400] + [f"x{k}" for k in range(400)]).encode()
    a, b = P.sketch(big), P.sketch(small)
    assert abs(P.containment(b, a) - 0.5) < 0.12 and abs(P.likeness(a, b) - 400 / 4400) < 0.03
    parts = [P.sketch(" ".join(w[k : k + 504]).encode()) for k in range(0, 4000, 500)]
    whole = parts[0]
    for p in parts[1:]:
        whole = P.merge(whole, p)
    assert np.array_equal(whole, a)
    assert P.likeness(P.sketch(b""), P.sketch(b" ")) == 1 and P.likeness(P.sketch(b""), a) == 0


def test_fingerprints_odd(odd, docs):
    rows = P.fingerprints(odd).collect()
    assert len(rows) == 7 and sum(r["doc_id"] is None for r in rows) == 3
    one = P.fingerprints(docs.where(F.length("text") > 1000).orderBy("doc_id").limit(1)).first()
    assert one["near_next"] == 1


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>é" + "x" * 1500
    rows = [(k, f"http://a/{k}", f"<html>{k}" + "y" * (k * 40)) for k in range(60)]
    rows += [(100, "http://b/\r\nX: y", big), (101, None, big), (7000, "http://c", big), (8000, "http://c", big), (200, "u", "small"), (201, "u", "small"), (300, None, None), (301, "u", ""), (None, "u", big), (400, "u", "x" * 1000), (401, "u", "x" * 1000), (402, "u", "x" * 999), (403, "u", "x" * 999)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string")


def want_of(pages):
    rows = [(r["page_id"], r["html"] or "") for r in pages.collect()]
    out = []
    for i, t in rows:
        data = t.encode()
        top = max((j for j, u in rows if u == t and j is not None), default=None) if len(data) >= 1000 else None
        refers = top if top is not None and top != i else None
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def test_warc_round_trip(pages, monkeypatch):
    monkeypatch.setattr(A, "FRAME_BYTES", 3000)
    monkeypatch.setattr(A, "BUNDLE_BYTES", 900)
    index = A.write_warc(pages.repartition(3))
    got = A.read_warc(index, with_payload=True)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == want_of(pages)
    html = {r["page_id"]: r["html"] or "" for r in pages.collect()}
    assert all(r["payload"] == html[r["page_id"]] for r in got.where("record_type = 'response'").collect())
    one = A.fetch(index, [f"{A.URN}7"])[f"{A.URN}7"]
    assert one.startswith(b"WARC/1.1\r\n") and html[7].encode() in one
    assert b"\r\nX: y" not in A.fetch(index, [f"{A.URN}100"])[f"{A.URN}100"]


def test_a_bundle_is_plain_zstandard(pages, tmp_path):
    """Any decoder reads the frames one after the other and skips the seek table."""
    import zstandard

    A.write_warc(pages.coalesce(1), path=f"file://{tmp_path}/w")
    (file,) = (tmp_path / "w").glob("*.warc.zst")
    plain = zstandard.ZstdDecompressor().stream_reader(file.read_bytes(), read_across_frames=True).read()
    assert len(list(A.records_in(plain))) == pages.count()


def test_warc_damage_is_seen(spark, tmp_path):
    bundle = A.Bundle(f"file://{tmp_path}/x.warc.zst")
    bundle.add(("r",), A.record(1, None, b"abc", "0" * 40, 3, None))
    bundle.close()
    index = spark.createDataFrame([(f"file://{tmp_path}/x.warc.zst",)], "bundle string")
    with pytest.raises(Exception, match="damaged"):
        A.read_warc(index).collect()


def test_warc_empty(pages):
    assert A.read_warc(A.write_warc(pages.limit(0))).count() == 0


def test_shared_folder(spark, monkeypatch):
    """Paths without a scheme are taken as Spark takes them; without a setting a local master gets one temporary folder, and a cluster an error."""
    from quirespark.llm import shared as S
    from quirespark.sources import scratch

    assert S.qualified(spark, "/tmp/x") == S.qualified(spark, "file:/tmp/x") == "file:///tmp/x"

    class Unset:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master, applicationId = "local[2]", "app-of-this-test"

    one, two = S.new_path(Unset, "a"), S.new_path(Unset, "b")
    assert one != two and one.rpartition("/")[0] == two.rpartition("/")[0] and one.startswith("file:///")
    assert scratch.scratch_path(Unset, "a").startswith("file:///")
    monkeypatch.setattr(Unset.sparkContext, "master", "spark://host:7077")
    for make in (S.new_path, scratch.scratch_path):
        with pytest.raises(ValueError, match="checkpoint"):
            make(Unset, "a")


def test_bundles_go_where_spark_takes_the_path(pages, tmp_path):
    index = A.write_warc(pages, path=f"{tmp_path}/plain")
    assert {r["bundle"][:8] for r in index.collect()} == {"file:///"} and A.read_warc(index).count() == pages.count()


def test_schemes_of_stores():
    from pyarrow import fs

    from quirespark.llm.warc import file_system

    assert file_system("file:///tmp/x/y") == (fs.LocalFileSystem(), "/tmp/x/y")
    assert file_system("dbfs:/tmp/x") == (fs.LocalFileSystem(), "/dbfs/tmp/x")
    store, path = file_system("s3a://bucket/a/b?region=us-east-1")
    assert store.type_name == "s3" and path == "bucket/a/b"


def test_small_pages_are_written_where_they_are_read(spark):
    """Pages without a key take no part in a shuffle: as many tasks write them as read them."""
    from pyspark.sql import functions as F

    from quirespark.llm.warc import write_warc

    pages = spark.range(0, 4000, 1, 8).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 4 == 0, F.repeat(F.col("id").cast("string"), 400)).otherwise("small").alias("html"))
    index = write_warc(pages)
    per_bundle = [r["count"] for r in index.groupBy("bundle").count().collect()]
    assert sum(per_bundle) == 4000 and max(per_bundle) < 1500
