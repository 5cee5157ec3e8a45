import hashlib
import random
import re

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from quirespark.llm import exact_dedup as E
from quirespark.llm import near_dedup as N
from quirespark.llm import suffix_dedup as S
from quirespark.llm.components import components


def texts_of(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t)


def test_fingerprints_combine():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(3 * E.CHUNK + 17))
    for k in (0, 1, 5000, E.CHUNK, len(data)):
        assert E.combine(E.fingerprint(data[:k]), E.fingerprint(data[k:])) == E.fingerprint(data)
    p, b = E.PRIMES[0], E.BASES[0]
    assert E.fingerprint(b"ab")[1] == (98 * b + 99) % p


def test_exact(docs, empty):
    want, groups = texts_of(docs), {}
    for i, t in want.items():
        groups.setdefault(norm(t), []).append(i)
    rows = E.exact_dedup(docs).collect()
    assert len(rows) == len(want)
    for r in rows:
        g = groups[norm(want[r["doc_id"]])]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (min(g), len(g), r["doc_id"] == min(g), hashlib.sha256(norm(want[r["doc_id"]]).encode()).hexdigest())
    assert E.exact_dedup(empty).count() == 0
    left = E.without_copies(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {min(g) for g in groups.values()}


def test_exact_odd(odd):
    rows = E.exact_dedup(odd).collect()
    same = [r for r in rows if r["group_size"] == 4]
    assert len(rows) == 7 and len(same) == 4 and sum(r["kept"] for r in same) == 1 and {r["keep_id"] for r in same} == {3}
    assert E.without_copies(odd).count() == 3


def test_one_row_of_each_group_stays_where_ids_repeat(spark):
    a, b = " ".join(f"a{k}" for k in range(90)), " ".join(f"b{k}" for k in range(90))
    near = a.replace("a50 ", "z ")
    rows = [(1, a, "q"), (1, a, "p"), (1, b, "q"), (2, a + " ", "q"), (3, near, "q"), (None, b, "q"), (1, near.replace(" ", "  "), "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _times string")
    exact = sorted((r["doc_id"], norm(r["text"]).strip(), r["_times"]) for r in E.without_copies(df).collect())
    assert exact == sorted([(1, a, "p"), (1, b, "q"), (2, a, "q"), (1, near, "q")])
    got = [(r["doc_id"], r["text"][0]) for r in N.without_near_copies(df).collect()]
    assert sorted(got) == [(1, "a"), (1, "b")]
    assert E.without_copies(df.repartition(5)).exceptAll(E.without_copies(df)).count() == 0


def test_one_fingerprint_for_different_texts(docs, monkeypatch):
    """A hash that always collides must change nothing."""
    want = {tuple(r) for r in E.exact_dedup(docs).collect()}
    monkeypatch.setattr(E, "MEMBERS_A_SALT", 7)
    real = E.fingerprints
    monkeypatch.setattr(E, "fingerprints", lambda *a, **k: real(*a, **k).withColumns({"_n": F.lit(1).cast("long"), "_h1": F.lit(1).cast("long"), "_h2": F.lit(1).cast("long")}))
    assert {tuple(r) for r in E.exact_dedup(docs).collect()} == want


def shingles(t, size):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).encode().split()
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def near_brute(want, size):
    sets = {i: shingles(t, size) for i, t in want.items()}
    parent = {i: i for i in want}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(want)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near(docs, empty):
    want = texts_of(docs)
    for size in (4, 5):
        rows = N.near_dedup(docs, size=size).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == near_brute(want, size)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    assert N.near_dedup(empty).count() == 0
    kept = N.without_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({c for _, c in near_brute(want, 5).values()})


def test_near_links_past_the_bucket_leader(spark):
    """A chain of texts, each near only to its neighbours, and a hub whose variants are not near each other."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(words[6 * k : 6 * k + 100])) for k in range(15)]
    hub = [f"h{k}" for k in range(150)]
    rows.append((500, " ".join(hub)))
    for k in range(60):
        w = hub.copy()
        at = rng.randrange(0, 135)
        w[at : at + 12] = [f"v{k}x{j}" for j in range(12)]
        rows.append((100 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_dedup(df, size=4).collect()}
    assert got == near_brute(dict(rows), 4)


def test_near_repeated_rows_lose_no_link(spark, monkeypatch):
    """A chain of texts, each near only to its neighbours, that only the last exact step brings together; most rows stand twice or three times."""
    one = Window.partitionBy(F.lit(1))
    monkeypatch.setattr(N, "buckets", lambda nodes: nodes.select(F.lit(1).cast("long").alias("key"), "node", F.min("node").over(one).alias("leader")))
    rng = random.Random(8)
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(words[6 * k : 6 * k + 100])) for k in range(15)]
    rng.shuffle(rows)
    repeated = [row for row in rows for _ in range(1 + row[0] % 3)]
    df = spark.createDataFrame(repeated, "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in N.near_dedup(df, size=4).collect()}
    assert got == {(k, *x) for k, x in near_brute(dict(rows), 4).items()}


def test_near_blocks(docs, monkeypatch):
    want = near_brute(texts_of(docs), 4)
    monkeypatch.setattr(N, "BLOCK_ROWS", 2)
    monkeypatch.setattr(N, "SHARE_ROWS", 2)
    monkeypatch.setattr(N, "PAIRS", 7)
    monkeypatch.setattr(N, "RANKS", (0, 1, 2, None))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_dedup(docs, size=4).collect()} == want


def test_near_pairs_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    """400 edited copies of one text, most of them near to most others: a few pairs a document are held against each other, and none that counts is left out."""
    rng = random.Random(4)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(400):
        w = base.copy()
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    pairs, verified = [], N.verified
    monkeypatch.setattr(N, "verified", lambda p, *more: pairs.append(p.count()) or verified(p, *more))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()}
    assert got == near_brute(dict(rows), 4) and sum(pairs) < 8 * len(rows)


def test_near_odd(odd):
    rows = N.near_dedup(odd, size=4).collect()
    same = [r for r in rows if r["n_shingles"] == 4]
    assert len(rows) == 7 and len(same) == 4 and {r["component_id"] for r in same} == {3} and sum(r["kept"] for r in same) == 1


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if x not in alone}


def suffix_brute(want):
    seen, out = set(), {}
    for i in sorted(want):
        b = want[i].encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - S.WIDTH + 1):
            if (w := b[s : s + S.WIDTH]) in seen:
                gone[s : s + S.WIDTH] = True
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def check_suffix(df):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.suffix_dedup(df).collect()}
    assert got == suffix_brute(texts_of(df))


def test_suffix(docs, empty):
    check_suffix(docs)
    assert S.suffix_dedup(empty).count() == 0


def test_suffix_long_texts_in_pieces(docs, monkeypatch):
    monkeypatch.setattr(S, "BUFFER", 700)
    check_suffix(docs)


def test_suffix_batches_cut_buckets(spark, docs):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        check_suffix(docs)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_suffix_periods_and_edges(spark):
    rng = random.Random(6)
    line = "".join(rng.choice("abcdef ") for _ in range(180))
    rows = [(1, line), (2, "x" + line[:99]), (3, "y" + line[:100]), (4, line[40:160] + "!" + line[:120]), (5, "ha " * 300), (6, "ha " * 200 + "ho"), (7, "\x00" * 250), (8, "\x00" * 130), (9, line[:150] + line[30:180])]
    check_suffix(spark.createDataFrame(rows, "doc_id long, text string"))


def test_suffix_passage_with_different_neighbours(spark, monkeypatch):
    """A passage in many documents: no bucket that one task sorts may grow with their number."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, largest = text(300), []
    rows = [(k, text(150) + passage + text(150)) for k in range(60)] + [(60 + k, rng.choice("xy") + passage + rng.choice("xy")) for k in range(20)] + [(90 + k, text(300)) for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    real = S.spans_of

    def watched(found):
        largest.append(found.groupBy("key").count().agg(F.max("count")).first()[0] or 0)
        return real(found)

    monkeypatch.setattr(S, "spans_of", watched)
    monkeypatch.setattr(S, "MOST", 8, raising=False)
    check_suffix(df)
    assert max(largest) <= 9


def test_suffix_all_buckets_hot(docs, monkeypatch):
    monkeypatch.setattr(S, "MOST", 0)
    check_suffix(docs)


def test_suffix_odd(odd):
    rows = S.suffix_dedup(odd, with_text=True).collect()
    assert len(rows) == 7 and all(r["n_removed"] == 0 for r in rows) and sum(r["doc_id"] is None for r in rows) == 3


def test_suffix_tells_null_from_the_largest_id(spark):
    rng = random.Random(2)
    text, top = "".join(rng.choice("abcdefgh ") for _ in range(300)), (1 << 63) - 1
    df = spark.createDataFrame([(top, text), (None, text), (5, text[:120]), (None, "x")], "doc_id long, text string")
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in S.suffix_dedup(df).collect()}
    assert got == {(5, 120): 0, (top, 300): 120, (None, 300): 300, (None, 1): 0}


def test_parities_never_rule_out_a_link():
    import numpy as np

    from quirespark.llm.near_dedup import parities

    rng = np.random.default_rng(5)
    for n in (1, 40, 3000):
        for share in (0.0, 0.5, 0.9, 1.0):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.union1d(a[: int(share * n)], rng.integers(0, 1 << 63, n // 5, dtype=np.uint64))
            differ = len(np.setxor1d(a, b))
            x, y = (np.unpackbits(np.frombuffer(parities(s), np.uint8)) for s in (a, b))
            assert (x != y).sum() <= differ
            assert differ or (x == y).all()


def test_many_rows_of_one_id_are_dealt_once(spark):
    """5,000 rows with a null id and one text: each is dealt to one share, but for a first row a task and share."""
    from quirespark.llm import exact_dedup as E

    rows = spark.createDataFrame([(None, "one text", None)] * 5000 + [(1, "other", None), (2, "other", None)], "doc_id long, text string, lang string").repartition(4)
    texts = E.fingerprints(rows, "doc_id", "text", with_text=True).selectExpr("_id", *E.KEY, "_id IS NULL OR _id = 1 AS _lead", "_text", "if(_id IS NULL, 5, 1) AS _salts")
    dealt = E.dealt_shares(texts, "bigint").groupBy("_n", "_salt").agg({"_lead": "count", "*": "count"}).collect()
    assert sum(r["count(1)"] for r in dealt) <= 5002 + 4 * 5 and len(dealt) == 6
    assert max(r["count(1)"] for r in dealt) < 1200
    got = E.exact_dedup(rows).where("kept").collect()
    assert sorted((r["doc_id"], r["group_size"]) for r in got if r["doc_id"]) == [(1, 2)] and [r["group_size"] for r in got if r["doc_id"] is None] == [5000]
    assert E.without_copies(rows).count() == 2
