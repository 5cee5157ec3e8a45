import re

import numpy as np
import pytest

from quirespark.llm import mixing as M


def heap_free_sainte_lague(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats):
        k = max(range(len(votes)), key=lambda k: (votes[k] / (2 * got[k] + 1), -k))
        got[k] += 1
    return got


def test_apportionment_is_by_highest_quotients():
    rng = np.random.default_rng(1)
    for _ in range(200):
        votes = rng.integers(0, 1000, rng.integers(1, 9)).astype(float) * rng.choice([1, 1, 0.01], 1)
        if votes.sum():
            seats = int(rng.integers(0, 60))
            assert M.apportion(votes, seats).tolist() == heap_free_sainte_lague(votes, seats)


def test_fill_stops_at_the_cap():
    sizes, weights = np.array([100, 1000, 10, 0]), np.array([3.0, 1, 2, 3])
    out = M.fill(sizes, weights, 1.5 * sizes.sum(), 2.0)
    assert out.tolist() == [200, 1445, 20, 0]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def mixed(docs):
    return M.mix(docs, block=1).toPandas().set_index("doc_id")


def test_mix(docs, mixed):
    rows = {r["doc_id"]: (len(words(r["text"])), r["source"]) for r in docs.select("doc_id", "text", "source").collect()}
    names = sorted({s for _, s in rows.values() if s is not None}) + [None]
    sizes = np.array([sum(n for n, s in rows.values() if s == x) for x in names])
    targets = M.fill(sizes, np.resize(np.array(M.WEIGHTS, float), len(names)), 1.5 * sizes.sum(), 2.0)
    assert len(mixed) == len(rows)
    for i, r in mixed.iterrows():
        n, s = rows[i]
        k = names.index(s)
        assert (r["size"], r["source_size"]) == (n, sizes[k]) and abs(r["target"] - targets[k]) < 1e-6 and 0 <= r["taken"] <= 2 * n
    for k, x in enumerate(names):
        assert abs(sum(mixed["taken"][i] for i, (_, s) in rows.items() if s == x) - targets[k]) <= 1


def test_mix_reruns_agree_and_shards_are_exact(docs, mixed, monkeypatch):
    assert mixed.equals(M.mix(docs.repartition(7), block=1).toPandas().set_index("doc_id").loc[mixed.index])
    monkeypatch.setattr(M, "SHARD_WORDS", 500)
    again = M.mix(docs, block=4).toPandas()
    sources = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    by = again.groupby(again["doc_id"].map(sources).fillna("~"))
    assert ((by["taken"].sum() - by["target"].first()).abs() <= 4).all() and (again["taken"] <= 2 * again["size"]).all()


def test_documents_of_the_mix(docs):
    plan = M.mix(docs).toPandas().set_index("doc_id")
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns
    got: dict = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(words(r["text"]))
    assert got == {i: n for i, n in plan["taken"].items() if n}
    whole = {r["doc_id"]: words(r["text"]) for r in docs.select("doc_id", "text").collect()}
    for r in out.collect():
        w = words(r["text"])
        assert any(whole[r["doc_id"]][k : k + len(w)] == w for k in range(len(whole[r["doc_id"]]) - len(w) + 1))


def test_shards_in_two_levels(docs, monkeypatch):
    monkeypatch.setattr(M, "SHARD_WORDS", 50)
    monkeypatch.setattr(M, "FAN", 3)
    got = M.mix(docs, block=1).toPandas()
    sources = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    by = got.groupby(got["doc_id"].map(sources).fillna("~"))
    assert ((by["taken"].sum() - by["target"].first()).abs() <= 1).all() and (got["taken"] <= 2 * got["size"]).all()


def test_rows_that_share_an_id_have_places_of_their_own(spark):
    rows = [(1, " ".join(f"a{k}" for k in range(900)), "s", "x"), (1, " ".join(f"b{k}" for k in range(700)), "s", "x"), (1, " ".join(f"b{k}" for k in range(700)), "s", "y"), (None, "c d e", None, "z"), (2, "f g", "s", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix string")
    plan, out = M.mix(df, block=1).collect(), M.mixed_documents(df, block=1)
    assert out.columns == df.columns
    got = [words(r["text"]) for r in out.collect()]
    assert sum(map(len, got)) == sum(r["taken"] for r in plan) and all(len({w[0] for w in g}) == 1 for g in got if g[0][0] in "ab")
    for letter, size in (("a", 900), ("b", 700)):
        want = sum(r["taken"] for r in plan if r["size"] == size)
        assert sum(len(g) for g in got if g[0][0] == letter) == want


def test_mix_odd(odd, empty):
    assert M.mix(odd).count() == 7 and M.mix(empty).count() == 0 and M.mixed_documents(empty).count() == 0
