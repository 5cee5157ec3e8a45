import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirespark.llm import top_k


def brute(rows, k):
    """Plain sorting of all inner products; rows are (place, id, whole vector)."""
    out = []
    for n, i, v in rows:
        if i is None or i % 20:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), j is None, j or 0, m) for m, j, w in rows if m != n]
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j, _) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def got(df, k=20):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k.exact_top_k(df, F.col("id") % 20 == 0, k).collect()), key=str)


SCHEMA = "vec_id long, embedding array<float>, row string, shard string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(3)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(top_k, "SHARD", 60)
    monkeypatch.setattr(top_k, "LEAF", 8)
    monkeypatch.setattr(top_k, "BLOCK", 7)


def test_brute_force_over_shards_and_blocks(spark, small):
    rng = random.Random(1)
    centre = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [round(c + rng.gauss(0, 0.2), 3) for c in rng.choice(centre)]) for i in range(400)]
    rows += [(400 + i, [0.5, -0.25, 1.0, 0.0, 0.125, -1.0]) for i in range(200)]  # a hot vector
    rng.shuffle(rows)
    want = brute([(n, i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for n, (i, v) in enumerate(rows)], 20)
    assert got(frame(spark, rows)) == want


def test_odd_rows(spark):
    """Null, empty and shorter vectors, null and non-finite components, null and repeated ids, repeated rows, negative ids."""
    fine = [(0, [1.0, -0.5]), (0, [1.0, -0.5]), (20, [0.25]), (-20, []), (None, [2.0, 2.0]), (None, [2.0, 2.0]), (7, [1.0, -0.5]), (8, [1.0, -0.5, 3.0])]
    bad = [(40, None), (60, [None, 1.0]), (1, [float("nan"), 0.0]), (2, [float("inf"), 0.0])]
    want = brute([(n, i, [int(np.floor(64 * x)) for x in v]) for n, (i, v) in enumerate(fine)], 3)
    assert got(frame(spark, fine + bad), 3) == want
    assert got(frame(spark, fine), 100) == brute([(n, i, [int(np.floor(64 * x)) for x in v]) for n, (i, v) in enumerate(fine)], 100)
    assert got(frame(spark, [])) == []


def test_large_components(spark):
    """Beyond what floats hold the products are whole numbers all the same; beyond 64 bits they are an error."""
    rows = [(0, [2.0**24, 1.0]), (1, [2.0**24, 3.0]), (2, [2.0**24, 2.0])]
    want = brute([(n, i, [int(64 * x) for x in v]) for n, (i, v) in enumerate(rows)], 20)
    assert got(frame(spark, rows)) == want
    with pytest.raises(Exception, match="beyond 64 bits"):
        got(frame(spark, [(0, [2.0**40]), (1, [2.0**40])]))


def test_boxes_bound_and_are_left_out():
    """No leaf is asked whose bound is below the floor, and every node's box holds its leaves."""
    rng = np.random.default_rng(3)
    v = rng.integers(-50, 50, (300, 4))
    low, high = v.reshape(4, 75, 4).min(1), v.reshape(4, 75, 4).max(1)
    for lo, hi in top_k._boxes(low, high):
        assert (lo.min(0) == low.min(0)).all() and (hi.max(0) == high.max(0)).all()
    parts = top_k._tree_order(v, 3)
    assert sorted(np.concatenate(parts)) == list(range(300)) and {len(p) for p in parts} <= {37, 38}
