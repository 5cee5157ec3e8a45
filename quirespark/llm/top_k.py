"""Exact top-k search by inner product: a KD-tree for each shard of the vectors, searched best box first.

An index is a table of leaves: (shard, leaf, n, boxes, vectors, ids). A shard holds some SHARD vectors: cells come from
median splits of a bounded sample, and a cell of more vectors (a hot vector, say) is dealt out by hash. Inside a shard
the tree halves its vectors at the median of the widest side of their box, down to LEAF vectors; leaves stand in the
order of the tree, so the box of an inner node is that of its two halves and need not be stored.

Queries meet shards in blocks. A box gives an upper bound of the inner product of all it holds: on each side the larger
of the products with its two ends. The bound of a node is never above that of its parent, so the best-first order of a
traversal is the order of the leaves' bounds; it ends where a bound falls below the k-th score so far. Each query first
searches the shard that it lies in, and takes the k-th score found there along to all other shards.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

SHARD = 16384
LEAF = 64
BLOCK = 8192
SAMPLE = 4096
CELLS = 64

INDEX = "shard int, leaf int, n int, dims int, kind string, low binary, high binary, vectors binary, ids binary, no_id binary, rows binary"
HITS = "query_row long, query_id long, vec_id long, score long, row long"
KINDS = ("<i2", "<i4", "<i8")


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(row, id, v): floor(scale * x) of every component, as a written table. Vectors that are null or hold a null or non-finite component are left out. `row` tells rows apart that share an id."""
    x = F.col(f"`{vector_col}`")
    fine = lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))  # noqa: E731  a NaN counts as larger than infinity
    rows = df.where(x.isNotNull() & F.forall(x, fine))
    return written(rows.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v")), "vectors")


def _stacked(vectors: pd.Series, dims: int = 0) -> np.ndarray:
    """One row a vector; shorter ones end in zeros."""
    most = max([dims, *(len(v) for v in vectors)])
    out = np.zeros((len(vectors), most), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def split_tree(sample: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """(side, threshold) of the inner nodes of a tree of median splits, the root first and the children of node k at 2k + 1 and 2k + 2."""
    parts, out = [sample], []
    for _ in range(depth):
        halves = []
        for p in parts:
            side = int(np.argmax(p.max(0) - p.min(0))) if p.size else 0
            at = int(np.median(p[:, side])) if p.size else 0
            out.append((side, at))
            high = p[:, side] > at if p.size else np.zeros(0, bool)
            halves += [p[~high], p[high]]
        parts = halves
    return out


def _cell(tree: list[tuple[int, int]], depth: int) -> Column:
    """The cell of a row's v: the tree is walked down, a level a step."""
    node = F.lit(0)
    if depth:
        sides, at = F.array(*(F.lit(s) for s, _ in tree)), F.array(*(F.lit(t).cast("long") for _, t in tree))
        for _ in range(depth):
            node = node * 2 + F.when(F.coalesce(F.get("v", F.get(sides, node)), F.lit(0)) > F.get(at, node), 2).otherwise(1)
    return (node - (2**depth - 1)).cast("int")


def sharded(vectors: DataFrame) -> DataFrame:
    """(row, id, v, shard): shards of about SHARD vectors at most, by cells of median splits (of SAMPLE vectors) and, where a cell has more, by hash. Written."""
    total = vectors.count()
    depth = min(int(math.log2(CELLS)), max(0, math.ceil(math.log2(max(total, 1) / SHARD))))
    sample = vectors.select("row", "v").orderBy(F.xxhash64("row")).limit(SAMPLE).toPandas()["v"] if depth else []
    celled = vectors.withColumn("_cell", _cell(split_tree(_stacked(sample), depth) if depth else [], depth))
    counts = {r["_cell"]: r["count"] for r in celled.groupBy("_cell").count().collect()}  # CELLS rows at most
    parts = [max(1, math.ceil(counts.get(c, 0) / SHARD)) for c in range(2**depth)]
    first = [sum(parts[:c]) for c in range(2**depth)]
    of = lambda numbers: F.get(F.array(*(F.lit(n) for n in numbers)), F.col("_cell"))
    return written(celled.withColumn("shard", (of(first) + F.pmod(F.xxhash64("row"), of(parts))).cast("int")).drop("_cell"), "shards")


def _tree_order(v: np.ndarray, depth: int) -> list[np.ndarray]:
    """The rows of each leaf: halves at the median of the widest side, `depth` times."""
    parts = [np.arange(len(v))]
    for _ in range(depth):
        halves = []
        for p in parts:
            x = v[p]
            side = int(np.argmax(x.max(0).astype(float) - x.min(0))) if len(p) and v.shape[1] else 0
            order = np.argpartition(x[:, side], len(p) // 2) if len(p) > 1 and v.shape[1] else np.arange(len(p))
            halves += [p[order[: len(p) // 2]], p[order[len(p) // 2 :]]]
        parts = halves
    return parts


def build_index(shards: DataFrame) -> DataFrame:
    """The leaves of each shard's tree (INDEX), from (row, id, v, shard). Written."""

    def leaves(pdf: pd.DataFrame) -> pd.DataFrame:
        v = _stacked(pdf["v"])
        top = int(np.abs(v).max(initial=0))
        kind = next((k for k in KINDS if top <= np.iinfo(k).max), KINDS[-1])
        ids, no_id = pdf["id"].to_numpy(np.int64), pdf["no_id"].to_numpy()
        rows, out = pdf["row"].to_numpy(np.int64), []
        for k, part in enumerate(_tree_order(v, max(0, math.ceil(math.log2(len(v) / LEAF))))):
            part = part[np.lexsort((rows[part], ids[part], no_id[part]))]
            x = v[part]
            out.append((int(pdf["shard"].iloc[0]), k, len(part), v.shape[1], kind, x.min(0).astype("<i8").tobytes(), x.max(0).astype("<i8").tobytes(), x.astype(kind).tobytes(), ids[part].astype("<i8").tobytes(), no_id[part].astype("u1").tobytes(), rows[part].astype("<i8").tobytes()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in INDEX.split(", ")])

    typed = shards.select("shard", "row", F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("no_id"), "v")  # pandas would make floats of ids beside a null
    return written(typed.groupBy("shard").applyInPandas(leaves, INDEX), "index")


def _boxes(low: np.ndarray, high: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The boxes of all levels, from the root's to the leaves'."""
    levels = [(low, high)]
    while len(low) > 1:
        low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
        levels.append((low, high))
    return levels[::-1]


NONE = np.iinfo(np.int64).min


def search_tree(leaves: pd.DataFrame, queries: np.ndarray, own: np.ndarray, floor: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> list[np.ndarray]:
    """(query, score, no_id, id, row) of the best k vectors of one tree for each query, without its own row.

    floor: of each query the k-th score so far (NONE where there are fewer), whether its vector has no id, and its id;
    what comes after that in order is of no use. A block of queries goes down the tree together: subtrees that no query
    needs are left out, and then each query takes its leaves in the order of their bounds, in rounds of twice as many.
    """
    leaves = leaves.sort_values("leaf")
    dims = max(queries.shape[1], int(leaves["dims"].max()))
    wide = lambda a: np.pad(a, ((0, 0), (0, dims - a.shape[1])))
    low, high = (wide(np.stack([np.frombuffer(b, "<i8") for b in leaves[c]])) for c in ("low", "high"))
    queries = wide(queries)
    largest = max(abs(int(f(x))) if x.size else 0 for x in (low, high) for f in (np.min, np.max))
    top = int(np.abs(queries).max(initial=0)) * largest * dims
    if top >= 2**63:
        raise ArithmeticError("scores beyond 64 bits")
    exact = np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64
    q = queries.astype(exact)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    kth, kth_none, kth_id = (x.copy() for x in floor)
    alive = np.zeros(1, np.int64)
    for lo, hi in _boxes(low, high):
        bounds = (up @ hi[alive].T.astype(exact) + down @ lo[alive].T.astype(exact)).astype(np.int64)
        needed = (bounds >= kth[:, None]).any(0)
        alive, bounds = alive[needed], bounds[:, needed]
        if len(lo) < len(low):
            alive = np.stack([2 * alive, 2 * alive + 1], 1).ravel()
    best = [np.zeros(0, t) for t in (np.int64, np.int64, np.uint8, np.int64, np.int64)]
    if not len(alive):
        return best
    part = leaves.iloc[alive]
    vectors = [wide(np.frombuffer(b, kind).reshape(n, d)).astype(exact) for b, kind, n, d in zip(part["vectors"], part["kind"], part["n"], part["dims"], strict=True)]
    none, ids, rows = ([np.frombuffer(b, t) for b in part[c]] for c, t in (("no_id", "u1"), ("ids", "<i8"), ("rows", "<i8")))
    first_none, first_id = np.array([x[0] for x in none]), np.array([x[0] for x in ids])  # a leaf's vectors stand by id
    order = np.argsort(-bounds, axis=1, kind="stable")
    at, width, live = 0, 1, np.flatnonzero((bounds >= kth[:, None]).any(1))
    while len(live) and at < len(alive):
        chosen = order[live, at : at + width]
        who, leaf = np.repeat(live, chosen.shape[1]), chosen.ravel()
        bound = bounds[who, leaf]
        tie = (first_none[leaf] < kth_none[who]) | ((first_none[leaf] == kth_none[who]) & (first_id[leaf] <= kth_id[who]))
        use = (bound > kth[who]) | ((bound == kth[who]) & tie)
        who, leaf = who[use], leaf[use]
        by = np.argsort(leaf, kind="stable")
        who, leaf = who[by], leaf[by]
        edges = np.flatnonzero(np.diff(leaf, prepend=-1, append=-1)) if len(leaf) else []
        found: list[list[np.ndarray]] = [[x] for x in best]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            x, group = int(leaf[s]), who[s:e]
            scores = q[group] @ vectors[x].T
            i, j = np.nonzero((scores >= kth[group][:, None]) & (rows[x][None, :] != own[group][:, None]))
            for o, values in zip(found, (group[i], scores[i, j].astype(np.int64), none[x][j], ids[x][j], rows[x][j]), strict=True):
                o.append(values)
        new = [np.concatenate(parts) for parts in found]
        by = np.lexsort((new[4], new[3], new[2], -new[1], new[0]))
        new = [x[by] for x in new]
        rank = np.arange(len(by)) - np.searchsorted(new[0], np.arange(len(q)))[new[0]]
        best = [x[rank < k] for x in new]
        full = np.flatnonzero(np.bincount(best[0], minlength=len(q)) == k)
        last = np.searchsorted(best[0], full, side="right") - 1
        score, n, i = best[1][last], best[2][last], best[3][last]
        better = (score > kth[full]) | ((score == kth[full]) & ((n < kth_none[full]) | ((n == kth_none[full]) & (i < kth_id[full]))))
        kth[full[better]], kth_none[full[better]], kth_id[full[better]] = score[better], n[better], i[better]
        at, width = at + width, width * 2
        if at < len(alive):
            live = live[bounds[live, order[live, at]] >= kth[live]]
    return best


def _searched(pairs: DataFrame, index: DataFrame, key: list[str], k: int) -> DataFrame:
    """HITS of queries(key, row, id, v, kth, kth_none, kth_id) in the leaves of the same key."""

    def search(queries: pd.DataFrame, leaves: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(leaves):
            return pd.DataFrame({c.split()[0]: pd.Series([], dtype="int64") for c in HITS.split(", ")})
        own, ids = queries["row"].to_numpy(np.int64), queries["id"].to_numpy(np.int64)
        floor = tuple(queries[c].to_numpy(t) for c, t in (("kth", np.int64), ("kth_none", np.uint8), ("kth_id", np.int64)))
        who, score, none, vec, row = search_tree(leaves, _stacked(queries["v"]), own, floor, k)
        return pd.DataFrame({"query_row": own[who], "query_id": ids[who], "vec_id": pd.Series(vec).astype("Int64").mask(none > 0), "score": score, "row": row})

    return pairs.groupBy(*key).cogroup(index.groupBy(*key)).applyInPandas(search, HITS)


def exact_top_k(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which `queries` holds (a condition on `id`, the row's id) the k rows of the largest inner products of floor(scale * x), its own left out, from rank 1 down.

    Ties go to the smaller id, null last, and rows that repeat an id have places of their own. With fewer rows than k
    all are given. Vectors that are null or hold null or non-finite components take no part, neither as queries nor as
    candidates. Of vectors of different lengths the shorter one ends in zeros. Rows without an id are never queries.
    Scores that could leave 64 bits are an error. An empty table gives none. Other columns are not read.

    Exact: a box that is left out holds nothing that could come before the k-th. A shard is one group with a block of
    BLOCK queries at most; the result is k rows a query, and queries meet all shards once, in blocks.
    """
    shards = sharded(whole_vectors(df, id_col, vector_col, scale))
    index = build_index(shards)
    asked = shards.where(F.col("id").isNotNull()).where(queries)
    start = asked.withColumns({"kth": F.lit(NONE), "kth_none": F.lit(1), "kth_id": F.lit(np.iinfo(np.int64).max)})
    home = written(_searched(start, index, ["shard"], k), "home-hits")
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"]
    nth = F.row_number().over(Window.partitionBy("query_row").orderBy(*order))
    last = home.withColumn("_n", nth).where(F.col("_n") == k).select(F.col("query_row").alias("row"), F.col("score").alias("_kth"), F.col("vec_id").isNull().cast("int").alias("_none"), F.coalesce("vec_id", F.lit(0)).alias("_id"))
    known = asked.join(last, "row", "left").select("row", "id", "v", "shard", F.coalesce("_kth", F.lit(NONE)).alias("kth"), F.coalesce("_none", F.lit(1)).alias("kth_none"), F.coalesce("_id", F.lit(np.iinfo(np.int64).max)).alias("kth_id"))
    n_shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    others = known.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).where(F.col("_to") != F.col("shard"))
    others = others.select(F.col("_to").alias("shard"), F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), "row", "id", "v", "kth", "kth_none", "kth_id")
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    away = _searched(others, copies, ["shard", "block"], k) if n_shards > 1 else home.limit(0)
    ranked = home.unionByName(away).withColumn("rank", nth).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
