"""The trie of conversations: every distinct beginning of a conversation is a node, with what hangs below it.

A conversation is one record: a key of fixed-width symbols, one a turn (a digest of role and text, and the text's
length), so that keys sort by their turns. Equal conversations are one record with a count. Records become sorted runs,
each entry with the number of turns that it shares with the one before (its LCP); runs are merged bucket by bucket with
a loser tree that compares only what lies beyond the LCPs. The merged stream of a bucket walks the trie: a stack holds
the open path, and a node is finished when a conversation leaves it.

Buckets end at splitters that are records themselves, so each task knows how much of its last path goes on in the next
bucket. What goes on is handed over as a part: counts, sums and minima of parts add up, and they are few (the paths at
the buckets' edges). A node shared by a third of all conversations is thus as many parts as its buckets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import numbered
from .shared import written

DIGEST = 32  # hex digits of a turn's digest
WIDTH = DIGEST + 8  # and of its text's bytes
BUCKET = 200_000  # turns
MOST_BUCKETS = 100_000
CHUNK = 4096  # ids
EMPTY = hashlib.sha256(b"").hexdigest()


def turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, symbols): the turns of each conversation in order, null turns first and equal ones by role and digest; null roles and texts are empty."""
    role, text = F.coalesce(F.col(f"`{role_col}`"), F.lit("")), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, DIGEST)
    symbol = F.concat(digest, F.lpad(F.lower(F.hex(F.octet_length(text))), 8, "0"))
    rows = df.where(F.col(f"`{conv_col}`").isNotNull()).select(F.col(f"`{conv_col}`").alias("c"), F.struct(F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), symbol.alias("symbol")).alias("t"))
    return rows.groupBy("c").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["symbol"]).alias("symbols"))


def branched(conversations: DataFrame, family: int = 5, longest: int = 9) -> DataFrame:
    """(c, key): each conversation begins with the first h turns of the first of its family (c - c % family) in place of its own, h being crc32 of its number % longest."""
    own = conversations.withColumn("h", F.crc32(F.col("c").cast("string").cast("binary")) % longest)
    first = conversations.where(F.col("c") % family == 0).select(F.col("c").alias("_first"), F.slice("symbols", 1, longest - 1).alias("_head"))
    joined = own.join(first, F.col("_first") == F.col("c") - F.col("c") % family, "left")
    h = F.col("h").cast("int")
    head = F.slice(F.coalesce("_head", F.array().cast("array<string>")), F.lit(1), h)
    tail = F.slice("symbols", h + 1, F.greatest(F.size("symbols") - h, F.lit(0)))
    return joined.select("c", F.array_join(F.concat(head, tail), "").alias("key"))


def _columns(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True) if rows else [[]] * len(fields), fields, strict=True)], [n for n, _ in fields])


def alike(keys: DataFrame) -> DataFrame:
    """(conv_id, n, ends): for each distinct key of (c, key) the smallest c, how many share it, and the SHA-256 of these c in order, joined by commas.

    A hash goes over its input from front to back, so the last step has a task for a group; it gets the group's numbers
    in strings of CHUNK, made by range before, and holds one of them at a time.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, ids = None, []
        for batch in batches:
            out = []
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (k != open_ or len(ids) == CHUNK):
                    out.append((open_, ids[0], len(ids), ",".join(map(str, ids))))
                    ids = []
                open_ = k
                ids.append(c)
            yield _columns(chunk, out)
        if ids:
            yield _columns(chunk, [(open_, ids[0], len(ids), ",".join(map(str, ids)))])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, first, n, sha = None, 0, 0, hashlib.sha256()
        for batch in batches:
            out = []
            for k, c, m, s in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if k != open_:
                    if n:
                        out.append((first, n, sha.hexdigest()))
                    open_, first, n, sha = k, c, 0, hashlib.sha256()
                sha.update((("," if n else "") + s).encode())
                n += m
            yield _columns(done, out)
        if n:
            yield _columns(done, [(first, n, sha.hexdigest())])

    chunk, done = "k string, c long, n long, ids string", "conv_id long, n long, ends string"
    rows = keys.select(F.sha2("key", 256).alias("k"), "c")
    pieces = rows.repartitionByRange("k", "c").sortWithinPartitions("k", "c").mapInArrow(chunks, chunk)
    return pieces.repartition("k").sortWithinPartitions("k", "c").mapInArrow(hashes, done)


def common(a: str, b: str, known: int = 0) -> int:
    """How many turns two keys share, given that they share `known`."""
    most, k = min(len(a), len(b)), known * WIDTH
    while k < most and a[k : k + WIDTH] == b[k : k + WIDTH]:
        k += WIDTH
    return k // WIDTH


RUNS = "run long, at long, lcp long, key string, conv_id long, n long, ends string"


def sorted_runs(records: DataFrame) -> DataFrame:
    """RUNS: the records (key, conv_id, n, ends) of each Arrow batch in the order of their keys, with the turns each shares with the one before. Written."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True))
            lcps = [0] + [common(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False)]
            yield _columns(RUNS, [(rows[0][1], k, lcp, *r) for k, (lcp, r) in enumerate(zip(lcps, rows, strict=True))] if rows else [])  # a run is known by its first conversation

    return written(records.select("key", "conv_id", "n", "ends").mapInArrow(sort, RUNS), "runs")


def merged(runs: list[list[tuple[int, str, int]]]) -> Iterator[tuple[int, str, int]]:
    """(lcp, key, payload) of sorted runs of distinct keys as one sorted stream; lcp is with the entry before.

    A loser tree: the losers of each match stay at its node, and only the path of the last winner is played again. Each
    head's lcp is with the last winner, so of two heads the one that shares more with it comes first, and only equal
    ones are compared, from there on.
    """
    size = 1 << max(0, len(runs) - 1).bit_length()
    places, last = [0] * size, (0, None, 0)

    def head(r: int) -> list | None:
        return list(runs[r][places[r]]) if r < len(runs) and places[r] < len(runs[r]) else None

    def play(a: tuple, b: tuple) -> tuple[tuple, tuple]:
        """(winner, loser) of two (run, head); the loser's lcp is then with the winner."""
        x, y = a[1], b[1]
        if x is None or y is None:
            return (a, b) if y is None else (b, a)
        if x[0] != y[0]:
            return (a, b) if x[0] > y[0] else (b, a)
        shared = common(x[1], y[1], x[0])
        win, lose = (a, b) if x[1][shared * WIDTH :] < y[1][shared * WIDTH :] else (b, a)
        lose[1][0] = shared
        return win, lose

    def build(node: int) -> tuple:
        if node >= size:
            r = node - size
            first = head(r)
            if first:
                first[0] = 0  # nothing came before
            return (r, first)
        win, losers[node] = play(build(2 * node), build(2 * node + 1))
        return win

    losers: list = [None] * size
    win = build(1)
    while win[1] is not None:
        last = win[1]
        yield tuple(last)
        r = win[0]
        places[r] += 1
        win, node = (r, head(r)), (r + size) // 2  # the run's next entry has its lcp with the winner already
        while node:
            win, losers[node] = play(win, losers[node])
            node //= 2


NODES = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, node string, parent string"


def walk(stream: Iterator[tuple[int, str, tuple[int, int, str]]], following: str | None) -> list[tuple]:
    """NODES of one bucket's merged stream. following: the key that begins the next bucket, null for the last one.

    Nodes that may have parts elsewhere (on the path of the first key, or shared with `following`) have `node`, a digest
    of their prefix; their columns are what this bucket adds. Others are whole; `parent` names a parent of that kind,
    and parent_conv_id is null then.
    """
    name = lambda key, d: hashlib.sha256(key[: d * WIDTH].encode()).hexdigest()[:DIGEST]
    out: list[list] = []
    # of an open node: [smallest member, members, children, leaves, saved bytes, ends, bytes of its text, may have parts, key, its finished children's places in out]
    stack: list[list] = []

    def close(goes_on: bool) -> None:
        least, n, children, leaves, saved, ends, size, parts, key, below = stack.pop()
        depth = len(stack)
        leaves += 0 if children or goes_on else 1
        saved += n * size - (0 if goes_on else size)
        parts = parts or goes_on
        up = stack[-1] if stack else None
        for k in below:
            if parts:
                out[k][9] = name(key, depth)
            else:
                out[k][2] = least
        out.append([least, depth, None, n, children, leaves, saved, ends, name(key, depth) if parts else None, name(key, depth - 1) if parts and depth else None])
        if up:
            up[0] = min(up[0], least)
            up[1] += n
            up[2] += not goes_on
            up[3] += leaves
            up[4] += saved
            if not parts:
                up[9].append(len(out) - 1)

    key, first = "", True
    for lcp, key, (conv, n, ends) in stream:
        while len(stack) > lcp + 1:
            close(False)
        for d in range(len(stack), len(key) // WIDTH + 1):
            stack.append([conv, 0, 0, 0, 0, None, int(key[d * WIDTH - 8 : d * WIDTH], 16) if d else 0, first, key, []])
        stack[-1][1] += n
        stack[-1][5] = ends
        stack[-1][0] = min(stack[-1][0], conv)
        first = False
    shared = common(key, following) if following is not None else -1
    while stack:
        close(len(stack) - 1 <= shared)
    return [tuple(x) for x in out]


def conversation_trie(keys: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the trie of (c, key).

    conv_id is the smallest conversation that begins with the node's turns; n_convs how many do; n_children its next
    turns; n_leaves the nodes without any below it, itself included; saved_tokens, summed over what hangs from it, itself
    included, the bytes of each last text times the conversations but one; ends_sha256 the hash of the conversations that
    end here. The root stands for no turn and is there if any conversation is.

    A bucket holds about `bucket` turns (more only beyond MOST_BUCKETS of them), and a record 40 bytes a turn of one
    conversation. Splitters come from a sample of some twenty a bucket, weighed by turns; one key for each bucket goes to
    the driver and back. An empty table has no nodes.
    """
    spark = keys.sparkSession
    keys = written(keys, "conversation-keys")
    records = alike(keys).join(keys.withColumnRenamed("c", "conv_id"), "conv_id")
    runs = sorted_runs(records)
    size = F.length("key") / WIDTH + 1
    total = int(runs.agg(F.sum(size)).first()[0] or 0)
    buckets = min(math.ceil(total / bucket), MOST_BUCKETS)
    splitters: list[str] = []
    if buckets > 1:
        drawn = runs.where(F.pmod(F.xxhash64("conv_id"), F.lit(total)) < (size * 20 * buckets).cast("long")).select("key")
        nth = numbered(drawn, ["key"], "sample")
        step = max(1, nth.count() // buckets)
        splitters = sorted(r["key"] for r in nth.where((F.col("pos") % step == 0) & (F.col("pos") > 0)).select("key").collect())
    bounds = spark.sparkContext.broadcast(splitters)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        for batch in batches:
            yield batch.append_column("bucket", pa.array([bisect_right(bounds.value, k) for k in batch.column(3).to_pylist()], pa.int64()))

    def bucket_nodes(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["bucket"].iloc[0])
        pdf = pdf.sort_values(["run", "at"])
        parts: dict[int, list] = {}
        for run, lcp, key, conv, n, ends in zip(*(pdf[c] for c in ("run", "lcp", "key", "conv_id", "n", "ends")), strict=True):
            parts.setdefault(run, []).append((lcp, key, (conv, n, ends)))
        rows = walk(merged(list(parts.values())), bounds.value[b] if b < len(bounds.value) else None)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")]).astype({"parent_conv_id": "Int64"})

    nodes = written(runs.mapInArrow(dealt, f"{RUNS}, bucket long").groupBy("bucket").applyInPandas(bucket_nodes, NODES), "nodes")
    add = [F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends_sha256").alias("ends_sha256")]
    shared = written(nodes.where("node IS NOT NULL").groupBy("node", "depth", "parent").agg(*add), "shared-nodes")
    above = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("_above"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = nodes.where("node IS NULL AND parent IS NULL")
    below = nodes.where("node IS NULL AND parent IS NOT NULL").drop("parent_conv_id").join(above, "parent").withColumn("parent_conv_id", F.col("_above"))
    edges = shared.join(above, "parent", "left").withColumn("parent_conv_id", F.col("_above"))
    out = whole.select(columns).unionByName(below.select(columns)).unionByName(edges.select(columns))
    return out.withColumn("depth", F.col("depth").cast("long")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
