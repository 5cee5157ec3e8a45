"""MinHash near-dedup with tensored banding.

SIDE left and SIDE right halves of ROWS minhashes each make SIDE * SIDE table keys of 2 * ROWS minhashes, so that as
many tables need only 2 * SIDE * ROWS minhashes. A pair of likeness J shares a key unless all left or all right
halves differ; the chance of that is at most 2 (1 - J ** ROWS) ** SIDE: 1e-5 at J = 0.8 with the sizes here.

Candidates are verified on full sets. First every node is held against one node that leads most of its buckets; what
that links is joined into components. Then, in buckets that hold several components, members of different components
are held against each other where their rarest shingles allow a link: the likeliest partner of each first, and the
others only where that has not joined their components, so that groups whose members are mostly linked come together
without a comparison of all pairs. Links inside a component would change nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import id_and_text, mix64, rows_kept, written
from .shingles import shingle_hashes, words_of

ROWS, SIDE = 2, 12
HASHES = 2 * SIDE * ROWS
SHINGLE = 5
PERCENT = 80
SHARE_ROWS = 1000
BLOCK_ROWS = 1000
PAIRS = 500_000  # compared at once in a task
RANKS = (0, 1, 16, None)
CHUNK = 8192
PARITY_BITS = 512
_SEEDS = mix64(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
MULTIPLIERS, SHIFTS = (_SEEDS[:HASHES] | np.uint64(1))[:, None], _SEEDS[HASHES:, None]


def shingle_set(data: bytes, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(words_of(data), size))


def minhashes(hashes: np.ndarray) -> np.ndarray:
    """HASHES minima of the set's hashes under as many multiply-add permutations, chunk by chunk."""
    out = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for k in range(0, len(hashes), CHUNK):
            out = np.minimum(out, (hashes[None, k : k + CHUNK] * MULTIPLIERS + SHIFTS).min(axis=1))
    return out


def table_keys(signatures: np.ndarray) -> np.ndarray:
    """rows x HASHES -> rows x SIDE * SIDE keys: each left half paired with each right half."""
    halves = signatures.reshape(len(signatures), 2 * SIDE, ROWS)
    with np.errstate(over="ignore"):
        h = np.full(halves.shape[:2], np.uint64(ROWS))
        for k in range(ROWS):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + halves[:, :, k] + np.arange(2 * SIDE, dtype=np.uint64)[None, :])
        left, right = h[:, :SIDE, None], h[:, None, SIDE:]
        return mix64(left * np.uint64(0xD6E8FEB86659FD93) + right).reshape(len(signatures), SIDE * SIDE)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b|, for ascending arrays of distinct hashes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def parities(hashes: np.ndarray) -> bytes:
    """For each of PARITY_BITS bins, whether it holds an odd number of the set's hashes. Two sets differ in at least as many hashes as their parities in bits."""
    return np.packbits(np.bincount((hashes % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1).tobytes()


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """_id, _hash (of the text), n (set size), _digest (of the set), _minhashes (null for an empty set)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, minima = [], [], []
            for data in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingle_set(data, size)
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                minima.append(minhashes(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(minima, pa.binary())], ["_id", "_hash", "n", "_digest", "_minhashes"])

    rows = id_and_text(docs, id_col, text_col).withColumn("_hash", F.xxhash64("_text"))
    return rows.mapInArrow(sign, f"_id {kind}, _hash long, n long, _digest binary, _minhashes binary")


def buckets(nodes: DataFrame) -> DataFrame:
    """(key, node, leader) for every bucket of two and more nodes; leader is the bucket's least node."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 2000) for k in range(0, batch.num_rows, 2000)):
                m = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint64).reshape(-1, HASHES)
                yield pa.RecordBatch.from_arrays([pa.array(table_keys(m).reshape(-1).view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), SIDE * SIDE))], ["key", "node"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows stand by key and node. The last row is held back until the next one shows whether its bucket goes on."""
        held, held_lead, goes_on = np.zeros((0, 2), np.int64), np.zeros(0, np.int64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([held, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)])
            key, node = rows[:, 0], rows[:, 1]
            begins = np.concatenate([[True], key[1:] != key[:-1]])
            lead = node[np.flatnonzero(begins)][np.cumsum(begins) - 1]
            if len(held):
                lead[key == held[0, 0]] = held_lead[0]
            as_before = ~begins
            as_before[0] = goes_on
            keep = (as_before | np.concatenate([~begins[1:], [False]]))[:-1]
            held, held_lead, goes_on = rows[-1:], lead[-1:], bool(as_before[-1])
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep]) for x in (key, node, lead)], ["key", "node", "leader"])
        if goes_on:
            yield pa.RecordBatch.from_arrays([pa.array(held[:, 0]), pa.array(held[:, 1]), pa.array(held_lead)], ["key", "node", "leader"])

    dealt = nodes.select("node", "_minhashes").mapInArrow(keys, "key long, node long").repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(several, "key long, node long, leader long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sets (node, set) are linked. A node a of many pairs is compared in shares, each with its own copy of a's set."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE_ROWS).cast("int").alias("_shares"))
    first = sets.join(counts, F.col("node") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_share"), F.lit(None).cast("long").alias("b"), "set")
    rest = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "_shares").cast("int").alias("_share")).join(sets, F.col("b") == F.col("node")).select("a", "_share", "b", "set")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, own = None, None
        for batch in batches:
            out_a, out_b = [], []
            a, s, b, data = (batch.column(k) for k in range(4))
            for k, at in enumerate(zip(a.to_pylist(), s.to_pylist(), strict=True)):
                other = np.frombuffer(data[k].as_buffer(), np.uint64)
                if b[k].as_py() is None:
                    share, own = at, other
                elif at == share and linked(own, other, percent):
                    out_a.append(at[0])
                    out_b.append(b[k].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    dealt = first.unionByName(rest).repartition("a", "_share").sortWithinPartitions("a", "_share", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(compare, "a long, b long")


def sized(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose set sizes allow a link."""
    for end in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias("_node"), F.col("n").alias(f"n_{end}")), F.col(end) == F.col("_node")).drop("_node")
    return pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b")


def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with the label of their component so far; a node without links is its own."""
    return members.join(labels.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("key", "node", F.coalesce("label", "node").alias("label"))


def leader_pairs(members: DataFrame) -> DataFrame:
    """(a, b): each node b with one leader a, that of most of its buckets, which is likely the most alike. So there are no more pairs than nodes."""
    return members.where("leader <> node").groupBy(F.col("node").alias("b")).agg(F.mode("leader", True).alias("a")).select("a", "b")


def candidates(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """What may link different components, among the nodes of buckets that hold several: rows (g, _x, _y, _block, node, i, n, bits), written.

    Exact filters leave few: let a set's shingles stand from the rarest to the most frequent among these nodes. Two linked
    sets share at least o = percent / (100 + percent) * (n_a + n_b) shingles, so the first they share stands at place
    n_a - o at most in one and n_b - o in the other. Only such early shingles g are compared, each with its place i.
    Nodes with one early shingle are dealt out as pairs (_x, _y) of blocks of about BLOCK_ROWS.
    """
    named = labelled(members, labels)
    mixed = named.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low <> _high").select("key")
    open_ = named.join(mixed, "key").select(F.col("node").alias("_node"), "label").distinct()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                data = part.column(2).to_pylist()
                sizes = np.array([len(x) // 8 for x in data])
                yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(part.column(k).to_numpy(), sizes)) for k in range(2)), pa.array(np.frombuffer(b"".join(data), np.int64)), pa.array(np.repeat(sizes, sizes))], ["node", "label", "g", "n"])

    rows = sets.join(open_, F.col("node") == F.col("_node")).select("node", "label", "set").mapInArrow(spread, "node long, label long, g long, n long")
    often = rows.groupBy("g").agg(F.count("*").alias("f")).where("f > 1").withColumnRenamed("g", "_g")
    rows = rows.join(often, F.col("g") == F.col("_g"))
    # shingles that only one node has come first and need no rows: the place of the others counts from the set's end
    own = Window.partitionBy("node")
    rows = rows.withColumn("i", F.row_number().over(own.orderBy("f", "g")) - 1 + F.col("n") - F.count("*").over(own))
    early = written(rows.where((100 * F.col("i") <= (100 - percent) * F.col("n"))).select("g", "node", "label", F.col("i").cast("long").alias("i"), "n"), "near-early")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parities(np.frombuffer(x.as_buffer(), np.uint64)) for x in batch.column(1)], pa.binary())], ["_of", "bits"])

    bits = sets.mapInArrow(sketch, "_of long, bits binary")
    blocks = early.groupBy("g").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_blocks")).where("_low <> _high").select(F.col("g").alias("_g"), "_blocks")
    dealt = early.join(blocks, F.col("g") == F.col("_g")).join(bits, F.col("node") == F.col("_of")).withColumn("_block", F.pmod(F.xxhash64("node"), "_blocks").cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    return written(dealt.select("g", F.least("_block", "_other").alias("_x"), F.greatest("_block", "_other").alias("_y"), "_block", "node", "i", "n", "bits"), "near-candidates")


def across(dealt: DataFrame, labels: DataFrame, percent: int, low: int, high: int | None) -> DataFrame:
    """Pairs (a, b) of different components that may be linked, from `candidates`: of each node's partners in a pair of blocks, those that stand at the ranks from `low` to `high` and aren't of the node's component.

    Partners stand by the parity bits that differ. Pairs that differ in more bits than two linked sets of their sizes may
    are none. Ranks do not depend on components, so calls whose ranges cover all ranks, with labels that only merge,
    leave out no pair that could join two components.
    """
    named = dealt.join(labels.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    named = named.select("g", "_x", "_y", "_block", "node", "i", "n", F.coalesce("label", "node").alias("label"), "bits")

    def emit(left: np.ndarray, begin: np.ndarray, count: np.ndarray, x: dict[str, np.ndarray]) -> pa.RecordBatch:
        """Rows `left`, each with `count` rows from `begin` on."""
        at = np.repeat(np.arange(len(left)), count)
        l, r = left[at], np.arange(count.sum()) + np.repeat(begin - np.cumsum(count) + count, count)
        i, n, label = x["i"], x["n"], x["label"]
        need = -(-percent * (n[l] + n[r]) // (100 + percent))
        may = (l != r) & (i[r] <= n[r] - need) & (i[l] <= n[l] - need) & (100 * np.minimum(n[l], n[r]) >= percent * np.maximum(n[l], n[r]))
        apart = label[l] != label[r]
        may &= (np.bincount(at[may & apart], minlength=len(left)) > 0)[at]
        l, r, apart, most = l[may], r[may], apart[may], (n[l] + n[r] - 2 * need)[may]
        differ = np.bitwise_count(x["bits"][l] ^ x["bits"][r]).sum(axis=1, dtype=np.int64)
        near = differ <= most
        l, r, apart, differ = l[near], r[near], apart[near], differ[near]
        order = np.lexsort((x["node"][r], differ, l))
        l, r, apart = l[order], r[order], apart[order]
        first = np.flatnonzero(np.concatenate([[True], l[1:] != l[:-1]])) if len(l) else l
        rank = np.arange(len(l)) - np.repeat(first, np.diff(np.append(first, len(l))))
        taken = apart & (rank >= low) & (rank < (high or len(l)))
        a, b = x["node"][l[taken]], x["node"][r[taken]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows stand by block pair and block. The last block pair is held back until the next one begins."""
        names, held = ["g", "_x", "_y", "_block", "node", "i", "n", "label"], None
        for batch in chain(batches, [None]):
            if batch is None:
                if held is None:
                    return
                x, held, ends = held, None, True
            else:
                x = {c: batch.column(k).to_numpy() for k, c in enumerate(names)}
                x["bits"] = np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint64).reshape(-1, PARITY_BITS // 64)
                x, ends = x if held is None else {c: np.concatenate([held[c], x[c]]) for c in x}, False
            new = np.concatenate([[True], (x["g"][1:] != x["g"][:-1]) | (x["_x"][1:] != x["_x"][:-1]) | (x["_y"][1:] != x["_y"][:-1])])
            starts = np.flatnonzero(new)
            if not ends:
                held = {c: v[starts[-1] :] for c, v in x.items()}
                x, starts = {c: v[: starts[-1]] for c, v in x.items()}, starts[:-1]
            if not len(starts):
                continue
            stops = np.append(starts[1:], len(x["g"]))
            group = np.repeat(np.arange(len(starts)), stops - starts)
            lefts = x["_block"] == x["_x"]
            within = x["_x"][starts] == x["_y"][starts]
            begin = np.where(within, starts, starts + np.bincount(group[lefts], minlength=len(starts)))
            left = np.flatnonzero(lefts)
            begin, count = begin[group[left]], (stops - begin)[group[left]]
            total = np.cumsum(count)
            for k in np.split(np.arange(len(left)), np.searchsorted(total, np.arange(PAIRS, total[-1] if len(total) else 0, PAIRS))):
                if len(k):
                    yield emit(left[k], begin[k], count[k], x)

    return named.repartition("g", "_x", "_y").sortWithinPartitions("g", "_x", "_y", "_block").mapInArrow(pair, "a long, b long").distinct()


def grouped(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """near_dedup's rows with the hash of each text: (_id, _hash, n, component, kept)."""
    rows = written(signatures(docs, id_col, text_col, size).withColumn("_row", F.monotonically_increasing_id()), "near-signatures")
    nodes = rows.where("n > 0").groupBy("_digest").agg(F.min_by(F.struct("_row", "_id", "_hash", "n", "_minhashes"), "_row").alias("x"))
    nodes = written(nodes.select("_digest", F.col("x._row").alias("node"), "x._id", "x._hash", "x.n", "x._minhashes"), "near-nodes")
    members = written(buckets(nodes), "near-buckets")
    chosen = members.select(F.col("node").alias("_node")).distinct().join(nodes, F.col("_node") == F.col("node")).select("node", F.col("_id").alias("_of"), F.col("_hash").alias("_h"))
    texts = id_and_text(docs, id_col, text_col).withColumn("_hash", F.xxhash64("_text"))
    texts = texts.join(chosen, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_hash") == F.col("_h"))).select("node", "_text").dropDuplicates(["node"])  # rows that repeat id and text are one node

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x, size).tobytes() for x in batch.column(1).cast(pa.binary()).to_pylist()], pa.binary())], ["node", "set"])

    sets = written(texts.mapInArrow(as_sets, "node long, set binary"), "near-sets")
    links = written(verified(sized(leader_pairs(members), nodes, percent), sets, percent), "near-links")
    labels = components(links)
    dealt = candidates(members, labels, sets, percent)
    for low, high in pairwise(RANKS):
        more = written(verified(across(dealt, labels, percent, low, high), sets, percent), "near-links")
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
    found = nodes.select("_digest", "node").join(labels.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(F.col("_digest").alias("_d"), F.coalesce("label", "node").alias("label"))
    named = rows.join(found, F.col("_digest") == F.col("_d"), "left").select("_id", "_hash", "n", "_row", F.when(F.col("n") > 0, F.col("label")).otherwise(F.col("_row")).alias("label"))
    least = named.groupBy("label").agg(F.min(F.struct(F.isnull("_id").alias("_null"), F.col("_id"), F.col("_row"))).alias("_first"))
    return named.join(least, "label").select("_id", "_hash", "n", F.col("_first._id").alias("component"), (F.col("_row") == F.col("_first._row")).alias("kept"))


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Components of documents linked by a Jaccard likeness of `percent` and more between their sets of word shingles.

    Words are lower-cased (A-Z); a set holds the distinct runs of `size` words, or the whole of a shorter text. Returns
    id_col, n_shingles, component_id (the smallest id of the component), kept (the row that bears it).

    A null or empty text, or one without words, has an empty set and stands alone. A null id comes after all others; of
    repeated ids in a component one row is kept. Equal sets count as one node, so copies cost one comparison in all.
    Extra columns are not read. An empty table gives an empty one.
    """
    found = grouped(docs, id_col, text_col, size, percent)
    return found.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def without_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` that near_dedup keeps, with all their columns: one row of each component, also where rows share an id, or an id and a text."""
    of = grouped(docs, id_col, text_col, size, percent).groupBy(F.col("_id").alias("_kept_id"), F.col("_hash").alias("_kept_raw"))
    kept = of.agg(F.count("*").alias("_times"), F.bool_or("kept").alias("_kept")).where("_kept").drop("_kept")
    return rows_kept(docs, kept, id_col, text_col)
