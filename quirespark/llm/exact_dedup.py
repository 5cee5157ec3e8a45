"""Exact dedup: polynomial fingerprints that combine over chunks, then a comparison of the texts that share one.

A chunk's hash is its bytes read as digits to a base, modulo a prime; that of two chunks laid end to end is
hash(a) * base ** len(b) + hash(b), so a text of any length is hashed chunk by chunk, in any grouping, and a
chunk is never larger than CHUNK bytes. Two primes and the length make up a fingerprint.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text, rows_kept, written

CHUNK = 1 << 16
PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (1_103_515_245, 1_664_525_213)
MEMBERS_A_SALT = 1000
_SPACE = bytes(32 if b in b" \t\n\v\f\r" else b for b in range(256))
_RUNS = re.compile(b" {2,}")

Fingerprint = tuple[int, int, int]


def normalised(data: bytes) -> bytes:
    """Each run of space, tab, line feed, vertical tab, form feed and carriage return becomes one space."""
    data = data.translate(_SPACE)
    return _RUNS.sub(b" ", data) if b"  " in data else data


def _powers(base: int, prime: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < CHUNK:  # doubles what there is, by base ** len(out)
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[CHUNK - 1 :: -1].copy()


POWERS = tuple(_powers(b, p) for b, p in zip(BASES, PRIMES, strict=True))


def chunk_hash(chunk: bytes) -> Fingerprint:
    """Length and two hashes of at most CHUNK bytes. Sums stay below 2 ** 56."""
    digits = np.frombuffer(chunk, np.uint8).astype(np.uint64) + np.uint64(1)
    n = len(digits)
    a, b = (int((digits * w[CHUNK - n :]).sum()) % p for w, p in zip(POWERS, PRIMES, strict=True))
    return n, a, b


def combine(left: Fingerprint, right: Fingerprint) -> Fingerprint:
    """The fingerprint of the two texts laid end to end. Associative; (0, 0, 0) is the empty text's."""
    a, b = ((x * pow(base, right[0], p) + y) % p for x, y, base, p in zip(left[1:], right[1:], BASES, PRIMES, strict=True))
    return left[0] + right[0], a, b


def fingerprint(data: bytes) -> Fingerprint:
    return reduce(combine, (chunk_hash(data[k : k + CHUNK]) for k in range(0, len(data), CHUNK)), (0, 0, 0))


def same_chunks(a: bytes, b: bytes) -> bool:
    """Compares chunk after chunk and stops at the first that differs."""
    x, y = memoryview(a), memoryview(b)
    return len(x) == len(y) and all(x[k : k + CHUNK] == y[k : k + CHUNK] for k in range(0, len(x), CHUNK))


KEY = ["_n", "_h1", "_h2"]


def fingerprints(docs: DataFrame, id_col: str, text_col: str, with_text: bool) -> DataFrame:
    """_id, the fingerprint of the normalised text in _n, _h1, _h2 and, as asked, the normalised text in _text, or its SHA-256 in _sha and the hash of the text as it stands in _raw."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["_id", *KEY, *(["_text"] if with_text else ["_sha", "_raw"])]

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normalised(x) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            keys = [fingerprint(x) for x in texts]
            last = [pa.array(texts, pa.binary())] if with_text else [pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()), batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([k[j] for k in keys], pa.int64()) for j in range(3)), *last], names)

    rows = id_and_text(docs, id_col, text_col)
    if not with_text:
        rows = rows.withColumn("_raw", F.xxhash64("_text"))
    return rows.mapInArrow(hash_texts, f"_id {kind}, _n long, _h1 long, _h2 long, " + ("_text binary" if with_text else "_sha string, _raw long"))


def dealt_shares(texts: DataFrame, kind: str) -> DataFrame:
    """(_id, KEY, _lead, _text, _salt) of texts(_id, KEY, _lead, _text, _salts): members dealt out over their group's shares, and for each share a copy of the first text.

    Many rows can have the first id, null for one. Of those that one task meets the first is copied to all shares; the
    others are members like any, dealt out in turn, so copies grow with tasks and shares and not with rows. A task
    remembers groups of more than one share only.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        led: set[tuple] = set()
        turn = 0
        for batch in batches:
            rows, salts, leads = [], [], []
            for k, (*key, lead, n) in enumerate(zip(*(batch.column(j).to_pylist() for j in (1, 2, 3, 4, 6)), strict=True)):
                first = lead and (n == 1 or tuple(key) not in led)
                if first and n > 1:
                    led.add(tuple(key))
                to = range(n) if first else (turn % n,)
                turn += not first
                rows += [k] * len(to)
                salts += to
                leads += [bool(first)] * len(to)
            for a in range(0, max(len(rows), 1), 1000):
                part = batch.take(pa.array(rows[a : a + 1000], pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(j) for j in range(4)), pa.array(leads[a : a + 1000], pa.bool_()), part.column(5), pa.array(salts[a : a + 1000], pa.int32())], ["_id", *KEY, "_lead", "_text", "_salt"])

    return texts.mapInArrow(deal, f"_id {kind}, _n long, _h1 long, _h2 long, _lead boolean, _text binary, _salt int")


def differing(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of the rows that share a fingerprint, those whose text is not that of their group's first row: _id and KEY, once each.

    A group is compared in shares of about MEMBERS_A_SALT rows, each with its own copy of the first text, so that
    no task holds a whole group; a task holds two texts at a time.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    groups = rows.groupBy(*KEY).agg(F.min(F.struct(F.isnull("_id").alias("_null"), F.col("_id"))).alias("_first"), F.count("*").alias("_size")).where("_size > 1")
    members = rows.join(groups, KEY).groupBy("_id", *KEY).agg(F.first("_first").alias("_first"), F.first("_size").alias("_size"))
    members = members.select(
        F.col("_id").alias("_member"), *(F.col(k).alias(f"{k}_") for k in KEY), F.col("_id").eqNullSafe(F.col("_first._id")).alias("_lead"), F.ceil(F.col("_size") / MEMBERS_A_SALT).cast("int").alias("_salts")
    )
    texts = fingerprints(docs, id_col, text_col, with_text=True)
    texts = texts.join(members, [F.col("_id").eqNullSafe(F.col("_member")), *(F.col(k) == F.col(f"{k}_") for k in KEY)])
    shares = dealt_shares(texts.select("_id", *KEY, "_lead", "_text", "_salts"), kind)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, first = None, b""
        for batch in batches:
            out = []
            columns = [batch.column(j) for j in range(batch.num_columns)]
            for k, at in enumerate(zip(*(c.to_pylist() for c in (columns[1], columns[2], columns[3], columns[6])), strict=True)):
                text = columns[5][k].as_py()
                if at != share:
                    share, first = at, text
                elif not same_chunks(first, text):
                    out.append(k)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(out, pa.int64())) for c in columns[:4]], ["_id", *KEY])

    return shares.repartition(*KEY, "_salt").sortWithinPartitions(*KEY, "_salt", F.col("_lead").desc()).mapInArrow(compare, f"_id {kind}, _n long, _h1 long, _h2 long").distinct()


def grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """exact_dedup's rows with a hash of each text as it stands: (_id, _raw, _sha, keep_id, group_size, kept)."""
    rows = written(fingerprints(docs, id_col, text_col, with_text=False).withColumn("_row", F.monotonically_increasing_id()), "exact-fingerprints")
    odd = differing(docs, rows, id_col, text_col).select(F.col("_id").alias("_member"), *(F.col(k).alias(f"{k}_") for k in KEY), F.lit(True).alias("_odd"))
    rows = rows.join(odd, [F.col("_id").eqNullSafe(F.col("_member")), *(F.col(k) == F.col(f"{k}_") for k in KEY)], "left")
    rows = rows.select("_id", "_row", "_raw", "_sha", *KEY, F.when(F.col("_odd"), F.col("_sha")).otherwise("").alias("_class"))
    key = [*KEY, "_class"]
    groups = rows.groupBy(*key).agg(F.min(F.struct(F.isnull("_id").alias("_null"), F.col("_id"), F.col("_row"))).alias("_first"), F.count("*").alias("group_size"))
    return rows.join(groups, key).select(
        "_id", "_raw", "_sha", F.col("_first._id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_first._row")).alias("kept")
    )


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose texts are equal once each run of white space counts as one space.

    Returns for every row id_col, keep_id (the smallest id of its group), group_size, kept and text_sha256 (of the
    normalised text). A null text counts as empty, so null and empty texts are one group. A null id comes after all
    others; of repeated rows (same id, equal texts) exactly one is kept. Extra columns are not read. An empty table
    gives an empty one. Texts with one fingerprint that differ after all are told apart by their SHA-256.
    """
    return grouped(docs, id_col, text_col).select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.col("_sha").alias("text_sha256"))


def without_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that exact_dedup keeps, with all their columns: one row of each group, also where rows share an id, or an id and a text."""
    of = grouped(docs, id_col, text_col).groupBy(F.col("_id").alias("_kept_id"), F.col("_raw").alias("_kept_raw"))
    kept = of.agg(F.count("*").alias("_times"), F.bool_or("kept").alias("_kept")).where("_kept").drop("_kept")
    return rows_kept(docs, kept, id_col, text_col)
