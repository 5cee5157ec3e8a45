"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed share of the hash range and no other. Sketches of parts merge to that
of the whole by union, and as both sides of a comparison are sampled by the same threshold, containment of a short
text in a long one is estimated without bias. A small set's sketch may be empty, which tells nothing of the set: its
containment is unknown then, and two such are compared by whether the sets are equal.
"""

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text
from .shingles import shingle_hashes, words_of

SHINGLE = 5
SHARE = 4  # one hash in so many is kept
BITS = 48
_EMPTY = np.zeros(0, np.uint64)


def hashes_of(data: bytes, size: int = SHINGLE) -> np.ndarray:
    """A hash of BITS bits for each run of `size` words, in order; fewer words are one run."""
    return shingle_hashes(words_of(data), size) >> np.uint64(64 - BITS)


def kept_of(hashes: np.ndarray, share: int = SHARE) -> np.ndarray:
    """The sketch: the distinct hashes below the threshold, ascending."""
    return np.unique(hashes[hashes < np.uint64((1 << BITS) // share)])


def sketch(data: bytes, size: int = SHINGLE, share: int = SHARE) -> np.ndarray:
    return kept_of(hashes_of(data, size), share)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the two shingle sets' union."""
    return np.union1d(a, b)


def shared_hashes(a: np.ndarray, b: np.ndarray) -> int:
    if not len(a) or not len(b):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def likeness(a: np.ndarray, b: np.ndarray, equal: bool = True) -> float:
    """Jaccard likeness of two sketches; of two empty ones 1 or 0, as `equal` says that the sets themselves are or aren't."""
    both = shared_hashes(a, b)
    union = len(a) + len(b) - both
    return both / union if union else float(equal)


def containment(a: np.ndarray, b: np.ndarray) -> float | None:
    """The share of a's shingles that b has; unknown (None) for an empty a."""
    return shared_hashes(a, b) / len(a) if len(a) else None


def as_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :].tobytes().hex()


def from_text(text: str) -> np.ndarray:
    digits = np.frombuffer(bytes.fromhex(text), np.uint8).reshape(-1, BITS // 8)
    return np.pad(digits, ((0, 0), (8 - BITS // 8, 0))).reshape(-1).view(">u8").astype(np.uint64)


def edited(text: str, following: str) -> str:
    """The last half of the code points, rounded down, gives way to as many of the following text's first."""
    cut = len(text) // 2
    return text[: len(text) - cut] + following[:cut]


def next_documents(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Documents in blocks of ascending ids, each block followed by the first document of the next one (the last, of the first).

    Columns _id, _text, _block and _after (1 for a row that only follows), and how many blocks there are. Block edges
    are quantiles of the ids; they and each block's least id are all that reaches the driver: two numbers a block.
    Null ids come first; equal ids stand in the order of their texts' hashes.
    """
    spark = docs.sparkSession
    blocks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = id_and_text(docs, id_col, text_col)
    edges = rows.select(F.percentile_approx("_id", [k / blocks for k in range(1, blocks)] or [0.5], 100 * blocks).alias("e")).first()["e"] or []
    edges = sorted(set(edges)) if blocks > 1 else []

    def block(i: int | None) -> int:
        return 0 if i is None else bisect_right(edges, i)

    @F.pandas_udf("int")
    def block_of(ids: pd.Series) -> pd.Series:
        return pd.Series([block(None if x is None else int(x)) for x in ids], dtype="int32")

    as_string = F.col("_id").cast("string")  # pandas would make floats of whole numbers beside nulls
    least = rows.select("_id", block_of(as_string).alias("_block")).groupBy("_block").agg(F.min(F.struct(F.isnotnull("_id").alias("known"), F.col("_id"))).alias("first")).collect()
    firsts = sorted((r["_block"], r["first"]["_id"]) for r in least)
    before = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        whole = [None if x is None else int(x) for x in ids]
        return pd.Series([[block(i), before[i]] if i in before else [block(i)] for i in whole], dtype=object)

    placed = rows.select("_id", "_text", F.posexplode(places(as_string)).alias("_after", "_block"))
    return placed, len(edges) + 1


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """Every document's fingerprint, and how like it is to that of its edited text and to the next document's.

    The edited text is the document with its last half replaced by the beginning of the next document by ascending
    id (after the last comes the first; a lone document follows itself). Returns id_col (whole numbers), n_chars
    (code points), n_shingles (with repeats), edited_sha256, fingerprint, edited_fingerprint (hexadecimal, 12 digits a
    hash), near_edited, near_next (Jaccard) and held_edited, held_next (the share of the document's shingles that the
    other has; null where its fingerprint is empty).

    A null text counts as empty. A fingerprint is the empty string without words, and where none of a small text's
    shingles is below the threshold (n_shingles tells these apart); of two empty ones near is 1 if the texts' shingles
    are the same, else 0. Null ids
    come first, repeated ids and rows follow each other in the order of their texts' hashes. Extra columns are not
    read. An empty table gives an empty one. Texts cross one shuffle; a task holds two texts at a time.
    """
    placed, blocks = next_documents(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["_id", "n_chars", "n_shingles", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "held_edited", "held_next"]

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # block, id, text, hashes and sketch of the row that waits for its next
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for k in range(batch.num_rows):
                i, text, after, block = (batch.column(c)[k].as_py() for c in range(4))
                hashes = hashes_of(text.encode(), size)
                own = kept_of(hashes, share)
                if last is not None and last[0] == block:
                    _, before, old, all_, kept = last
                    changed = edited(old, text).encode()
                    other_all = hashes_of(changed, size)
                    other = kept_of(other_all, share)
                    near = [likeness(kept, y, bool(len(kept) or len(y) or np.array_equal(np.unique(all_), np.unique(x)))) for x, y in ((other_all, other), (hashes, own))]
                    row = (before, len(old), len(all_), hashlib.sha256(changed).hexdigest(), as_text(kept), as_text(other), *near, containment(kept, other), containment(kept, own))
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                last = None if after else (block, i, text, hashes, own)
            types = [batch.schema.field(0).type, pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    dealt = placed.repartitionById(blocks, F.col("_block")).sortWithinPartitions("_block", "_after", F.col("_id").asc_nulls_first(), F.xxhash64("_text"))
    schema = f"_id {kind}, n_chars long, n_shingles long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, held_edited double, held_next double"
    return dealt.select("_id", "_text", "_after", "_block").mapInArrow(follow, schema).withColumnRenamed("_id", id_col)
