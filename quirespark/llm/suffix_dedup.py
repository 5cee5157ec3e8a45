"""Suffix dedup: bytes covered by a string of WIDTH bytes that starts earlier too.

Only the first WIDTH bytes of a suffix matter here. Suffixes are dealt into buckets by content: the gram of GRAM
bytes with the least hash among those inside a suffix's first WIDTH bytes is its anchor, so equal strings have equal
anchors at equal places, and a bucket holds all suffixes with one anchor gram. Buckets of one anchor are left alone.
Buckets of very many rows are found by a count first and dealt out by exact content instead (hot_spans_of).

The rest is blockwise: buckets come in BLOCKS blocks by their gram's hash, one block after the other, and inside a
block bucket by bucket. A bucket's suffixes are compared by their first bytes up to the next sample position, and
longer ties by the ranks of the sample positions there, which are made once for a batch by doubling. Suffixes of one
bucket are aligned at their anchor, so every STEP-th place counted from it is a cover for all their differences.
"""

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text, mix64, written

WIDTH = 100
GRAM = 32
REACH = WIDTH - GRAM  # how far before its anchor a suffix may start
BLOCKS = 2
STEP = 4
BUFFER = 1 << 20
MOST = 4000  # rows of a bucket that one task may sort; see hot_spans_of
BINS = 1 << 20
_BLOCK_SEED = 0x5851F42D4C957F2D
_SPAN = REACH + WIDTH  # bytes around an anchor that any of its suffixes can reach
_COLUMNS = 176  # the same, made a multiple of 8
_MIX = mix64(np.arange(1, _COLUMNS // 8 + 1, dtype=np.uint64)) | np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on."""
    words = np.lib.stride_tricks.as_strided(data.view(np.uint8)[:8].view("<u8"), (len(data) - 7,), (1,))
    with np.errstate(over="ignore"):
        x = mix64(words.astype(np.uint64))
        n = len(data) - GRAM + 1
        h = x[:n].copy()
        for k in range(8, GRAM, 8):
            h = h * np.uint64(0x9E3779B97F4A7C15) + x[k : k + n]
        return mix64(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by running minima of blocks from both sides."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = x
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).reshape(-1)
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, anchor, first, last): the runs of suffix starts that share an anchor, in order. `data` is at most 2 ** 31 bytes and at least WIDTH."""
    h = gram_hashes(data)
    low = np.uint64((1 << 31) - 1)
    at = (sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), REACH + 1) & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return h[at[first]], at[first], first, last


ROWS = "key long, _id long, _hash long, at long, first int, last int, bytes binary"
_NAMES = [x.split()[0] for x in ROWS.split(", ")]


def _segments(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Batches of (text number, offset, bytes), each of about BUFFER bytes; long texts in pieces that overlap by WIDTH - 1."""
    batch, size = [], 0
    for number, text in enumerate(texts):
        for offset in range(0, max(0, len(text) - WIDTH + 1), BUFFER):
            piece = text[offset : offset + BUFFER + WIDTH - 1]
            batch.append((number, offset, piece))
            size += len(piece)
            if size >= BUFFER:
                yield batch
                batch, size = [], 0
    if batch:
        yield batch


def _placed(segments: list[tuple[int, int, bytes]], wanted: Callable[[np.ndarray], np.ndarray]) -> tuple:
    """(data, ends, lengths, key, at, first, last, of, again): the wanted anchors of a batch of segments, in order; again tells those whose suffixes all occurred before in their segment."""
    data = b"".join(s[2] for s in segments)
    lengths = np.array([len(s[2]) for s in segments])
    ends = np.cumsum(lengths)
    gram, at, first, last = anchors(np.frombuffer(data, np.uint8))
    of_first = np.searchsorted(ends, first, side="right")
    # runs of starts may go over the ends of texts: cut them to the starts that have WIDTH bytes in their own
    of_last = np.searchsorted(ends, last, side="right")
    split = np.flatnonzero(of_last > of_first)
    more = [(k, s) for k in split for s in range(of_first[k] + 1, of_last[k] + 1)]
    if more:
        extra = np.array(more)
        gram, at, last = (np.concatenate([x, x[extra[:, 0]]]) for x in (gram, at, last))
        first = np.concatenate([first, ends[extra[:, 1] - 1]])
        of_first = np.concatenate([of_first, extra[:, 1]])
    last = np.minimum(last, ends[of_first] - WIDTH)
    with np.errstate(over="ignore"):
        key = mix64(gram + np.uint64(_BLOCK_SEED))
    keep = np.flatnonzero((last >= first) & wanted(key))
    order = keep[np.lexsort((first[keep], of_first[keep]))]
    key, at, first, last, of = key[order], at[order], first[order], last[order], of_first[order]
    with np.errstate(over="ignore"):
        own = mix64(key + mix64(of.astype(np.uint64)))
    _, inverse, count = np.unique(own, return_inverse=True, return_counts=True)
    again, seen = np.zeros(len(key), bool), set()
    for k in np.flatnonzero(count[inverse] > 1).tolist():
        what = (int(of[k]), int(first[k] - at[k]), data[first[k] : last[k] + WIDTH])
        again[k] = what in seen
        seen.add(what)
    return data, ends, lengths, key, at, first, last, of, again


def hot_bins(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Which of BINS classes of keys hold more than MOST rows and twice a class's mean, and their share of all rows. Every bucket of more rows than that lies in such a class.

    Each task counts into BINS numbers; the driver receives the classes above the bound only.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BINS, np.int64)
        for batch in batches:
            for segments in _segments(batch.column(0).cast(pa.binary()).to_pylist()):
                _, _, _, key, *_, again = _placed(segments, lambda k: np.ones(len(k), bool))
                n += np.bincount(_bin(key[~again]), minlength=BINS)
        some = np.flatnonzero(n)
        for k in range(0, len(some), 1 << 16):
            part = some[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[part])], ["bin", "n"])

    counts = written(rows.select("_text").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")), "suffix-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > MOST + 2 * total / BINS).toArrow()
    out = np.zeros(BINS, bool)
    out[hot["bin"].to_numpy()] = True
    return out, int(hot["n"].to_numpy().sum()) / max(total, 1)


def _bin(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)


def anchored(rows: DataFrame, block: int, blocks: int, bins: np.ndarray | None = None, hot: bool = False) -> DataFrame:
    """ROWS of this block's anchors: key (of the gram), the document, the anchor's place, the starts of its suffixes relative to it, and the bytes these reach. With `bins`, only the hot or only the other keys.

    Inside a document an anchor whose suffixes all occurred before, with the same bytes, needs no comparison. Such
    anchors' stretches are joined, one row each with null bytes. That keeps texts of one repeated phrase small.
    """

    shared = None if bins is None else rows.sparkSession.sparkContext.broadcast(bins)

    def wanted(key: np.ndarray) -> np.ndarray:
        mine = key % np.uint64(blocks) == np.uint64(block)
        return mine if shared is None else mine & (shared.value[_bin(key)] == hot)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            ids, hashes = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for segments in _segments(texts):
                data, ends, lengths, key, at, first, last, of, again = _placed(segments, wanted)
                if not len(key):
                    continue
                number = np.array([s[0] for s in segments])[of]
                start = np.array([s[1] for s in segments])[of] - (ends - lengths)[of]  # from places in the buffer to places in the text
                # stretches that repeat inside their document need no bucket: one row each, under keys of their own
                line = (number << 32) + start
                begin, end = merged((line + first)[again], (line + last)[again] + WIDTH)
                which, new = np.concatenate([number[~again], begin >> 32]), ~again
                reach = [data[x:y] for x, y in zip(first[new].tolist(), (last[new] + WIDTH).tolist(), strict=True)] + [None] * len(begin)
                columns = [
                    np.concatenate([key[new], mix64(begin.astype(np.uint64))]).view(np.int64),
                    ids[which],
                    hashes[which],
                    np.concatenate([(at + start)[new], begin & 0xFFFFFFFF]),
                    np.concatenate([(first - at)[new], np.zeros(len(begin), np.int64)]).astype(np.int32),
                    np.concatenate([(last - at)[new], end - begin - WIDTH]).astype(np.int32),
                ]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(reach, pa.binary())], _NAMES)

    return rows.mapInArrow(find, ROWS)


def sample_ranks(context: np.ndarray) -> np.ndarray:
    """rows x columns: the rank, among all of the batch, of the 64 bytes from each STEP-th column on; ranks stand as the byte strings do."""
    m = len(context)
    rank = np.ascontiguousarray(context).view(">u4").reshape(m, _COLUMNS // STEP).astype(np.uint64)
    size = STEP
    while size < 64:
        ahead = size // STEP
        both = (rank[:, :-ahead] << np.uint64(32)) | rank[:, ahead:]
        rank = np.unique(both, return_inverse=True)[1].reshape(both.shape).astype(np.uint64)
        size *= 2
    return rank


def repeated_starts(bucket: np.ndarray, context: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts the suffixes of each bucket and tells which are equal, over WIDTH bytes, to one of an earlier row: (row, start relative to the anchor, repeated)."""
    sizes = last - first + 1
    row = np.repeat(np.arange(len(first)), sizes)
    start = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[row]
    rank = sample_ranks(context)
    s = start + REACH
    k = -s % STEP  # bytes before the next sample position
    c = (s + k) // STEP
    # the suffix is k bytes, 96 that two overlapping ranks stand for, and STEP - k bytes
    ranks = np.unique((rank[row, c] << np.uint64(32)) | rank[row, c + 32 // STEP], return_inverse=True)[1].astype(np.uint64)
    rest = np.zeros(len(s), np.uint64)
    flat, line = context.reshape(-1), row * _COLUMNS + s
    for j in range(STEP):
        rest = (rest << np.uint64(8)) | flat[np.where(j < k, line + j, line + 96 + j)]
    name = np.unique((ranks << np.uint64(32)) | rest, return_inverse=True)[1].astype(np.uint64)
    place = np.unique(bucket.astype(np.uint64)[row] * np.uint64(REACH + 1) + s.astype(np.uint64), return_inverse=True)[1].astype(np.uint64)
    whole = (place << np.uint64(32)) | name
    order = np.argsort(whole, kind="stable")
    repeated = np.zeros(len(s), bool)
    repeated[order[1:]] = whole[order[1:]] == whole[order[:-1]]
    return row, start, repeated


def contexts(data: np.ndarray, offsets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """rows x _COLUMNS bytes, each row's bytes laid so that its anchor stands at column REACH, and zeros around."""
    lengths = offsets[1:] - offsets[:-1]
    out = np.zeros((len(first), _COLUMNS), np.uint8)
    row = np.repeat(np.arange(len(first)), lengths)
    column = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + (REACH + first)[row]
    out[row, column] = data[offsets[0] : offsets[-1]]
    return out


def _runs(flags: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of flags in one row."""
    on = np.flatnonzero(flags)
    if not len(on):
        return on, on
    cut = (on[1:] != on[:-1] + 1) | (row[on[1:]] != row[on[:-1]])
    return on[np.concatenate([[True], cut])], on[np.concatenate([cut, [True]])]


def spans_of(rows: DataFrame) -> DataFrame:
    """(_id, _hash, begin, end): stretches of bytes to remove, from ROWS."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last bucket so far, one for each run of bytes in it; they only serve to compare
        for batch in batches:
            table = pa.Table.from_batches([batch]).append_column("old", pa.array(np.zeros(batch.num_rows, bool)))
            if held is not None:
                table = pa.concat_tables([held, table])
            table = table.combine_chunks()
            if not len(table):
                continue
            key = table["key"].to_numpy()
            bytes_ = table["bytes"].combine_chunks()
            bytes_ = bytes_.chunk(0) if isinstance(bytes_, pa.ChunkedArray) else bytes_
            none = bytes_.is_null().to_numpy(zero_copy_only=False)
            ids, hashes, at, old = (table[c].to_numpy() for c in ("_id", "_hash", "at", "old"))
            first, last = table["first"].to_numpy().astype(np.int64), table["last"].to_numpy().astype(np.int64)
            out = [(ids[none], hashes[none], (at + first)[none], (at + last)[none] + WIDTH)]
            known = ~none
            edge = np.concatenate([[True], key[1:] != key[:-1]])
            bucket = np.cumsum(edge) - 1
            members = np.bincount(bucket[known], minlength=bucket[-1] + 1)
            open_ = bucket == bucket[-1]
            pick = np.flatnonzero(known & ((members[bucket] > 1) | open_))
            keep = np.zeros(0, np.int64)
            if len(pick):
                chosen = bytes_.take(pa.array(pick))
                offsets = np.frombuffer(chosen.buffers()[1], np.int32)[: len(pick) + 1].astype(np.int64)
                context = contexts(np.frombuffer(chosen.buffers()[2], np.uint8) if chosen.buffers()[2] else np.zeros(0, np.uint8), offsets, first[pick])
                with np.errstate(over="ignore"):
                    h = mix64((context.view("<u8") * _MIX[None, :]).sum(axis=1, dtype=np.uint64) + mix64(key[pick].view(np.uint64) + (first[pick] * 256 + last[pick]).view(np.uint64)))
                order = np.argsort(h, kind="stable")
                new = np.concatenate([[True], h[order[1:]] != h[order[:-1]]])
                leader = np.empty(len(pick), np.int64)
                leader[order] = order[new][np.cumsum(new) - 1]
                same = (leader != np.arange(len(pick))) & (key[pick] == key[pick][leader]) & (first[pick] == first[pick][leader]) & (last[pick] == last[pick][leader])
                same[same] = (context[same] == context[leader[same]]).all(axis=1)
                whole = pick[same & ~old[pick]]
                out.append((ids[whole], hashes[whole], (at + first)[whole], (at + last)[whole] + WIDTH))
                solo = np.flatnonzero(~same)
                keep = pick[solo][bucket[pick[solo]] == bucket[-1]]
                kinds = np.bincount(bucket[pick[solo]], minlength=bucket[-1] + 1)
                solo = solo[kinds[bucket[pick[solo]]] > 1]
                for part in _parts(bucket[pick[solo]]):
                    mine = solo[part]
                    rows_ = pick[mine]
                    row, start, repeated = repeated_starts(bucket[rows_], context[mine], first[rows_], last[rows_])
                    a, b = _runs(repeated & ~old[rows_][row], row)
                    r = rows_[row[a]]
                    out.append((ids[r], hashes[r], at[r] + start[a], at[r] + start[b] + WIDTH))
            held = table.take(pa.array(keep)).set_column(7, "old", pa.array(np.ones(len(keep), bool)))
            columns = [np.concatenate([o[k] for o in out]) for k in range(4)]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["_id", "_hash", "begin", "end"])

    return rows.repartition("key").sortWithinPartitions("key", "_id", "_hash", "at", "first").mapInArrow(sort, "_id long, _hash long, begin long, end long")


def _suffixes(with_bytes: bool) -> Callable:
    """Of ROWS, a row for each suffix: its place, a 64-bit hash of its bytes and, with_bytes, these."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 200) for k in range(0, batch.num_rows, 200)):
                ids, hashes, at, first, last = (part.column(k).to_numpy() for k in range(5))
                texts = part.column(5).to_pylist()
                begins = np.cumsum([0, *map(len, texts)])[:-1]
                sizes = last - first + 1
                row = np.repeat(np.arange(len(sizes)), sizes)
                step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                bytes_ = np.frombuffer(b"".join(texts), np.uint8)[(begins[row] + step)[:, None] + np.arange(WIDTH)]
                padded = np.zeros((len(row), -(-WIDTH // 8) * 8), np.uint8)
                padded[:, :WIDTH] = bytes_
                with np.errstate(over="ignore"):
                    name = mix64((mix64(padded.view("<u8").astype(np.uint64)) * _MIX[None, : padded.shape[1] // 8]).sum(axis=1, dtype=np.uint64))
                columns = [pa.array(x) for x in (ids[row], hashes[row], at[row], (first[row] + step).astype(np.int32), name.view(np.int64))]
                if with_bytes:
                    offsets = np.arange(len(row) + 1, dtype=np.int32) * WIDTH
                    columns.append(pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(bytes_))]))
                yield pa.RecordBatch.from_arrays(columns, ["_id", "_hash", "at", "start", "name", "suffix"][: len(columns)])

    return expand


def hot_spans_of(rows: DataFrame) -> DataFrame:
    """As spans_of, for keys of many rows: no task holds a bucket.

    Rows are dealt by all they hold. Of equal ones only the least goes on, and the others are repeated whole. Those that
    go on are dealt suffix by suffix: a suffix whose hash no other has is not repeated; of the rest, grouped by their
    bytes, all but the least are. Each group is a partial aggregation, and leaders are taken out by place, so a string
    that very many documents hold is not one task's either.
    """
    rows = written(rows, "suffix-hot")
    whole = [F.col("_id"), F.col("_hash"), (F.col("at") + F.col("first")).alias("begin"), (F.col("at") + F.col("last") + WIDTH).alias("end")]
    known, place = rows.where("bytes IS NOT NULL"), ["_id", "_hash", "at", "first"]
    least = known.groupBy("key", "first", "last", "bytes").agg(F.min(F.struct("_id", "_hash", "at")).alias("x"))
    least = written(least.select("x.*", "first", "last", "bytes"), "suffix-kinds")
    copies = known.select(*place, "last").join(least.select(*place), place, "left_anti").select(*whole)
    suffix = "_id long, _hash long, at long, start int, name long"
    names = least.mapInArrow(_suffixes(False), suffix).groupBy("name").count().where("count > 1").select("name")
    shared = written(least.mapInArrow(_suffixes(True), suffix + ", suffix binary").join(names, "name", "left_semi"), "suffix-shared")
    lead = shared.groupBy("suffix").agg(F.min(F.struct("_id", "_hash", "at", "start")).alias("x")).select("x.*", F.lit(True).alias("lead"))
    both = shared.select("_id", "_hash", "at", "start", F.lit(False).alias("lead")).unionByName(lead)
    starts = F.array_except(F.collect_set(F.when(~F.col("lead"), F.col("start"))), F.collect_set(F.when(F.col("lead"), F.col("start"))))
    runs = both.groupBy("_id", "_hash", "at").agg(F.array_sort(starts).alias("s"))
    edge = lambda by: F.filter("s", lambda x: ~F.array_contains(F.col("s"), x + by))
    runs = runs.select("_id", "_hash", "at", F.explode(F.arrays_zip(edge(-1).alias("a"), edge(1).alias("b"))).alias("run"))
    parts = runs.select("_id", "_hash", (F.col("at") + F.col("run.a")).alias("begin"), (F.col("at") + F.col("run.b") + WIDTH).alias("end"))
    return rows.where("bytes IS NULL").select(*whole).unionByName(copies).unionByName(parts)


def _parts(bucket: np.ndarray, most: int = 4000) -> Iterator[slice]:
    """Slices of whole buckets, of about `most` rows."""
    begin = 0
    while begin < len(bucket):
        end = min(begin + most, len(bucket))
        if end < len(bucket):
            end = int(np.searchsorted(bucket, bucket[end - 1], side="right"))
        yield slice(begin, end)
        begin = end


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that the given stretches cover; those that touch are one."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    if not len(begin):
        return begin, end
    cut = begin[1:] > end[:-1]
    return begin[np.concatenate([[True], cut])], end[np.concatenate([cut, [True]])]


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS, with_text: bool = False) -> DataFrame:
    """Removes each byte covered by a string of WIDTH bytes that starts earlier too: in a document of smaller id, or in the same one.

    Returns id_col (whole numbers), n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with_text,
    kept (the remaining bytes). Strings are judged on the input, not on what is left; they never go over the end of a text.

    A null text counts as empty. A null id comes after all others. Documents that share an id stand in the order of
    their texts' hashes; rows that repeat both id and text count as one document, and each gets its result. Extra
    columns are not read. An empty table gives an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    last_id, no_id = (1 << 63) - 1, 1 << 62  # a null id stands as the largest one, and its texts' hashes stand after all others
    hash_ = F.xxhash64("_text").bitwiseAND(F.lit(no_id - 1)) + F.when(F.col("_id").isNull(), no_id).otherwise(0)
    rows = id_and_text(docs, id_col, text_col).select(F.coalesce(F.col("_id").cast("long"), F.lit(last_id)).alias("_id"), hash_.alias("_hash"), "_text")
    bins, share = hot_bins(rows)
    hot_blocks = math.ceil(blocks * share)
    spans = None
    for block in range(blocks + hot_blocks):
        if block < blocks:
            found = spans_of(anchored(rows, block, blocks, bins if share else None))
        else:
            found = hot_spans_of(anchored(rows, block - blocks, hot_blocks, bins, hot=True))
        found = written(found, "suffix-spans")
        spans = found if spans is None else spans.unionByName(found)
    listed = spans.groupBy("_id", "_hash").agg(F.collect_list("begin").alias("_begins"), F.collect_list("end").alias("_ends")).withColumnsRenamed({"_id": "_d", "_hash": "_h"})
    joined = rows.join(listed, (F.col("_id") == F.col("_d")) & (F.col("_hash") == F.col("_h")), "left").select("_id", "_text", "_begins", "_ends", (F.col("_hash") >= no_id).alias("_none"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text, begins, ends, none in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2), batch.column(3), batch.column(4).to_pylist(), strict=True):
                a, b = (np.zeros(0, np.int64),) * 2 if not begins.is_valid else merged(begins.values.to_numpy(), ends.values.to_numpy())
                edges = [0, *np.stack([a, b], axis=1).reshape(-1).tolist(), len(text)]
                kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                out.append((None if none else i, len(text), int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns[: len(names)], names)

    names = ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    result = joined.mapInArrow(remove, "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
    return result.select(F.col("_id").cast(kind).alias(id_col), *names[1:])
