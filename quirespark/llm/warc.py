"""WARC in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of whole WARC records, and ends in the public seekable
format's seek table (a skippable frame of compressed and plain sizes, a count and a magic number). An index table maps
every record's identifier to its bundle, the frame's place and the record's offset inside the plain frame, so that
one record costs one ranged read and one frame.
"""

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, qualified, written

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 30
LEAST_REVISIT = 1000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
URN = "urn:x-page:"


def record(page: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """A response record, or with `refers_to` a revisit record without payload."""
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{URN}{page}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(size))]
    if refers_to is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        head.append(("Content-Type", "application/http; msgtype=response"))
    else:
        block = b""
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{URN}{refers_to}>")]
    head.append(("Content-Length", str(len(block))))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def records_in(plain: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields (names in lower case) and block of every record of a plain frame."""
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        lines = plain[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins at {at}")
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        size = int(fields["content-length"])
        yield at, fields, plain[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


#: Names by which Hadoop knows stores that the reader of files knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it of a URI as Spark writes it: local files, S3, Google and Azure storage, HDFS (which needs libhdfs on each worker); dbfs:/ stands for its mount, /dbfs."""
    scheme, _, rest = uri.partition(":")
    if scheme == "dbfs":
        return fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


class Bundle:
    """An open bundle. It is written under a name of its own attempt and gets its final name when it is whole."""

    def __init__(self, uri: str) -> None:
        self.uri = uri
        self.files, self.path = file_system(uri)
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.files.open_output_stream(self.path + ".part")
        self.frames: list[tuple[int, int]] = []
        self.plain = bytearray()
        self.waiting: list[tuple] = []
        self.done: list[tuple] = []
        self.at = 0

    def add(self, key: tuple, data: bytes) -> None:
        self.waiting.append((*key, len(self.plain), len(data)))
        self.plain += data
        if len(self.plain) >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.plain:
            packed = zstandard.ZstdCompressor(level=3, write_content_size=True).compress(bytes(self.plain))
            self.out.write(packed)
            self.done += [(*key, self.uri, self.at, len(packed), offset, size) for *key, offset, size in self.waiting]
            self.frames.append((len(packed), len(self.plain)))
            self.at += len(packed)
            self.plain, self.waiting = bytearray(), []

    def close(self) -> list[tuple]:
        self.flush()
        body = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.out.close()
        self.files.move(self.path + ".part", self.path)
        return self.done


    def abandon(self) -> None:
        self.out.close()
        self.files.delete_file(self.path + ".part")


def seek_table(data: pa.NativeFile, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame, from the end of an open bundle."""
    data.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", data.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("the file has no seek table")
    data.seek(size - 9 - 8 * n)
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", data.read(8 * n)):
        out.append((at, packed, plain))
        at += packed
    return out


INDEX = "record_id string, bundle string, frame_at long, frame_size long, offset long, length long"


def write_warc(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", path: str | None = None) -> DataFrame:
    """Writes a record for every row, in bundles below `path` (of the shared folder unless given), and returns the index.

    Rows with equal payloads of LEAST_REVISIT bytes and more refer to that with the largest id; rows that repeat the
    largest id are responses each, and where all ids are null all are. A null payload counts as empty, a null url is
    left out; ids are whole numbers or null. Extra columns are not read. An empty table writes no bundle. A task that runs again writes new bundles;
    the index names only those of tasks that ended well.
    """
    path = qualified(pages.sparkSession, path or new_path(pages.sparkSession, "warc"))
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").cast("string").alias("_url"), payload.alias("_payload"))
    rows = rows.withColumn("_key", F.when(F.octet_length("_payload") >= LEAST_REVISIT, F.sha2("_payload", 256)))
    groups = rows.where("_key IS NOT NULL").groupBy(F.col("_key").alias("_of")).agg(F.max("_id").alias("_first"), F.count("*").alias("_size")).where("_size > 1").drop("_size")
    refers = F.when(~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first"))
    # small payloads have no key: in a join all of them would go to one task
    small = rows.where("_key IS NULL").withColumn("_first", F.lit(None).cast(groups.schema["_first"].dataType))
    keyed = rows.where("_key IS NOT NULL").join(groups, F.col("_key") == F.col("_of"), "left").drop("_of")
    rows = keyed.unionByName(small).select("_id", "_url", F.when(refers.isNull(), F.col("_payload")).alias("_body"), F.sha1("_payload").alias("_sha"), F.octet_length("_payload").alias("_bytes"), refers.alias("_refers"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        try:
            for batch in batches:
                ended = []
                for page, url, body, sha, size, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    bundle = bundle or Bundle(f"{path}/{uuid.uuid4().hex}.warc.zst")
                    bundle.add((f"{URN}{page}",), record(page, url, (body or "").encode(), sha, size, refers_to))
                    if bundle.at >= BUNDLE_BYTES:
                        ended += bundle.close()
                        bundle = None
                if ended:
                    yield as_index(ended)
            if bundle:
                ended, bundle = bundle.close(), None
                yield as_index(ended)
        finally:
            if bundle:  # the task fails
                bundle.abandon()

    def as_index(found: list[tuple]) -> pa.RecordBatch:
        names = [x.split()[0] for x in INDEX.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names)

    return written(rows.mapInArrow(write, INDEX), "warc-index")


def read_warc(index: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """Every record of the index's bundles: page_id, payload_bytes, payload_digest, record_type, refers_to and, as asked, payload (null for revisits).

    Frames are found by each bundle's seek table and read one by one, so work is dealt out by frames, not files. A
    response's payload is checked against its digest and length. A record written for a null id has a null page_id,
    repeated rows are records each, and an index without rows gives an empty table; of the index, only `bundle` is read.
    """

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for uri in batch.column(0).to_pylist():
                files, path = file_system(uri)
                with files.open_input_file(path) as f:
                    out += [(uri, at, packed, plain) for at, packed, plain in seek_table(f, f.size())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["bundle", "at", "packed", "plain"])

    def number(field: str | None) -> int | None:
        text = (field or "").removeprefix(f"<{URN}").removesuffix(">")
        return int(text) if text not in ("", "None") else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, at, packed, plain in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files, path = file_system(uri)
                with files.open_input_file(path) as f:
                    f.seek(at)
                    data = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=plain)
                out = []
                for _, head, block in records_in(data):
                    digest, size = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
                    body = None
                    if head["warc-type"] == "response":
                        body = block[block.index(b"\r\n\r\n") + 4 :]
                        if len(body) != size or hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"{head['warc-record-id']} in {uri} is damaged")
                    out.append((number(head["warc-record-id"]), size, digest, head["warc-type"], number(head.get("warc-refers-to")), body.decode() if with_payload and body is not None else None))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns[: len(names)], names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload string" * with_payload
    found = index.select("bundle").distinct().mapInArrow(frames, "bundle string, at long, packed long, plain long")
    return found.repartition("bundle", "at").mapInArrow(read, schema)


def fetch(index: DataFrame, record_ids: list[str]) -> dict[str, bytes]:
    """The plain records of a few identifiers, by their frames alone."""
    out = {}
    for r in index.where(F.col("record_id").isin(record_ids)).collect():
        files, path = file_system(r["bundle"])
        with files.open_input_file(path) as f:
            f.seek(r["frame_at"])
            plain = zstandard.ZstdDecompressor().decompress(f.read(r["frame_size"]))
        out[r["record_id"]] = plain[r["offset"] : r["offset"] + r["length"]]
    return out
