"""WARC archives, compressed record by record with a dictionary of their own.

An archive starts with a skippable frame that holds the dictionary; each record
is one Zstandard frame after it, so a reader needs no index to take records one
by one, and a writer none to append. Payloads that occur again are written once:
the others are `revisit` records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookup import lookup
from .common import few, in_share, shared_folder, stash, table

# Sent with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The frame that holds a dictionary, and the forms of a record.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_STATUS = "HTTP/1.1 200 OK"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Payload-Digest")
WRITTEN = "1970-01-01T00:00:00Z"

LEAST_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES = 32 << 10
# The bound of the sample that the dictionary is made of: rows, characters of each.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 16 << 10
LEVEL = 3
CHUNK = 1 << 20

PAGE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


class WarcError(ValueError):
    """An archive that is not what its headers say."""


def _store(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    if ":" not in uri.split("/", 1)[0]:
        return arrow_fs.LocalFileSystem(), uri
    return arrow_fs.FileSystem.from_uri(uri)


def _clean(value: str) -> str:
    """A header's value without control characters, which would end it."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


# The page's id, the payload's digest, and of a revisit its place.
_URN = re.compile(r"<urn:page:(-?\d*):[0-9a-f]{40}[^<>]*>")


def record(
    page_id: int | None, url: str | None, payload: bytes, sha1: bytes, owner: int | None, place: str = ""
) -> bytes:
    """A response record, or a revisit of `owner`'s if there is one; `place` tells revisits apart."""
    http = f"{HTTP_STATUS}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if owner is not None else http + payload
    lines = [
        VERSION,
        f"WARC-Type: {'response' if owner is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}:{sha1.hex()}{'' if owner is None else place}>",
        f"WARC-Date: {WRITTEN}",
        *([] if url is None else [f"WARC-Target-URI: {_clean(url)}"]),
        *([] if owner is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{owner}:{sha1.hex()}>"]),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> dict[str, str]:
    found = {}
    for line in data.decode().split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"a header without a colon: {line[:80]!r}")
        found[name] = value.strip()
    return found


def parse(data: bytes) -> tuple[int | None, str | None, int, str, str, int | None, bytes | None]:
    """The row of a record, as `PAGE` has it, and its payload. Anything amiss is an error."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, _, lines = head.partition(b"\r\n")
    if first.decode(errors="replace") != VERSION or not gap:
        raise WarcError(f"not a record: {data[:20]!r}")
    headers = _headers(lines)
    if missing := [name for name in REQUIRED if name not in headers]:
        raise WarcError(f"headers missing: {missing}")
    length = int(headers["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {length}, but {len(rest) - 4} bytes follow")
    status, _, http = rest[:length].partition(b"\r\n")
    fields, gap, payload = http.partition(b"\r\n\r\n")
    if status.decode(errors="replace") != HTTP_STATUS or not gap:
        raise WarcError("the block is not an HTTP response")
    size = int(_headers(fields)["Content-Length"])
    algorithm, _, digest = headers["WARC-Payload-Digest"].partition(":")
    if algorithm != "sha1":
        raise WarcError(f"unknown digest: {algorithm}")
    sha1 = base64.b32decode(digest)
    kind = headers["WARC-Type"]
    if not (own := _URN.fullmatch(headers["WARC-Record-ID"])):
        raise WarcError(f"unknown record id: {headers['WARC-Record-ID']}")
    page = int(own[1]) if own[1] else None
    if kind == "response":
        if len(payload) != size or hashlib.sha1(payload).digest() != sha1:
            raise WarcError("the payload is not the one of its headers")
        owner = None
    elif kind == "revisit":
        if payload:
            raise WarcError("a revisit with a payload")
        if not (other := _URN.fullmatch(headers.get("WARC-Refers-To", ""))) or not other[1]:
            raise WarcError("a revisit of nothing known")
        owner, payload = int(other[1]), None
    else:
        raise WarcError(f"unknown type: {kind}")
    return page, headers.get("WARC-Target-URI"), size, sha1.hex(), kind, owner, payload


def read_archive(stream) -> Iterator[bytes]:
    """The records of an archive: the dictionary first, then a frame at a time."""
    data = stream.read(CHUNK)
    options = {}
    if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", data[4:8])[0]
        while len(data) < 8 + size:
            if not (more := stream.read(CHUNK)):
                raise WarcError("the archive ends within its dictionary")
            data += more
        options["dict_data"] = zstandard.ZstdCompressionDict(bytes(data[8 : 8 + size]))
        data = data[8 + size :]
    context = zstandard.ZstdDecompressor(**options)
    while data or (data := stream.read(CHUNK)):
        frame, parts = context.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            if not (data := stream.read(CHUNK)):
                raise WarcError("the archive ends within a record")
        yield b"".join(parts)


def make_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on the samples; the samples themselves if there are too few for that.

    It is never empty, and as text it never begins like a trained one.
    """
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        form = f"{VERSION}\r\n\r\n{HTTP_STATUS}\r\n\r\n".encode()
        return form + b"".join(samples)[: DICTIONARY_BYTES - len(form)]


def _writer(folder: str, dictionary: bytes, archive_bytes: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        context = TaskContext.get()
        # A task that runs again writes other files; only a finished one's are listed.
        stem = f"{root}/{context.partitionId():06d}-{context.taskAttemptId():08d}-{uuid.uuid4().hex[:8]}"
        options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        compressor = zstandard.ZstdCompressor(level=LEVEL, **options)
        done, stream, path, size, records = [], None, "", 0, 0

        def close() -> None:
            stream.close()
            done.append((path.removeprefix(root), records))

        for batch in batches:
            some_rows = zip(*(few(column) for column in batch.columns), strict=True)
            for row in (row for some in some_rows for row in zip(*some, strict=True)):
                page_id, url, payload, sha1, owner = row
                if stream is None:
                    path, size, records = f"{stem}-{len(done):05d}.warc.zst", 0, 0
                    stream = store.open_output_stream(path, compression=None)
                    if dictionary:
                        stream.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                place = f":{path.removeprefix(root)}:{records}"
                frame = compressor.compress(record(page_id, url, payload, sha1, owner, place))
                stream.write(frame)
                size, records = size + len(frame), records + 1
                if size >= archive_bytes:
                    close()
                    stream = None
        if stream is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array([folder + name for name, _ in done]), pa.array([n for _, n in done], pa.int64())],
                names=["path", "records"],
            )

    return write


def write_archives(
    pages: DataFrame, folder: str, *, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Writes a record for each row of `pages` below `folder`; `(path, records)` of the archives.

    A record's payload is the `html` in UTF-8. Of equal payloads of at least
    `LEAST_REVISIT_BYTES` that with the largest `page_id` is a response and the
    others revisit it; shorter ones are all responses. Equality is by SHA-1.
    The table of repeated digests is written first. While Spark broadcasts one of
    its size, pages stay in the tasks that read them and only digests are
    shuffled; beyond, payloads are shuffled once, and a digest however frequent
    is split by adaptive execution.

    Cases. NULL html is an empty payload; NULL urls have no header, and control
    characters in one are escaped. A NULL `page_id` stays NULL, and is a
    response only if no row of that payload has an id. Rows of the same id and
    payload are all responses or all revisits, and such responses share their
    record's id; revisits each have one of their own. A very long page is one
    record, held whole by the task that writes it. Empty tables write no archive.
    Further columns are not read.
    """
    spark = pages.sparkSession
    key = F.xxhash64("page_id")
    sample = (
        pages.where(in_share(key, SAMPLE_ROWS, pages.count()))
        .select(F.substring("html", 1, SAMPLE_CHARS).alias("h"), key.alias("k"))
        .where("h <> ''")
        .orderBy("k", "h")
        .limit(SAMPLE_ROWS)
    )
    dictionary = make_dictionary([r.h.encode() for r in sample.collect()])
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    read = pages.select(
        F.col("page_id").cast("long"), "url", payload.alias("payload"), F.sha1(payload).alias("digest")
    )
    # Stored, so that its size is known before the join is planned.
    repeated = stash(
        read.where(F.octet_length("payload") >= LEAST_REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND owner IS NOT NULL")
        .select("digest", "owner")
    )
    owned = lookup(read, repeated, "digest").select(
        "page_id", "url", "payload", F.unhex("digest").alias("sha1"),
        F.expr("CASE WHEN page_id IS NULL OR page_id <> owner THEN owner END").alias("owner"),
    )
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    listed = owned.mapInArrow(_writer(folder, dictionary, archive_bytes), "path string, records long")
    return stash(listed)


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [part.split()[0] for part in PAGE.split(", ")] + ["payload"]
    last = len(kinds) if with_payload else len(kinds) - 1

    def batch_of(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))[:last]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names[:last]
        )

    for batch in batches:
        for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            store, name = _store(path)
            rows, bulk, count = [], 0, 0
            with store.open_input_stream(name, compression=None) as stream:
                for data in read_archive(stream):
                    try:
                        rows.append(parse(data))
                    except WarcError as error:
                        raise WarcError(f"{path}, record {count}: {error}") from error
                    count, bulk = count + 1, bulk + len(data)
                    if len(rows) >= 5000 or (with_payload and bulk >= 8 * CHUNK):
                        yield batch_of(rows)
                        rows, bulk = [], 0
            if count != expected:
                raise WarcError(f"{path}: {count} records, not {expected}")
            if rows:
                yield batch_of(rows)


def read_archives(archives: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """The records of `(path, records)` archives, read frame by frame and validated.

    A record whose headers, lengths or digest do not hold, and an archive with
    another number of records than stated, stop the job with an error that
    names it. `payload` is NULL for revisits.
    """
    tasks = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _read(batches, with_payload)

    schema = PAGE + (", payload binary" if with_payload else "")
    return archives.select("path", "records").repartition(tasks).mapInArrow(read, schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(table(spark, sf_dir, "pages"), folder)).drop("url")


OP7_SQL = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
),
owners AS (
  SELECT payload_digest, max(page_id) AS owner FROM payloads WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN o.owner <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN o.owner <> p.page_id THEN o.owner END AS refers_to
FROM payloads p LEFT JOIN owners o USING (payload_digest)
"""
