"""WARC archives: segmented records written through Spark, read back and reassembled.

A payload is sent with chunked transfer framing inside an HTTP message; a block longer than
``segment_bytes`` is split into a first record and continuation records that name it as their
origin. Reading goes by Content-Length alone, so payloads may hold any bytes, also record
marks. Files are written and read by Spark's own sources, so any file system will do.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatflow.session import fresh_path

VERSION = b"WARC/1.1"
CRLF = b"\r\n"
#: Ends every record; Spark's text sink writes it after each row.
RECORD_END = "\r\n\r\n"
#: One date for all records keeps reruns equal byte by byte.
DATE = b"2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
CHUNK_BYTES = 4096
SEGMENT_BYTES = 8192
#: Rows of a file at most; a file also ends with its task's partition.
FILE_ROWS = 4096

PARTS = "uri string, record_type string, digest string, refers_to string, origin string, number long, total long, block binary"
PAGES = (
    "uri string, payload binary, payload_bytes long, payload_digest string, record_type string,"
    " refers_to string, digest_ok boolean"
)


class BrokenArchive(ValueError):
    """An archive that does not hold what its headers promise."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes) -> bytes:
    """Chunked transfer framing: sizes in hex, an empty chunk at the end."""
    cuts = (payload[i : i + CHUNK_BYTES] for i in range(0, len(payload), CHUNK_BYTES))
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in cuts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """The payload of chunked framing; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = framed.find(CRLF, at)
        try:
            size = int(framed[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0:
            raise BrokenArchive("a chunk has no size")
        if size == 0:
            return b"".join(out)
        chunk = framed[end + 2 : end + 2 + size]
        if len(chunk) < size or framed[end + 2 + size : end + 4 + size] != CRLF:
            raise BrokenArchive("a chunk is cut off")
        out.append(chunk)
        at = end + 4 + size


def _record(headers: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    headers = [*headers, (b"WARC-Date", DATE), (b"Content-Length", b"%d" % len(block))]
    return CRLF.join([VERSION, *(b"%b: %b" % h for h in headers), b"", block])


def _records(name: bytes, uri: bytes, payload: bytes, refers_to: str | None, segment_bytes: int) -> Iterator[bytes]:
    base = [
        (b"WARC-Record-ID", b"<urn:x-record:%b>" % name),
        (b"WARC-Target-URI", uri),
        (b"WARC-Payload-Digest", b"sha1:" + base32_sha1(payload).encode()),
    ]
    if refers_to is not None:
        head = HTTP_HEAD.replace(b"Transfer-Encoding: chunked\r\n", b"")
        yield _record([(b"WARC-Type", b"revisit"), *base, (b"WARC-Refers-To-Target-URI", refers_to.encode())], head)
        return
    block = HTTP_HEAD + chunked(payload)
    if len(block) <= segment_bytes:
        yield _record([(b"WARC-Type", b"response"), *base], block)
        return
    cuts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for number, cut in enumerate(cuts, 1):
        place = [(b"WARC-Segment-Number", b"%d" % number)]
        if number == len(cuts):
            place.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        if number == 1:
            yield _record([(b"WARC-Type", b"response"), *base, *place], cut)
        else:
            own = [
                (b"WARC-Type", b"continuation"),
                (b"WARC-Record-ID", b"<urn:x-record:%b:%d>" % (name, number)),
                (b"WARC-Target-URI", uri),
                (b"WARC-Segment-Origin-ID", b"<urn:x-record:%b>" % name),
            ]
            yield _record([*own, *place], cut)


def _write(segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[bytes] = []
            held = 0
            for uri, payload, winner in zip(*(batch.column(i) for i in range(3)), strict=True):
                name, n = b"%d-%d" % (part, n), n + 1
                for record in _records(name, uri.as_py().encode(), payload.as_py(), winner.as_py(), segment_bytes):
                    out.append(record)
                    held += len(record)
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return run


def write_archives(
    records: DataFrame, path: str, least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, order: str = "uri"
) -> None:
    """Write ``uri string, payload binary`` (and the ``order`` column) as gzipped archives.

    Of the records with equal payloads of ``least_bytes`` or more, the first by ``order`` is a
    response and the others are revisits of it; shorter ones are all responses. Equal means
    equal SHA-256 and length. A null payload is empty; ``uri`` must not be null, and rows that
    repeat the response's uri are responses too. Record ids are made by the writing task, so
    they are unique whatever the rows. Only digests are grouped, and the join that hands each record its
    response leaves a hot payload to the adaptive skew split.
    """
    records = records.select("uri", F.coalesce("payload", F.lit(b"")).alias("payload"), F.col(order).alias("place"))
    same = F.concat_ws(":", F.sha2("payload", 256), F.length("payload"))
    long_enough = F.length("payload") >= least_bytes
    keyed = records.withColumn("same", F.when(long_enough, same).otherwise(F.concat(F.lit("uri:"), "uri")))
    last = F.struct(F.col("place").isNull(), "place")
    first = keyed.groupBy("same").agg(F.min_by("uri", last).alias("winner"))
    joined = keyed.join(first, "same").select(
        "uri", "payload", F.when(F.col("winner") != F.col("uri"), F.col("winner")).alias("winner")
    )
    (
        joined.mapInArrow(_write(segment_bytes), "record binary")
        .select(F.col("record").cast("string"))
        .write.option("lineSep", RECORD_END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", FILE_ROWS)
        .text(path)
    )


class _Stream:
    """Bytes of a possibly gzipped file, inflated as they are asked for."""

    def __init__(self, data: bytes, piece: int = 1 << 20) -> None:
        self.data, self.piece, self.at, self.buffer, self.start = data, piece, 0, b"", 0
        self.inflate = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        cut = self.data[self.at : self.at + self.piece]
        self.at += len(cut)
        if self.inflate is not None:
            raw = self.inflate.decompress(cut)
            while self.inflate.eof and self.inflate.unused_data:  # a further gzip member
                cut = self.inflate.unused_data
                self.inflate = zlib.decompressobj(31)
                raw += self.inflate.decompress(cut)
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            cut = raw
        self.buffer, self.start = self.buffer[self.start :] + cut, 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and without ``mark``; None at the end of the file."""
        while (end := self.buffer.find(mark, self.start)) < 0:
            if not self._more():
                if self.buffer[self.start :].strip():
                    raise BrokenArchive("a header is cut off")
                return None
        out = self.buffer[self.start : end]
        self.start = end + len(mark)
        return out

    def take(self, size: int) -> bytes:
        while len(self.buffer) - self.start < size:
            if not self._more():
                raise BrokenArchive("a record is cut off")
        out = self.buffer[self.start : self.start + size]
        self.start += size
        return out


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive file."""
    stream = _Stream(data)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        version, *lines = head.lstrip(b"\r\n").split(CRLF)
        if not version.startswith(b"WARC/"):
            raise BrokenArchive("a record has no version line")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}
        block = stream.take(int(headers["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise BrokenArchive("a record is longer than it says")
        yield headers, block


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of segmented records."""
    names = [c.split()[0] for c in PARTS.split(",")]
    kinds = [pa.string()] * 5 + [pa.int64()] * 2 + [pa.binary()]
    for rows in _batched(batches, segmented=True):
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names
        )


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of the records that are not segmented."""
    for rows in _batched(batches, segmented=False):
        yield _pages([_page(*row[:4], row[7]) for row in rows])


def _batched(batches: Iterator[pa.RecordBatch], segmented: bool) -> Iterator[list[tuple]]:
    """Record rows, as in PARTS, a few MB at a time."""
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for data in batch.column(0):
            for h, block in records_of(data.as_py()):
                number = h.get("warc-segment-number")
                if (number is not None) != segmented:
                    continue
                origin = h.get("warc-segment-origin-id") or h["warc-record-id"]
                digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
                total = int(h.get("warc-segment-total-length", -1))
                uri, refers = h.get("warc-target-uri"), h.get("warc-refers-to-target-uri")
                rows.append((uri, h["warc-type"], digest, refers, origin, int(number or 0), total, block))
                held += len(block)
                if held > 4_000_000:
                    yield rows
                    rows, held = [], 0
    if rows:
        yield rows


def _page(uri: str, kind: str, digest: str, refers: str | None, block: bytes) -> tuple:
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        raise BrokenArchive(f"{uri} has no HTTP head")
    if kind == "revisit":
        return uri, None, None, digest, kind, refers, None
    payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    found = base32_sha1(payload)
    return uri, payload, len(payload), found, kind, None, found == digest


def _pages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
    names = [c.split()[0] for c in PAGES.split(",")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of segmented records, whose parts come sorted by origin and number."""
    held: list[tuple] = []

    def close() -> tuple:
        uri, kind, digest, refers, origin, *_ = held[0]
        if [x[5] for x in held] != list(range(1, len(held) + 1)):
            raise BrokenArchive(f"{origin} lacks or repeats a segment")
        if kind == "continuation" or held[-1][6] < 0:
            raise BrokenArchive(f"{origin} lacks its first or last segment")
        block = b"".join(x[7] for x in held)
        if len(block) != held[-1][6]:
            raise BrokenArchive(f"{origin} has {len(block)} bytes, not {held[-1][6]}")
        return _page(uri, kind, digest, refers, block)

    for batch in batches:
        done = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][4] != row[4]:
                done.append(close())
                held = []
            held.append(row)
        yield _pages(done)
    if held:
        yield _pages([close()])


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of the archives (a frame with their bytes as ``content``).

    Segments are grouped by the record they continue, ordered by number, checked against the
    total length and joined; only segments are shuffled, records in one piece are not. The
    chunked framing is decoded and the payload held against its digest (``digest_ok``).
    Revisits have no payload of their own: payload, payload_bytes and digest_ok are null, the
    digest is that of the header. Missing, repeated or cut segments, chunks or records raise
    ``BrokenArchive``; no archives or empty ones give no rows.
    """
    content = archives.select("content")
    whole = content.mapInArrow(_whole, PAGES)
    split = content.mapInArrow(_segments, PARTS)
    split = split.repartition("origin").sortWithinPartitions("origin", "number")
    return whole.unionByName(split.mapInArrow(_joined, PAGES))


def archive_pages(pages: DataFrame, least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Archive ``page_id, html`` and read the archives back: one row per page.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, digest_ok, the
    first two of the full payload also for revisits (theirs come from the response). A null
    html is an empty payload. Each row is a record of its own, also when rows repeat; rows
    that repeat the response's page_id and html are responses like it. A null page_id sorts
    last and is read back as null. A very long html is archived in segments and put together
    again, whole in one task. No pages give no rows; other columns are not looked at.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    uri = F.concat(F.lit("page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    records = pages.select(uri.alias("uri"), F.encode("html", "utf-8").alias("payload"), "page_id")
    write_archives(records, path, least_bytes, segment_bytes, order="page_id")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    found = read_archives(files).drop("payload")
    sizes = (
        found.where("record_type = 'response'")
        .groupBy(F.col("uri").alias("response"), F.col("payload_digest").alias("digest"))
        .agg(F.max("payload_bytes").alias("response_bytes"))
    )
    number = lambda c: F.expr(f"try_cast(substring({c}, 6) as bigint)")
    own = (found["refers_to"] == sizes["response"]) & (found["payload_digest"] == sizes["digest"])
    return found.join(sizes, own, "left").select(
        number("uri").alias("page_id"),
        F.coalesce("payload_bytes", "response_bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
        "digest_ok",
    )
