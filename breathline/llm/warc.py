"""WARC archives: writing with revisit records, an index, and coalesced byte-range reads.

Every record is a gzip member of its own, so it can be read by offset and length.
Executors write and read the archives through pyarrow's file systems (local paths,
HDFS, S3, GCS by the scheme of the folder), so no driver or executor needs a shared mount.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breathline.llm.skew import lookup
from breathline.llm.storage import materialise

#: An archive is closed when it has grown past this size (compressed).
ARCHIVE_BYTES = 64 << 20
#: Ranges are joined when fewer bytes lie between them, up to RANGE_BYTES together.
MAX_GAP = 64 << 10
RANGE_BYTES = 4 << 20
DATE = "1970-01-01T00:00:00Z"

_INDEX = "path string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long, payload_bytes long"
_RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, keeper: int | None) -> bytes:
    revisit = keeper is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=chr(37) + ':/?#[]@!$&()*+,;=~-._' + chr(39))}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{keeper}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Archive:
    """One archive file; its name is unique to the task attempt, so a retried task cannot clash."""

    def __init__(self, folder: str):
        self.store, base = fs.FileSystem.from_uri(folder)
        self.store.create_dir(base, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.gz"
        self.stream, self.size = self.store.open_output_stream(f"{base}/{self.name}", compression=None), 0
        self.add(_gzip(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:" + str(uuid.uuid4()).encode() + b">\r\nWARC-Date: " + DATE.encode() + b"\r\nContent-Length: 0\r\n\r\n\r\n\r\n"))

    def add(self, member: bytes) -> tuple[int, int]:
        at = self.size
        self.stream.write(member)
        self.size += len(member)
        return at, len(member)


def _writer(folder: str):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        try:
            for batch in batches:
                index = []
                for page_id, url, html, keeper in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "keeper")), strict=True):
                    if archive is None:
                        archive = _Archive(folder)
                    payload = (html or "").encode()
                    digest = bare_digest(payload)
                    refers = None if keeper is None or keeper == page_id else keeper
                    at, length = archive.add(_gzip(_record(page_id, url, payload, digest, refers)))
                    index.append((f"{folder}/{archive.name}", at, length, url, digest, page_id, "response" if refers is None else "revisit", refers, len(payload)))
                    if archive.size >= ARCHIVE_BYTES:
                        archive.stream.close()
                        archive = None
                if index:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "offset", "length", "url", "digest", "page_id", "record_type", "refers_to", "payload_bytes"])
        finally:
            if archive is not None:
                archive.stream.close()

    return write


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) and return the index.

    The payload is the html in UTF-8; a null html is an empty payload. Of rows with
    equal payloads of at least ``min_revisit_bytes`` bytes the one with the largest
    page_id becomes the response and the others revisit it; smaller payloads are all
    responses. Equality is by SHA-256 and length.

    Index: path, offset, length, url, digest, page_id, record_type, refers_to,
    payload_bytes. The index is the list of valid records: archives left by a failed
    task attempt are in no index row. Defined cases: a null url gives a record without
    target URI; rows with a null page_id are written too, as responses unless another
    row has the same payload and a page_id; rows repeated under the keeper's page_id
    are all responses; an empty table gives an empty index; other columns are ignored.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.when(F.octet_length(body) >= min_revisit_bytes, F.unhex(F.sha2(body, 256))).alias("hash"))
    total = rows.count()
    groups = materialise(rows.filter("hash is not null").groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("keeper")).filter("n > 1"), "payloads")
    planned = lookup(rows, groups, "hash", "n", total, how="left")
    index = planned.select("page_id", "url", "html", "keeper").mapInArrow(_writer(folder), _INDEX)
    return materialise(index, "index")


def _parse(member: bytes) -> tuple[dict[str, str], bytes]:
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _reader(with_payload: bool):
    def emit(rows: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, end, parts in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "end", "parts")), strict=True):
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as file:
                    data = file.read_at(end - first, first)
                rows = []
                for part in parts:
                    at = part["offset"] - first
                    fields, body = _parse(data[at : at + part["length"]])
                    kind = fields["WARC-Type"]
                    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Payload-Length"])
                    if kind == "response" and (bare_digest(body) != digest or len(body) != size):
                        raise ValueError(f"damaged record at {path}:{part['offset']}")
                    rows.append((_page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, _page(fields.get("WARC-Refers-To")), digest, size, body if with_payload and kind == "response" else None))
                yield emit(rows)

    return read


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that the rows of ``index`` name, read in few large ranges.

    Per archive the selected records are sorted by offset; neighbours less than
    MAX_GAP bytes apart are read together, in ranges of about RANGE_BYTES. A response
    whose bytes don't match its digest raises ValueError. Index rows repeated for one
    record are read once.
    """
    parts = index.select("path", "offset", "length").distinct()
    order = Window.partitionBy("path").orderBy("offset")
    before = F.lag(F.col("offset") + F.col("length")).over(order)
    block = F.floor(F.col("offset") / RANGE_BYTES)
    starts = before.isNull() | (F.col("offset") - before > MAX_GAP) | (F.lag(block).over(order) != block)
    ranged = parts.withColumn("fresh", starts).withColumn("range", F.sum(F.col("fresh").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = ranged.groupBy("path", "range").agg(F.min("offset").alias("first"), F.max(F.col("offset") + F.col("length")).alias("end"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("parts"))
    return ranges.select("path", "first", "end", "parts").mapInArrow(_reader(with_payload), _RECORDS)
