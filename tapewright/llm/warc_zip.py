"""WARC records in ZIP packages, written and range-read without extraction.

A package is a ZIP file whose members are stored as they are: WARC files (each record a gzip
member of its own) and an index of their records. Since stored members are plain byte ranges of
the package, a reader needs the central directory (or its ZIP64 form), the index member, and
then reads any record by its range.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, new_path
from .common import open_folder, shared_file

MIN_REVISIT = 100                 # payload bytes from which on equal payloads are stored once
MEMBER_BYTES = 64 << 20           # of a WARC member
PACKAGE_BYTES = 512 << 20         # of a package
READ_BYTES = 8 << 20              # of neighbouring records that are read at once
INDEX, DATA = "indexes/index.jsonl", "archive/data-{:05d}.warc.gz"

# ---------------------------------------------------------------- records


def digest_of(payload: bytes) -> str:
    return hashlib.sha256(payload).hexdigest()


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool
) -> bytes:
    """A response with the payload, or a revisit without it; HTTP headers tell its full length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {uri}"] if uri else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(data: bytes) -> tuple[dict[str, str], int]:
    """Fields of a header block (names in lower case), and where it ends."""
    end = data.index(b"\r\n\r\n")
    fields = {}
    for line in data[:end].decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, end + 4


@dataclass(frozen=True)
class Record:
    page_id: int | None
    url: str | None
    record_type: str
    payload: bytes | None      # None for a revisit
    payload_bytes: int
    payload_digest: str
    refers_to: int | None


def parse_record(data: bytes) -> Record:
    """A record as it was read. The digest of a response is that of the payload that came."""
    fields, at = headers(data)
    block = data[at : at + int(fields["content-length"])]
    http, body = headers(block)
    page = lambda name: (m := re.search(r"urn:page:(-?\d+)", fields.get(name, ""))) and int(m[1])
    stated = fields["warc-payload-digest"].removeprefix("sha256:")
    payload = None if fields["warc-type"] == "revisit" else block[body:]
    if payload is not None and (len(payload) != int(http["content-length"]) or digest_of(payload) != stated):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    return Record(
        page("warc-record-id"),
        fields.get("warc-target-uri"),
        fields["warc-type"],
        payload,
        int(http["content-length"]),
        stated,
        page("warc-refers-to"),
    )


# ---------------------------------------------------------------- writing


class Package:
    """One ZIP package that is written front to back, as object stores need it."""

    def __init__(self, folder: str):
        system, path, self.uri = shared_file(folder, "package")
        self.out = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.index: list[str] = []
        self.members, self.member, self.size, self.total = 0, None, 0, 0

    def add(self, data: bytes, **entry) -> None:
        if self.member is None or self.size >= MEMBER_BYTES:
            if self.member is not None:
                self.member.close()
            self.name = DATA.format(self.members)
            info = zipfile.ZipInfo(self.name)
            self.member = self.zip.open(info, "w", force_zip64=True)
            self.members, self.size = self.members + 1, 0
        packer = zlib.compressobj(1, wbits=31)
        packed = packer.compress(data) + packer.flush()
        self.member.write(packed)
        self.index.append(
            json.dumps({"member": self.name, "offset": self.size, "length": len(packed)} | entry)
        )
        self.size += len(packed)
        self.total += len(packed)

    def close(self) -> str:
        if self.member is not None:
            self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
        self.zip.close()
        self.out.close()
        return self.uri


def first_pages(pages: DataFrame, min_revisit: int) -> DataFrame:
    """Payload digests that several pages share, each with the smallest page id among them.

    Counted with map-side combining, so that a payload a third of all pages have costs one row
    per task; only shared payloads make a row.
    """
    return (
        pages.where(F.col("_bytes") >= min_revisit)
        .groupBy("_digest")
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select("_digest", "_first")
    )


def write_packages(pages: DataFrame, folder: str, *, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes one record per row of ``pages`` (``page_id, url, html``); returns the packages.

    The result is a stored table of package URIs, ``path``. Each task writes packages of its own
    in the shared ``folder``; a repeated attempt writes others, and the table names those of the
    attempt that counted.

    Of equal payloads (UTF-8 of ``html``; null: empty) of at least ``min_revisit`` bytes the one
    with the smallest page id is a response and the others are revisits of it. Repeated rows of
    that page are responses too. A null page id is larger than any other, and among null ids
    alone all are responses. A null url is left out of its record; control characters and spaces
    in urls are percent-encoded. Other columns are not read. No pages, no packages.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("_payload")
    ).withColumns({"_digest": F.sha2("_payload", 256), "_bytes": F.length("_payload")})
    # Stored, so that the join knows its true size.
    first = materialize(first_pages(rows.drop("_payload", "url"), min_revisit), "payloads")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    marked = rows.join(first, "_digest", "left").select(
        "page_id", "url", "_payload", "_digest", F.when(revisit, F.col("_first")).alias("_first")
    )

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, paths = None, []
        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for values in zip(*columns, strict=True):
                page_id, url, data, digest, refers_to = (v.as_py() for v in values)
                package = package or Package(folder)
                record = record_bytes(page_id, url, data, digest, refers_to, refers_to is not None)
                package.add(record, page=page_id, digest=digest)
                if package.total >= PACKAGE_BYTES:
                    paths.append(package.close())
                    package = None
        if package:
            paths.append(package.close())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return materialize(marked.mapInArrow(write, "path string"), "packages")


# ---------------------------------------------------------------- reading

_END, _END64, _LOCATOR, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int   # offset of the local header


def read_range(source: pa.NativeFile, offset: int, length: int) -> bytes:
    source.seek(offset)
    return source.read(length)


def central_directory(source: pa.NativeFile) -> list[Member]:
    """Members of a package, from the directory at its end (ZIP or ZIP64)."""
    size = source.size()
    tail_at = max(0, size - 65_557)  # the end record and the longest comment
    tail = read_range(source, tail_at, size - tail_at)
    end = tail.rfind(_END)
    while end >= 0 and not _is_end(tail, end, tail_at + end):
        end = tail.rfind(_END, 0, end)
    if end < 0:
        raise ValueError("no ZIP end record")
    count, length, offset = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or 0xFFFFFFFF in (length, offset):
        locator = read_range(source, tail_at + end - 20, 20)
        if locator[:4] != _LOCATOR:
            raise ValueError("no ZIP64 locator")
        record = read_range(source, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != _END64:
            raise ValueError("no ZIP64 end record")
        count, length, offset = struct.unpack_from("<QQQ", record, 32)
    data, at, members = read_range(source, offset, length), 0, []
    for _ in range(count):
        if data[at : at + 4] != _ENTRY:
            raise ValueError("damaged ZIP directory")
        (method,) = struct.unpack_from("<H", data, at + 10)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, at + 20)
        (header,) = struct.unpack_from("<I", data, at + 42)
        name = data[at + 46 : at + 46 + n_name].decode()
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        packed, header = _zip64(extra, plain, packed, header)
        members.append(Member(name, method, packed, header))
        at += 46 + n_name + n_extra + n_comment
    return members


def _is_end(tail: bytes, end: int, at: int) -> bool:
    """Is this signature (``at`` in the file) the end record, and not part of its comment? The
    comment ends with the file, and the directory ends where the record starts (ZIP64 says so
    elsewhere)."""
    if len(tail) < end + 22:
        return False
    length, offset, comment = struct.unpack_from("<IIH", tail, end + 12)
    return end + 22 + comment == len(tail) and (0xFFFFFFFF in (length, offset) or offset + length <= at and (
        offset + length == at or tail[end - 20 : end - 16] == _LOCATOR
    ))


def _zip64(extra: bytes, plain: int, packed: int, header: int) -> tuple[int, int]:
    """Packed size and header offset; the ZIP64 field has those that did not fit, in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            if plain == 0xFFFFFFFF:
                next(values)
            packed = next(values) if packed == 0xFFFFFFFF else packed
            header = next(values) if header == 0xFFFFFFFF else header
        at += 4 + n
    return packed, header


def data_offset(source: pa.NativeFile, member: Member) -> int:
    """Where a stored member's bytes start: after the name and extra of its local header."""
    if member.method != zipfile.ZIP_STORED:
        raise ValueError(f"{member.name} is packed; only stored members can be range-read")
    local = read_range(source, member.header, 30)
    if local[:4] != _LOCAL:
        raise ValueError("damaged ZIP header")
    return member.header + 30 + sum(struct.unpack_from("<HH", local, 26))


def open_package(path: str) -> pa.NativeFile:
    system, inner = open_folder(path)
    assert isinstance(system, pafs.FileSystem)
    return system.open_input_file(inner)


def locate(paths: DataFrame) -> DataFrame:
    """Range of every record in the packages: ``path, offset, length``. Reads directories and
    indexes only."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_package(path) as source:
                    members = {m.name: m for m in central_directory(source)}
                    index = members[INDEX]
                    text = read_range(source, data_offset(source, index), index.size).decode()
                    starts = {n: data_offset(source, m) for n, m in members.items() if n != INDEX}
                entries = [json.loads(x) for x in text.split("\n") if x]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(entries), pa.string()),
                        pa.array([starts[e["member"]] + e["offset"] for e in entries], pa.int64()),
                        pa.array([e["length"] for e in entries], pa.int64()),
                    ],
                    ["path", "offset", "length"],
                )

    return paths.select("path").mapInArrow(find, "path string, offset bigint, length bigint")


RECORD = (
    "page_id bigint, url string, record_type string, payload binary, payload_bytes bigint,"
    " payload_digest string, refers_to bigint"
)


def read_records(ranges: DataFrame, *, with_payload: bool = True, read_bytes: int = READ_BYTES) -> DataFrame:
    """The records at ``ranges``. Neighbours within ``read_bytes`` are read in one go, by one task,
    so a large package is read by many tasks: as many as the bytes of all ranges ask for."""
    names = [x.split()[0] for x in RECORD.split(", ")]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, pa.NativeFile] | None = None
        for batch in batches:
            path_of, offset_of, length_of = (batch.column(i).to_pylist() for i in range(3))
            at = 0
            while at < len(path_of):
                end, last = at, offset_of[at]
                while (
                    end < len(path_of)
                    and path_of[end] == path_of[at]
                    and offset_of[end] <= last + 4096
                    and (end == at or offset_of[end] + length_of[end] - offset_of[at] <= read_bytes)
                ):
                    last = offset_of[end] + length_of[end]
                    end += 1
                if opened is None or opened[0] != path_of[at]:
                    if opened:
                        opened[1].close()
                    opened = (path_of[at], open_package(path_of[at]))
                data = memoryview(read_range(opened[1], offset_of[at], last - offset_of[at]))
                found = []
                for i in range(at, end):
                    a = offset_of[i] - offset_of[at]
                    found.append(parse_record(zlib.decompress(data[a : a + length_of[i]], wbits=31)))
                yield _records(found, names, with_payload)
                at = end
        if opened:
            opened[1].close()

    # A range is a narrow row, so the number of tasks is given by the bytes behind the rows; left
    # open, it would follow the size of the rows.
    ranges = materialize(ranges, "ranges")
    total = ranges.agg(F.sum("length")).first()[0] or 0
    near = F.floor(F.col("offset") / read_bytes)
    return (
        ranges.repartition(-(-total // read_bytes) or 1, "path", near)
        .sortWithinPartitions("path", "offset")
        .select("path", "offset", "length")
        .mapInArrow(read, RECORD)
    )


def _records(found: list[Record], names: list[str], with_payload: bool) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    columns = [
        [getattr(r, n) if n != "payload" or with_payload else None for r in found] for n in names
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names
    )


def round_trip(pages: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """Writes ``pages`` to packages in the shared folder and reads every record back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_records(locate(write_packages(pages, folder)), with_payload=with_payload)
