"""WARC records in ZIP packages: written by tasks, read back by byte ranges.

A package holds `archive/data.warc.gz` (one gzip member per record) and
`indexes/index.jsonl` (page id, offset and length of each record), both stored without
ZIP compression.  The reader parses the end record, the ZIP64 locator and end record and
the central directory, finds the stored members' data, and fetches single records by
their ranges; nothing is extracted.

Of records with equal payloads of `revisit_from` bytes or more, that with the smallest
page id is a response; the others are revisits, which have headers only and name the
response.

Tasks write packages under names of their own attempt, and a stored list names those of
the attempts that succeeded, so repeated or lost tasks leave no trace in the result.

Defined cases: a null html is the empty payload; a null page id counts as larger than
all others; rows that repeat page id and payload are all of the same type; without rows
no package is written and the result is empty.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageworks.llm.columns import picked, whole
from passageworks.llm.files import Ranges, opened
from passageworks.session import ship_package, stored, work_path

MEMBER, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: Bytes of records after which a task begins a new package.
PACKAGE_BYTES = 64 << 20
#: Bytes of neighbouring records that are read at once.
READ_BYTES = 4 << 20
PACKAGES = "uri string, records long"
RANGES = "uri string, start long, lengths array<int>, ids array<long>"
RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, html string"
)


def typed(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Pages with `refers_to`: the smallest page id of an equal payload, else null."""
    payload = F.encode(whole(F.col("html")), "utf-8")
    digested = pages.select(
        "page_id", "url", "html", F.sha1(payload).alias("digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
    )
    firsts = (
        digested.where(F.col("payload_bytes") >= revisit_from)
        .groupBy("digest").agg(F.min("page_id").alias("first_id"))
    )
    refers = F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))
    return digested.join(firsts, "digest", "left").select(
        "page_id", "url", "html", "digest", refers.alias("refers_to")
    )


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head only."""
    name = base64.b32encode(bytes.fromhex(digest)).decode()
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    kind = "response" if refers is None else "revisit"
    body = head + (payload if refers is None else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{name}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {json.dumps(url)[1:-1]}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"X-Refers-To-Page-ID: {refers}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of RECORDS from one record; checks a response's digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    http_fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    url, page, refers = (fields.get(k) for k in ("WARC-Target-URI", "X-Page-ID", "X-Refers-To-Page-ID"))
    return {
        "page_id": None if page is None else int(page),
        "url": None if url is None else json.loads(f'"{url}"'),
        "payload_bytes": int(http_fields["Content-Length"]), "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": None if refers is None else int(refers),
        "html": payload.decode() if response else None,
    }


def _writer(folder: str, package_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        system.create_dir(root, recursive=True)

        def rows():
            for batch in batches:
                for row in batch.to_pylist():
                    yield row

        source = rows()
        row = next(source, None)
        while row is not None:
            name = f"{uuid.uuid4().hex}.wacz"
            lines, at = [], 0
            with system.open_output_stream(f"{root}/{name}") as out, zipfile.ZipFile(out, "w") as package:
                with package.open(zipfile.ZipInfo(MEMBER), "w", force_zip64=True) as member:
                    while row is not None and at < package_bytes:
                        payload = (row["html"] or "").encode()
                        packed = gzip.compress(
                            record(row["page_id"], row["url"], payload, row["digest"], row["refers_to"]), 4, mtime=0
                        )
                        member.write(packed)
                        lines.append(json.dumps({"page": row["page_id"], "offset": at, "length": len(packed)}))
                        at += len(packed)
                        row = next(source, None)
                with package.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
                    index.write("\n".join(lines).encode())
            yield pa.RecordBatch.from_pydict(
                {"uri": [f"{folder}/{name}"], "records": pa.array([len(lines)], pa.int64())}
            )

    return write


def write_packages(
    pages: DataFrame, folder: str, *, revisit_from: int = 0, package_bytes: int = PACKAGE_BYTES
) -> DataFrame:
    """Write (page_id, url, html) rows under `folder`; the stored list of packages."""
    ship_package(pages.sparkSession)
    written = typed(pages, revisit_from).mapInArrow(_writer(folder, package_bytes), PACKAGES)
    return stored(written, "packages")


def directory(file: Ranges) -> dict[str, tuple[int, int, int]]:
    """Members of a ZIP file: name -> (local header's place, size, method).

    Reads the end record, where needed the ZIP64 locator and end record, and the
    central directory with its ZIP64 extra fields.
    """
    tail_size = min(file.size, 22 + 0xFFFF)
    tail = file.read(file.size - tail_size, tail_size)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    entries, size, start = struct.unpack_from("<HII", tail, end + 10)
    place = file.size - tail_size + end
    if 0xFFFF == entries or 0xFFFFFFFF in (size, start):
        locator = file.read(place - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        (end64,) = struct.unpack_from("<Q", locator, 8)
        entries, size, start = struct.unpack_from("<QQQ", file.read(end64, 56), 32)
    central, at, found = file.read(start, size), 0, {}
    for _ in range(entries):
        if central[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", central, at + 10)
        packed, full = struct.unpack_from("<II", central, at + 20)
        n_name, n_extra, n_note = struct.unpack_from("<HHH", central, at + 28)
        local, = struct.unpack_from("<I", central, at + 42)
        name = central[at + 46 : at + 46 + n_name].decode()
        extra, e = central[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, e)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            e += 4 + n
        found[name] = (local, packed, method)
        at += 46 + n_name + n_extra + n_note
    return found


def stored_member(file: Ranges, entry: tuple[int, int, int]) -> tuple[int, int]:
    """Start and size of a stored member's data."""
    local, size, method = entry
    if method != 0:
        raise ValueError("the member is compressed, ranges can't be read")
    head = file.read(local, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return local + 30 + n_name + n_extra, size


def _index(read_bytes: int):
    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                file = Ranges(uri)
                members = directory(file)
                data, _ = stored_member(file, members[MEMBER])
                entries = [json.loads(x) for x in file.read(*stored_member(file, members[INDEX])).splitlines()]
                file.close()
                out, held = [], 0
                for e in entries:
                    if not out or held >= read_bytes:
                        out.append({"uri": uri, "start": data + e["offset"], "lengths": [], "ids": []})
                        held = 0
                    out[-1]["lengths"].append(e["length"])
                    out[-1]["ids"].append(e["page"])
                    held += e["length"]
                yield pa.RecordBatch.from_pylist(out, RANGE_SCHEMA)

    return ranges


RANGE_SCHEMA = pa.schema(
    [("uri", pa.string()), ("start", pa.int64()), ("lengths", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))]
)
RECORD_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string()),
    ]
)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.to_pylist():
            file = Ranges(block["uri"])
            data = file.read(block["start"], sum(block["lengths"]))
            file.close()
            out, at = [], 0
            for length, page in zip(block["lengths"], block["ids"]):
                out.append(parse(zlib.decompress(data[at : at + length], 31)))
                at += length
                if out[-1]["page_id"] != page:
                    raise ValueError(f"the index names page {page}, the record {out[-1]['page_id']}")
            yield pa.RecordBatch.from_pylist(out, RECORD_SCHEMA)


def read_packages(packages: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """All records of the packages in column `uri`: the fields of RECORDS.

    A revisit's html is null.  Packages are opened in parallel for their directories
    and indexes; blocks of neighbouring records are then dealt out anew.
    """
    spark = packages.sparkSession
    ship_package(spark)
    parts = spark.sparkContext.defaultParallelism
    blocks = packages.select("uri").repartition(parts).mapInArrow(_index(read_bytes), RANGES)
    return blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(_records, RECORDS)


def round_trip(pages: DataFrame, *, revisit_from: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write `pages` to packages in the shared folder and read all records back."""
    folder = work_path(pages.sparkSession, "warc")
    own = picked(pages, page_id="page_id", url="url", html="html")
    packages = write_packages(own, folder, revisit_from=revisit_from, package_bytes=package_bytes)
    return read_packages(packages)
