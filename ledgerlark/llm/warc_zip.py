"""WARC archives packed in ZIP files: written by tasks, read by ranges without extraction.

A package is a ZIP file with stored members: ``archive/data.warc.gz`` (one gzip member per record),
``indexes/index.jsonl`` (where each record lies in the archive) and ``datapackage.json``. The reader parses the
end of the file, the ZIP64 records and the central directory, takes the index, and then reads only the bytes of
the records it wants. Packages can lie in any store that Arrow's file systems reach.
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
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import stash
from ledgerlark.session import scratch_dir

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PER_TASK = 64 << 20  # packed bytes that a reading task gets beyond the session's number of partitions
MANIFEST = "package string, records long, bytes long"
ENTRIES = "package string, ordinal long, position long, length long"
RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
)


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


# ---- writing ---------------------------------------------------------------------------------


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, refers_to, revisit): which record each page becomes.

    Of equal payloads of at least ``least`` bytes the smallest page_id is the response and the others revisit
    it; shorter ones are responses. A null payload is empty; a null page_id is larger than all others; repeated
    rows of the smallest page_id are all responses. Payloads are compared by SHA-1 and length. The choice is
    made on narrow rows; payloads move once, dealt by page and not by digest, so copies do not meet in one task.
    """
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"),
        F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("payload"),
    ).withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "__n": F.octet_length("payload")})
    narrow = rows.select("page_id", "digest", "__n").distinct()
    firsts = narrow.groupBy("digest", "__n").agg(F.min("page_id").alias("first"))
    plans = narrow.join(firsts, ["digest", "__n"]).select(
        F.col("page_id").alias("__id"), F.col("digest").alias("__digest"),
        (~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("__n") >= least)).alias("revisit"),
        F.col("first"),
    )
    same = F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))
    return rows.join(plans, same).select(
        "page_id", "url", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "digest",
        F.col("__n").cast("long").alias("n"),
        F.when(F.col("revisit"), F.col("first")).alias("refers_to"), "revisit",
    )


def _line(name: str, value: str) -> bytes:
    safe = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)
    return f"{name}: {safe}\r\n".encode()


def record_bytes(page_id, url, payload: str | None, digest: str, n: int, refers_to, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP head of its page but no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = head if revisit else head + payload.encode()
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = [
        b"WARC/1.1\r\n",
        _line("WARC-Type", "revisit" if revisit else "response"),
        _line("WARC-Record-ID", name(page_id)),
        b"" if url is None else _line("WARC-Target-URI", url),
        _line("WARC-Date", "1970-01-01T00:00:00Z"),
        _line("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
    ]
    if revisit:
        lines += [_line("WARC-Refers-To", name(refers_to)), _line("WARC-Profile", REVISIT_PROFILE)]
    lines += [b"Content-Type: application/http;msgtype=response\r\n", _line("Content-Length", str(len(block))), b"\r\n"]
    return b"".join([*lines, block, b"\r\n\r\n"])


def write_packages(records: DataFrame, folder: str, most_bytes: int = 64 << 20, most_records: int = 20_000) -> DataFrame:
    """Write planned records into ZIP packages under ``folder``; returns the manifest of what was written.

    A task writes one package after the other, each closed at ``most_bytes`` of archive or ``most_records``
    records, and holds one record and one package's index. Package names are new in each attempt, and the
    manifest names those of the attempts that succeeded, so lost executors leave no trace in it.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        rows = (tuple(v.as_py() for v in row) for b in batches for row in zip(*b.columns))
        row = next(rows, None)
        while row is not None:
            name = f"{uuid.uuid4().hex}.zip"
            index, at = [], 0
            with store.open_output_stream(f"{base}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
                with package.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True) as member:
                    while row is not None and at < most_bytes and len(index) < most_records:
                        packed = gzip.compress(record_bytes(*row), 1, mtime=0)
                        member.write(packed)
                        index.append((at, len(packed)))
                        at += len(packed)
                        row = next(rows, None)
                lines = "".join(json.dumps({"offset": o, "length": n}) + "\n" for o, n in index)
                package.writestr(zipfile.ZipInfo(INDEX), lines)
                about = {"profile": "data-package", "resources": [{"path": ARCHIVE, "bytes": at}, {"path": INDEX}]}
                package.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps(about))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name}"]), pa.array([len(index)]), pa.array([at])], names=["package", "records", "bytes"]
            )

    columns = ["page_id", "url", "payload", "digest", "n", "refers_to", "revisit"]
    return stash(records.select(columns).mapInArrow(write, MANIFEST), "packages")


# ---- reading ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    start: int  # of the data in the file
    packed: int
    size: int


#: Fixed values of the ZIP format.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


def zip_members(file) -> dict[str, Member]:
    """Members by name, from the directories alone. ``file`` has ``size()`` and ``read_at(n, offset)``."""
    size = file.size()
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = file.read_at(size - tail_at, tail_at)
    at = tail.rfind(END, 0, max(0, len(tail) - 18))
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(END, 0, at + 3)
    if at < 0:
        raise ValueError("not a ZIP file: no end of central directory")
    count, length, offset = struct.unpack_from("<H I I", tail, at + 10)
    if count == _FULL16 or length == _FULL32 or offset == _FULL32:
        locator = file.read_at(20, tail_at + at - 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("ZIP64 locator is missing")
        record = file.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
        if record[:4] != END64:
            raise ValueError("ZIP64 end record is missing")
        count, length, offset = struct.unpack_from("<Q Q Q", record, 32)
    directory, members, at = file.read_at(length, offset), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("damaged central directory")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        packed, plain = struct.unpack_from("<I I", directory, at + 20)
        n_name, n_extra, n_note = struct.unpack_from("<H H H", directory, at + 28)
        local = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        plain, packed, local = _wide(extra, plain, packed, local)
        head = file.read_at(30, local)
        if head[:4] != LOCAL:
            raise ValueError("damaged local header")
        start = local + 30 + sum(struct.unpack_from("<H H", head, 26))
        members[name] = Member(name, method, start, packed, plain)
        at += 46 + n_name + n_extra + n_note
    return members


def _wide(extra: bytes, *values: int) -> list[int]:
    """Size, packed size and offset, those that are full taken from the ZIP64 extra field in that order."""
    out, at = list(values), 0
    while at + 4 <= len(extra):
        tag, n = struct.unpack_from("<H H", extra, at)
        if tag == 1:
            place = at + 4
            for i, v in enumerate(out):
                if v == _FULL32:
                    out[i] = struct.unpack_from("<Q", extra, place)[0]
                    place += 8
        at += 4 + n
    return out


def read_index(packages: DataFrame) -> DataFrame:
    """(package, ordinal, position, length) of every record, from the packages' directories and indexes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for package in batch.column(0).to_pylist():
                store, path = open_store(package)
                with store.open_input_file(path) as file:
                    members = zip_members(file)
                    archive, index = members[ARCHIVE], members[INDEX]
                    if archive.method != zipfile.ZIP_STORED:
                        raise ValueError(f"{package}: the archive member is compressed and can't be read by ranges")
                    lines = file.read_at(index.packed, index.start)
                if index.method == zipfile.ZIP_DEFLATED:
                    lines = zlib.decompress(lines, -15)
                entries = [json.loads(x) for x in lines.splitlines()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([package] * len(entries), pa.string()),
                        pa.array(range(len(entries)), pa.int64()),
                        pa.array([archive.start + e["offset"] for e in entries], pa.int64()),
                        pa.array([e["length"] for e in entries], pa.int64()),
                    ],
                    names=["package", "ordinal", "position", "length"],
                )

    return packages.select("package").mapInArrow(find, ENTRIES)


def parse_record(data: bytes) -> tuple:
    """Columns of RECORDS from one packed record; a payload that does not match its digest is an error."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda s: int(n) if (n := s.removeprefix("<urn:page:").removesuffix(">")) else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    kind = fields["WARC-Type"]
    if kind == "response" and (
        len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest
    ):
        raise ValueError(f"record {fields['WARC-Record-ID']}: payload and digest differ")
    refers = number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    shown = payload if kind == "response" else None
    return number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, refers, shown, size, digest


def read_records(packages: DataFrame, run: int = 256) -> DataFrame:
    """All records of the packages as RECORDS, read by ranges; a revisit has a null payload.

    Runs of ``run`` neighbouring records are dealt over the tasks, whatever the sizes of the packages; a task
    reads one record at a time. Empty packages and an empty list give no rows.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
        now, file, rows, held = None, None, [], 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for entries in batches:
            for package, position, length in zip(*(c.to_pylist() for c in entries.columns)):
                if package != now:
                    if file is not None:
                        file.close()
                    store, path = open_store(package)
                    now, file = package, store.open_input_file(path)
                rows.append(parse_record(file.read_at(length, position)))
                held += rows[-1][5]
                if held > 8 << 20 or len(rows) >= 2000:
                    yield batch()
                    held = 0
        if file is not None:
            file.close()
        if rows:
            yield batch()

    # The index is tiny next to what it points at, so the number of tasks comes from the bytes of the records.
    entries = stash(read_index(packages).withColumn("__run", F.floor(F.col("ordinal") / run)), "warc-index")
    packed = entries.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-packed // PER_TASK))
    dealt = entries.repartition(tasks, "package", "__run").sortWithinPartitions("package", "position")
    return dealt.select("package", "position", "length").mapInArrow(fetch, RECORDS)


def archive_pages(pages: DataFrame, folder: str | None = None, least: int = 0, **columns) -> DataFrame:
    """Write a record per page into packages (in the shared scratch folder by default) and read them back."""
    folder = folder or scratch_dir(pages.sparkSession, "warc")
    return read_records(write_packages(plan_records(pages, least=least, **columns), folder))
