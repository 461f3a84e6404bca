"""ZIP packages: round trip, own reading of directories, ZIP64, damage."""

import base64
import hashlib
import io
import struct
import zipfile

import pytest

from ledgerlark.llm.warc_zip import ARCHIVE, INDEX, archive_pages, plan_records, read_records, write_packages, zip_members

SCHEMA = "page_id long, url string, html string, digest string"


class Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, offset):
        return self.data[offset : offset + n]


def test_round_trip_with_copies_and_odd_rows(spark, tmp_path):
    rows = [(3, "http://a/\r\nX: 1", "<p>é</p>", "d"), (2, None, "<p>é</p>", "d"), (5, "u", None, "d"), (4, "u", "", "d"),
            (None, "u", "alone", "d"), (None, "v", "<p>é</p>", "d"), (9, "u", "x" * 300_000, "d"), (2, None, "<p>é</p>", "d"), (7, "u", "HTTP\r\n\r\nWARC/1.1", "d")]
    got = archive_pages(spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h for i, _, h, _ in rows if i == r.page_id and (r.payload is None or (h or "").encode() == r.payload)) if r.record_type == "response" else None
        if html is not None:
            assert r.payload == html.encode() and r.payload_bytes == len(r.payload)
            assert r.payload_digest == base64.b32encode(hashlib.sha1(r.payload).digest()).decode()
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert kinds == [(0, "response", None, 5), (0, "revisit", 2, 9), (2, "response", None, 9), (2, "response", None, 9), (3, "revisit", 2, 9),
                     (4, "response", None, 0), (5, "revisit", 4, 0), (7, "response", None, 16), (9, "response", None, 300_000)]


def test_many_packages_and_short_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", "abc" if i % 2 else f"page {i}" * 9, "") for i in range(500)], SCHEMA)
    made = write_packages(plan_records(pages, least=10), str(tmp_path), most_records=40)
    assert made.count() >= 500 // 40 and made.agg({"records": "sum"}).first()[0] == 500
    got = read_records(made, run=7).collect()
    assert {r.page_id for r in got} == set(range(500)) and all(r.record_type == "response" for r in got)
    for path in tmp_path.glob("*.zip"):
        with zipfile.ZipFile(path) as package:  # another reader agrees
            assert package.testzip() is None and {ARCHIVE, INDEX} < set(package.namelist())
            found = zip_members(Bytes(path.read_bytes()))
            assert {n: (m.size, m.packed) for n, m in found.items()} == {i.filename: (i.file_size, i.compress_size) for i in package.infolist()}
    assert archive_pages(pages.limit(0), str(tmp_path / "none")).collect() == []


def zip64(members, comment=b""):
    """A package whose sizes, offsets and counts all stand in ZIP64 records."""
    out, central = io.BytesIO(), b""
    out.write(b"leading bytes")
    for name, data in members.items():
        at = out.tell()
        out.write(b"PK\3\4" + struct.pack("<5H3I2H", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name.encode())
        out.write(struct.pack("<2H2Q", 1, 16, len(data), len(data)) + data)
        extra = struct.pack("<2H", 0x7777, 3) + b"abc" + struct.pack("<2H3Q", 1, 24, len(data), len(data), at)
        central += b"PK\1\2" + struct.pack("<6H3I5H2I", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 4, 0, 0, 0, 0xFFFFFFFF) + name.encode() + extra + b"note"
    start = out.tell()
    out.write(central)
    end = out.tell()
    out.write(b"PK\6\6" + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, len(members), len(members), len(central), start))
    out.write(b"PK\6\7" + struct.pack("<IQI", 0, end, 1))
    out.write(b"PK\5\6" + struct.pack("<4H2IH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, len(comment)) + comment)
    return out.getvalue()


@pytest.mark.parametrize("comment", [b"", b"with PK\5\6 inside"])
def test_zip64_directories(comment):
    members = {"a": b"first", "dir/b": b"", "c": b"x" * 1000}
    data = zip64(members, comment)
    found = zip_members(Bytes(data))
    assert {n: data[m.start : m.start + m.size] for n, m in found.items()} == members


def test_damage_is_an_error():
    data = zip64({"a": b"x"})
    for bad in (b"", b"no zip here", data[:-1], data.replace(b"PK\1\2", b"XX\1\2"), data.replace(b"PK\6\7", b"XX\6\7"), data.replace(b"PK\3\4", b"XX\3\4")):
        with pytest.raises(ValueError):
            zip_members(Bytes(bad))
