"""WARC archives: round trip, record types, ZIP64 directories."""
import base64
import hashlib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lurescope.llm import archive_zip, warc
from lurescope.session import scratch_path


def brute(rows, least=0):
    out = []
    first = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        if page is not None:
            first[raw] = min(first.get(raw, page), page)
    for page, _, html in rows:
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        original = first.get(raw)
        revisit = len(raw) >= least and original is not None and page != original
        out.append((page, len(raw), digest, "revisit" if revisit else "response", original if revisit else None))
    return sorted(out, key=str)


def pages(rng, n=60):
    bodies = ["<p>same</p>", "", None, "<b>ü€😀</b>" * 50, "x" * 300_000]
    rows = [(i, f"http://h/{i}", rng.choice(bodies) if rng.random() < .4 else f"<html>{rng.random()}</html>" * rng.randrange(1, 40))
            for i in range(n)]
    rng.shuffle(rows)
    return [*rows, (500, None, "a\r\n\r\nWARC/1.1\r\n"), (501, "u\r\nX: y", "\r\n\r\n"), rows[0], (None, "http://n", "only null")]


SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize("least", [0, 20])
def test_round_trip(spark, least, monkeypatch):
    rows = pages(random.Random(3))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("sha1", F.lit("clash")).withColumn("payload", F.lit(1))
    got = warc.round_trip(df, least)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, least)


def test_payloads_come_back_whole(spark):
    rows = pages(random.Random(4))
    listed = warc.write_archives(spark.createDataFrame(rows, SCHEMA), scratch_path(spark, "warc-test"))
    assert listed.agg(F.sum("records")).first()[0] == len(rows)
    by_id = {}
    for page, _, html in rows:
        by_id[page] = (html or "").encode()
    for r in warc.read_archives(listed, with_payload=True).collect():
        if r.record_type == "response":
            assert bytes(r.payload) == by_id[r.page_id]


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def _reader(raw):
    return lambda offset, length: raw[offset:offset + length]


@pytest.mark.parametrize("zip64", [False, True])
def test_directory_and_ranges(zip64):
    out = io.BytesIO()
    bodies = {"a/ü.txt": b"one" * 10, "b": b"", "c.bin": bytes(range(256)) * 9}
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"comment with PK\x05\x06 inside"
        for name, body in bodies.items():
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as f:
                f.write(body)
    raw = out.getvalue()
    for m in archive_zip.members(_reader(raw), len(raw)):
        at = archive_zip.data_offset(_reader(raw), m)
        assert raw[at:at + m.size] == bodies.pop(m.name)
    assert not bodies


def test_zip64_end_record(monkeypatch):
    """More members than the 16-bit count holds force the ZIP64 end record."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(65_600):
            z.writestr(zipfile.ZipInfo(str(i)), b"x" if i % 1000 == 0 else b"")
    raw = out.getvalue()
    found = archive_zip.members(_reader(raw), len(raw))
    assert len(found) == 65_600 and found[-1].name == "65599"
    at = archive_zip.data_offset(_reader(raw), found[65_000])
    assert raw[at:at + 1] == b"x"


def test_zip64_offsets():
    """Sizes and offsets of 0xFFFFFFFF are taken from the ZIP64 extra field."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"hello")
    raw = bytearray(out.getvalue())
    at = raw.rfind(archive_zip.CENTRAL)
    import struct
    n_name = struct.unpack("<H", raw[at + 28:at + 30])[0]
    extra = struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    entry = raw[at:at + 46 + n_name]
    entry[20:28] = b"\xff" * 8
    entry[30:32] = struct.pack("<H", len(extra))
    entry[42:46] = b"\xff" * 4
    directory = bytes(entry) + extra
    body = bytes(raw[:at]) + directory
    end64 = archive_zip.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(directory), at)
    locator = archive_zip.END64_LOCATOR + struct.pack("<IQI", 0, len(body), 1)
    end = archive_zip.END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    whole = body + end64 + locator + end
    (m,) = archive_zip.members(_reader(whole), len(whole))
    assert (m.size, m.header, whole[archive_zip.data_offset(_reader(whole), m):][:5]) == (5, 0, b"hello")


def test_not_an_archive():
    with pytest.raises(archive_zip.BadArchive):
        archive_zip.members(_reader(b"nothing here"), 12)
