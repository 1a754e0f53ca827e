"""WARC records in ZIP-packaged archives: written by Spark tasks, read back by ranges.

An archive is a ZIP file with two stored members: ``archive/data.warc.gz`` (one
gzip member per record) and ``indexes/index.jsonl`` (a line per record with its
offset and length).  The reader parses the central directory (ZIP64 included),
finds the stored members' bytes, reads the index, and range-reads records; it
never extracts an archive.

Writing: digests come from one narrow pass; the smallest page_id of each digest
is found by an aggregation that combines before the shuffle, and only digests
that occur twice or more are joined back.  Each task writes archives of bounded
size under names of its own, and the list of archives comes from the tasks that
succeeded, so a lost executor or a repeated attempt leaves at most files that no
list names.  Reading: the archives' indexes first, then their records in ranges
of bounded size, dealt out again.

Paths are URIs of any file system that pyarrow opens (file, hdfs, s3, gs).
Defined results: null html is an empty payload; rows that repeat a page_id and
payload are written each, as the record that the page_id gets; a null page_id
never is the original unless all are null; empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import io
import json
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.llm import archive_zip
from lurescope.llm import common as C
from lurescope.session import scratch_path

MIN_PAYLOAD = 0
#: Bytes of payload after which a task starts another archive, and bytes of records that one read task takes.
ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 8 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
DATE = "2024-01-01T00:00:00Z"
SYSTEM = "urn:page:"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


# ---- records -------------------------------------------------------------

def record_bytes(row: dict) -> bytes:
    """One WARC 1.1 record; a revisit keeps the HTTP head (with the payload's length) and no payload."""
    payload = row["payload"]
    size = row["payload_bytes"]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if row["record_type"] == "revisit" else head + payload
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE),
              ("WARC-Target-URI", (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A")),
              ("WARC-Payload-Digest", f"sha1:{row['digest']}"),
              ("X-Page-ID", "" if row["page_id"] is None else str(row["page_id"])),
              ("Content-Type", "application/http; msgtype=response")]
    if row["record_type"] == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To-Target-URI", f"{SYSTEM}{row['refers_to']}")]
    fields.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Header fields (lower-cased names) and block of a record."""
    if not raw.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    n = int(fields["content-length"])
    if len(rest) < n:
        raise ValueError("truncated WARC record")
    return {"fields": fields, "block": rest[:n]}


def page_of(raw: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload or None) of a record."""
    r = parse_record(raw)
    f, block = r["fields"], r["block"]
    http, _, body = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    revisit = f["warc-type"] == "revisit"
    refers = f.get("warc-refers-to-target-uri", "").removeprefix(SYSTEM)
    return (int(f["x-page-id"]) if f["x-page-id"] else None, length, f["warc-payload-digest"].removeprefix("sha1:"),
            f["warc-type"], int(refers) if revisit and refers and refers != "None" else None, None if revisit else body)


# ---- writing -------------------------------------------------------------

class _Archive:
    """Records gathered for one archive file (at most about ARCHIVE_BYTES)."""

    def __init__(self, folder: str) -> None:
        self.uri = f"{folder}/pages-{uuid.uuid4().hex}.zip"
        self.data, self.index, self.payload = io.BytesIO(), [], 0

    def add(self, row: dict) -> None:
        packed = gzip.compress(record_bytes(row), 5, mtime=0)
        self.index.append({"offset": self.data.tell(), "length": len(packed), "type": row["record_type"]})
        self.data.write(packed)
        self.payload += row["payload_bytes"]

    def write(self) -> tuple[str, int]:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, body in ((DATA, self.data.getbuffer()), (INDEX, "".join(json.dumps(x) + "\n" for x in self.index).encode())):
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as member:
                    member.write(body)
        system, path = filesystem(self.uri)
        with system.open_output_stream(path) as f:
            f.write(out.getbuffer())
        return self.uri, len(self.index)


def _write_archives(folder: str):
    def rows(batches: Iterator[pa.RecordBatch]):
        archive = _Archive(folder)
        for batch in batches:
            for row in batch.to_pylist():
                row["digest"] = base64.b32encode(bytes.fromhex(row.pop("sha1"))).decode()
                archive.add(row)
                if archive.payload >= ARCHIVE_BYTES:
                    yield _listing(*archive.write())
                    archive = _Archive(folder)
        if archive.index:
            yield _listing(*archive.write())
    return rows


def _listing(uri: str, records: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"uri": [uri], "records": [records]})


def typed_pages(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """page_id, url, payload, payload_bytes, sha1, record_type, refers_to."""
    payload = C.text_or_empty(F.col("html")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    often = p.filter(F.col("payload_bytes") >= min_payload).groupBy("sha1") \
             .agg(F.count(F.lit(1)).alias("times"), F.min("page_id").alias("first_id")).filter("times > 1")
    often = C.materialize(often.select(F.col("sha1").alias("d"), "first_id"), "warc_digests")
    p = p.join(often, F.col("sha1") == F.col("d"), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return p.select("page_id", "url", F.when(revisit, F.lit(b"").cast("binary")).otherwise(F.col("payload")).alias("payload"), "payload_bytes",
                    "sha1", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                    F.when(revisit, F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Write the pages as records; (uri, records) of the archives of successful tasks."""
    system, path = filesystem(folder)
    system.create_dir(path, recursive=True)
    written = typed_pages(pages, min_payload).mapInArrow(_write_archives(folder), "uri string, records long")
    return C.materialize(written, "warc_archives")


# ---- reading -------------------------------------------------------------

def _reader(f):
    def read(offset: int, length: int) -> bytes:
        f.seek(offset)
        return f.read(length)
    return read


RANGES = "uri string, start long, length long, sizes array<int>"


def _index_ranges(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for uri in batch.column("uri").to_pylist():
            system, path = filesystem(uri)
            with system.open_input_file(path) as f:
                read = _reader(f)
                found = {m.name: m for m in archive_zip.members(read, f.size())}
                data, index = found[DATA], found[INDEX]
                if data.method != archive_zip.STORED or index.method != archive_zip.STORED:
                    raise archive_zip.BadArchive(f"{uri}: members must be stored")
                base = archive_zip.data_offset(read, data)
                lines = read(archive_zip.data_offset(read, index), index.size).decode().splitlines()
            out, start, sizes = [], 0, []
            for entry in map(json.loads, lines):
                if sizes and entry["offset"] + entry["length"] - start > RANGE_BYTES:
                    out.append((uri, base + start, sum(sizes), sizes))
                    start, sizes = entry["offset"], []
                sizes.append(entry["length"])
            if sizes:
                out.append((uri, base + start, sum(sizes), sizes))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                                              pa.array(cols[3], pa.list_(pa.int32()))], ["uri", "start", "length", "sizes"])


def _pages_of_ranges(with_payload: bool):
    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for r in batch.to_pylist():
                system, path = filesystem(r["uri"])
                with system.open_input_file(path) as f:
                    raw = _reader(f)(r["start"], r["length"])
                out, at = [], 0
                for n in r["sizes"]:
                    page = page_of(zlib.decompress(raw[at:at + n], wbits=31))
                    out.append(page if with_payload else (*page[:5], None))
                    at += n
                cols = list(zip(*out)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
    return rows


PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the archives listed in ``archives`` (column uri)."""
    spark = archives.sparkSession
    ranges = C.materialize(archives.select("uri").mapInArrow(_index_ranges, RANGES), "warc_ranges")
    tasks = max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = ranges.repartition(tasks, F.xxhash64("uri", "start"))
    out = dealt.mapInArrow(_pages_of_ranges(with_payload), PAGES)
    return out if with_payload else out.drop("payload")


def round_trip(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, min_payload))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(C.read(spark, sf_dir, "pages"))
