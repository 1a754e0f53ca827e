"""Repeated byte strings by sparse distributed prefix doubling.

Removes every byte that lies in a string of ``min_bytes`` bytes which also
starts anywhere else in the corpus.  Ranks of byte strings double in length
until they pass the threshold, and positions whose rank is unique drop out:

1. ``anchors``: a position's first rank is the fingerprint of its next
   ``min_bytes / 2`` bytes.  Only anchors take part, the positions of the least
   rank in some ``min_bytes`` window (about one position in 50); equal windows
   have the same anchor, so nothing is lost.  Unique anchors drop out.
2. Each remaining anchor stands for the run of windows that chose it.  Runs of
   equal content are ranked together: a run that occurs twice is covered, and
   one run of each kind goes on.
3. The windows of the runs that go on are ranked by the pair of half-length
   ranks at offsets 0 and ``min_bytes / 2``; windows of a unique pair drop out.
   The pairs are past the threshold, so what is left is repeated.

Starting from the sorted ranks of all positions would move 16 bytes per byte of
text and round; anchors cut that to a fraction of the text.  Counts combine
before each shuffle, so a string that a third of the corpus shares costs one row
per task, and the rows of a document only meet the document's own rows.

Ranks are 64-bit fingerprints, and pairs of them 128-bit.  Defined results: null
text is empty; texts shorter than ``min_bytes`` keep everything; rows that
repeat are found in each other and removed if long enough; empty tables give no
rows; extra columns are ignored; matches never cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.llm import common as C
from lurescope.llm.hashing import mix

MIN_BYTES = 200
#: Window starts handled at once of a long text (bounds the memory of a task).
SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFF)


class Fingerprints:
    """Rolling fingerprints of byte strings, mod 2**64."""

    def __init__(self) -> None:
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up = np.full(size, _BASE, np.uint64)
            self.down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            self.up[0] = self.down[0] = 1
            self.up = np.cumprod(self.up, dtype=np.uint64)
            self.down = np.cumprod(self.down, dtype=np.uint64)

    def sums(self, buf: np.ndarray) -> np.ndarray:
        n = len(buf)
        self._powers(n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[buf] * self.up[:n], dtype=np.uint64, out=out[1:])
        return out

    def all(self, sums: np.ndarray, length: int) -> np.ndarray:
        """Fingerprint of the ``length`` bytes at every position."""
        n = len(sums) - length
        return mix((sums[length:] - sums[:n]) * self.down[:n])

    def at(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def window_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive keys (block prefix and suffix minima)."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(right[:m], left[width - 1:width - 1 + m])


def runs(raw: bytes, fp: Fingerprints, min_bytes: int):
    """(first start, last start, rank of the anchor, fingerprint of the run) of a text's runs."""
    half = min_bytes // 2
    width = min_bytes - half + 1
    whole = np.frombuffer(raw, np.uint8)
    for at in range(0, max(0, len(whole) - min_bytes + 1), SEGMENT):
        buf = whole[at:at + SEGMENT + min_bytes - 1]
        sums = fp.sums(buf)
        rank = fp.all(sums, half)
        # ties go to the leftmost position, which equal windows agree on
        keys = (rank & ~_LOW) | np.arange(len(rank), dtype=np.uint64)
        anchor = (window_min(keys, width) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([first[1:], [len(anchor)]]) - 1
        where = anchor[first]
        content = fp.at(sums, first, last + min_bytes) + mix((where - first).astype(np.uint64))
        yield at + first, at + last, rank[where], content


def _arrays(batch, names: list[str], columns: list[list[np.ndarray]], kinds: list):
    flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(a.astype(k)) for a, k in zip(flat, kinds)], names)


ANCHORS = "doc_id long, th int, first int, last int, rank long, content long"


def _anchor_rows(min_bytes: int):
    def rows(batches):
        fp = Fingerprints()
        for batch in batches:
            out = [[] for _ in range(6)]
            ids, ths = batch.column("doc_id"), batch.column("th")
            for i, raw in enumerate(batch.column("text")):
                for first, last, rank, content in runs(raw.as_py(), fp, min_bytes):
                    n = len(first)
                    values = (np.full(n, ids[i].as_py()), np.full(n, ths[i].as_py()), first, last, rank.astype(np.int64), content.astype(np.int64))
                    for o, v in zip(out, values):
                        o.append(v)
            yield _arrays(batch, ["doc_id", "th", "first", "last", "rank", "content"], out,
                          [np.int64, np.int32, np.int32, np.int32, np.int64, np.int64])
    return rows


CONTEXTS = "doc_id long, th int, first int, alone boolean, bytes binary"


def _context_rows(min_bytes: int):
    def rows(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for d in batch.to_pylist():
                for r in d["wanted"]:
                    values = (d["doc_id"], d["th"], r["first"], r["alone"], d["text"][r["first"]:r["last"] + min_bytes])
                    for o, v in zip(out, values):
                        o.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(o, k) for o, k in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()))],
                ["doc_id", "th", "first", "alone", "bytes"])
    return rows


WINDOWS = "r1 long, r2 long, doc_id long, place long"


def _window_rows(min_bytes: int):
    half = min_bytes // 2

    def rows(batches):
        fp = Fingerprints()
        for batch in batches:
            out = [[] for _ in range(4)]
            for d in batch.to_pylist():
                rank = fp.all(fp.sums(np.frombuffer(d["bytes"], np.uint8)), half)
                n = len(d["bytes"]) - min_bytes + 1
                second = rank[min_bytes - half:min_bytes - half + n]
                place = (np.int64(d["first"]) + np.arange(n)) * 2 + int(d["alone"])
                values = (rank[:n].astype(np.int64), second.astype(np.int64), np.full(n, d["doc_id"]), place + (np.int64(d["th"]) << 32))
                for o, v in zip(out, values):
                    o.append(v)
            yield _arrays(batch, ["r1", "r2", "doc_id", "place"], out, [np.int64] * 4)
    return rows


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def spans_of(found: list[dict], unique: list[int], min_bytes: int) -> list[tuple[int, int]]:
    """Maximal byte spans covered by repeated windows: runs of starts less the unique ones."""
    gone, spans = set(unique), []
    for r in sorted(found, key=lambda r: r["first"]):
        if r["covered"] or not gone:
            pieces = [(r["first"], r["last"])]
        else:
            starts = np.array([x for x in range(r["first"], r["last"] + 1) if x not in gone], np.int64)
            cuts = np.flatnonzero(np.diff(starts) > 1) + 1
            pieces = [(int(p[0]), int(p[-1])) for p in np.split(starts, cuts) if len(p)]
        for a, b in pieces:
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], b + min_bytes))
            else:
                spans.append((a, b + min_bytes))
    return spans


def _cut_rows(min_bytes: int, with_text: bool):
    def rows(batches):
        for batch in batches:
            out = []
            for d in batch.to_pylist():
                raw = d["text"]
                spans = spans_of(d["found"] or [], d["unique"] or [], min_bytes)
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                out.append((d["doc_id"], len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(),
                            kept if with_text else None))
            cols = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return rows


def _units(docs: DataFrame) -> DataFrame:
    """Documents keyed by (id, checksum); a null id is -1 here and null again in the result."""
    text = C.text_or_empty(F.col("text"))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"),
                       F.hash(text, F.col("doc_id")).alias("th"), text.cast("binary").alias("text"),
                       F.col("doc_id").isNull().alias("anonymous"))


def repeated_runs(units: DataFrame, min_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Per document key: its runs that hold repeated windows, and the unique windows among them."""
    texts = units.select("doc_id", "th", "text").filter(F.octet_length("text") >= min_bytes)
    anchors = texts.mapInArrow(_anchor_rows(min_bytes), ANCHORS)
    names = anchors.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("rank").alias("again"))
    names = C.materialize(names, "suffix_ranks")
    left = C.materialize(anchors.join(names, F.col("rank") == F.col("again")).drop("again"), "suffix_runs")
    kinds = left.groupBy("rank", "content").agg(F.count(F.lit(1)).alias("times"),
                                                F.min(F.struct("doc_id", "th", "first", "last")).alias("one"))
    kinds = C.materialize(kinds, "suffix_kinds")
    # ranks with runs of several kinds go on to windows
    several = kinds.groupBy("rank").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select(F.col("rank").alias("r"))
    go_on = kinds.join(several, F.col("rank") == F.col("r")).select("one.*", (F.col("times") == 1).alias("alone"))
    wanted = go_on.groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "last", "alone")).alias("wanted"))
    one_each = texts.dropDuplicates(["doc_id", "th"]) if _has_twins(units) else texts
    contexts = C.materialize(one_each.join(wanted, ["doc_id", "th"]).select("doc_id", "th", "text", "wanted")
                             .mapInArrow(_context_rows(min_bytes), CONTEXTS), "suffix_contexts")
    windows = contexts.mapInArrow(_window_rows(min_bytes), WINDOWS)
    single = windows.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"), F.min("place").alias("place")) \
                    .filter((F.col("n") == 1) & (F.col("place") % 2 != 0))
    single = single.select("doc_id", F.shiftright("place", 32).cast("int").alias("th"),
                           F.shiftright(F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)), 1).cast("int").alias("start"))
    unique = C.materialize(single.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list("start")).alias("unique")), "suffix_unique")
    # a run is covered at once if its kind occurs twice
    often = kinds.filter("times > 1").select(F.col("rank").alias("r"), F.col("content").alias("c"))
    found = left.join(often, (F.col("rank") == F.col("r")) & (F.col("content") == F.col("c")), "left") \
                .withColumn("covered", F.col("r").isNotNull())
    # alone and its rank has no other kind: can't be (its rank occurs twice), so the windows decide
    return found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "last", "covered")).alias("found")), unique


def _has_twins(units: DataFrame) -> bool:
    twins = units.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return not twins.isEmpty()


def cut_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the remaining bytes) per document."""
    units = _units(docs)
    found, unique = repeated_runs(units, min_bytes)
    work = C.materialize(found.join(unique, ["doc_id", "th"], "left"), "suffix_found")
    joined = units.join(work, ["doc_id", "th"], "left").select(
        F.when(~F.col("anonymous"), F.col("doc_id")).alias("doc_id"), "text", "found", "unique")
    out = joined.mapInArrow(_cut_rows(min_bytes, with_text), RESULT)
    return out if with_text else out.drop("kept")


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(C.read(spark, sf_dir, "documents"))
