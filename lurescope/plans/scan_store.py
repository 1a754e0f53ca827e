"""K1, K3, K5: the scan and feed tables behind one manifest of committed runs.

A run writes its scans and its feed below folders of their own (``attempt``), and
only then a new version of the manifest names them.  Readers resolve the newest
version and read only the folders that it names, so both tables of a run become
visible together; what a crashed run left is never read.  A version is a small
JSON file that is renamed into place and never changed; of two writers that make
the same version one fails and tries again on top of the other.  (The file system
must rename atomically, as for Spark's own streaming checkpoints.)

``compact`` rewrites the committed runs into files clustered for reading: scans by
domain, the feed by category and newest time.  The new folders are swapped in by
the manifest; the rows keep their run id, and a run that is committed meanwhile
stays.  ``vacuum`` deletes the folders that no kept version names.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring
from ..session import delete_path
from ..sources import fixed_values as FV
from . import scan_job

TABLES = ("scans", "feed")
#: How the folders of compacted rows begin (no run id may).
COMPACT = "compact."
#: Rows of a compacted file.
CLUSTER_ROWS = 1_000_000
#: A version that another writer made first is tried again this often.
RETRIES = 50


def _folder(table: str, segment: str) -> str:
    return f"{table}/segment={segment}"


class CommitConflict(RuntimeError):
    pass


@dataclass
class Segment:
    """One folder of each table: a run's, or the compacted rows of several."""
    id: str
    runs: list[str]
    tables: dict[str, str]
    rows: dict[str, int] = field(default_factory=dict)


class _Files:
    """The few file operations of the manifest, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)
        self.fc = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return str(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, p: str, text: str) -> bool:
        """``p`` with ``text``, whole or not at all; False if it is there already."""
        temporary = f"{p.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self.path(temporary), True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        try:
            none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
            options = self.jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
            self.jvm.java.lang.reflect.Array.set(options, 0, none)
            self.fc.rename(self.path(temporary), self.path(p), options)
            return True
        except Exception as e:
            self.fs.delete(self.path(temporary), False)
            if "FileAlreadyExistsException" in str(getattr(e, "java_exception", e)):
                return False
            raise


class ScanStore:
    """``<root>/scans``, ``<root>/feed`` and ``<root>/_manifest``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.files = _Files(spark, self.root)

    # ---- manifest ------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(f"{self.root}/_manifest") if n.endswith(".json") and not n.startswith(".")]

    def segments(self, version: int | None = None) -> list[Segment]:
        """What the newest (or a given) version names."""
        versions = self.versions()
        if not versions:
            return []
        text = self.files.read(self._file(versions[-1] if version is None else version))
        return [Segment(**s) for s in json.loads(text)["segments"]]

    def _file(self, version: int) -> str:
        return f"{self.root}/_manifest/{version:020d}.json"

    def _swap(self, change) -> int:
        """A new version with ``change(segments)``; again on top of the other one if another writer was first."""
        for _ in range(RETRIES):
            version = (self.versions() or [0])[-1]
            segments = change(self.segments(version) if version else [])
            text = json.dumps({"segments": [s.__dict__ for s in segments]}, sort_keys=True)
            if self.files.create(self._file(version + 1), text):
                return version + 1
            time.sleep(0.05)
        raise CommitConflict(f"no free version after {RETRIES} tries")

    # ---- writing -------------------------------------------------------------------------

    def write_run(self, scans: DataFrame, run_id: str, medium: int = FV.MEDIUM_RISK_THRESHOLD) -> int:
        """K3: the scans of a run and the feed derived from them, visible together; a repeated id replaces that run."""
        if run_id.startswith(COMPACT):
            raise ValueError(f"a run id can't begin with {COMPACT}")
        attempt = f"{run_id}.{uuid.uuid4().hex[:8]}"
        paths = {t: _folder(t, attempt) for t in TABLES}
        self._write(scans.withColumn("run_id", F.lit(run_id)), paths["scans"], "created_date", "created_at", ["domain"])
        written = self._open("scans", [paths["scans"]])
        self._write(scoring.threat_feed(written, medium).withColumn("run_id", F.lit(run_id)), paths["feed"], "flagged_date",
                    "flagged_at", ["domain"])
        segment = Segment(attempt, [run_id], paths)
        return self._swap(lambda old: self._without(old, run_id) + [segment])

    def _without(self, segments: list[Segment], run_id: str) -> list[Segment]:
        """The segments that stay when ``run_id`` is written again."""
        return [s for s in segments if s.runs != [run_id]]

    def _write(self, rows: DataFrame, path: str, day: str, at: str, order: list[str]) -> None:
        (rows.withColumn(day, F.to_date(at)).sortWithinPartitions(day, *order)
             .write.mode("overwrite").option("maxRecordsPerFile", scan_job.MAX_RECORDS_PER_FILE)
             .options(**scan_job.ID_BLOOM).partitionBy(day).parquet(f"{self.root}/{path}"))

    # ---- reading -------------------------------------------------------------------------

    def scans(self, version: int | None = None) -> DataFrame:
        return self._table("scans", version)

    def feed(self, version: int | None = None) -> DataFrame:
        return self._table("feed", version)

    def _table(self, table: str, version: int | None) -> DataFrame:
        """Rows of a run that was written again after it was compacted come from its newest segment only."""
        segments = self.segments(version)
        newest = {run: s.id for s in segments for run in s.runs}
        plain = [s for s in segments if all(newest[r] == s.id for r in s.runs)]
        out = self._open(table, [s.tables[table] for s in plain])
        for s in segments:
            if s not in plain:
                stale = [r for r in s.runs if newest[r] != s.id]
                out = out.unionByName(self._open(table, [s.tables[table]]).filter(~F.col("run_id").isin(stale)))
        return out

    def _open(self, table: str, paths: list[str]) -> DataFrame:
        schema = scan_job.SCAN_RESULTS_SCHEMA if table == "scans" else scan_job.THREAT_FEED_SCHEMA
        out = None
        # the compacted feed has its day as a column, all other folders as a folder level
        flat = [p for p in paths if table == "feed" and p.startswith(_folder("feed", COMPACT))]
        for group in (flat, [p for p in paths if p not in flat]):
            if group:
                rows = (self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}")
                            .parquet(*[f"{self.root}/{p}" for p in group]).select(schema.names))
                out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], schema)

    # ---- compaction ----------------------------------------------------------------------

    def compact(self, rows_per_file: int = CLUSTER_ROWS) -> int:
        """K1, K5: all committed segments as one, in files that are narrow in what readers filter by.

        Scans are ranged by (day, domain), the feed by (category, verdict, time):
        a range is a file, so the number of files is bounded by rows, days and
        categories, not by runs.  Range bounds come from a sample, a frequent domain
        fills several files (rows of equal keys are spread by their id), and no row
        is left out.
        """
        old = self.segments()
        if not old:
            return 0
        name = f"{COMPACT}{uuid.uuid4().hex[:8]}"
        paths = {t: _folder(t, name) for t in TABLES}
        self._clustered(self.scans(), paths["scans"], "created_date", [F.col("created_date"), F.col("domain"), F.col("id")], rows_per_file)
        self._clustered(self.feed(), paths["feed"], "flagged_date",
                        [F.col("category"), F.col("verdict"), F.col("flagged_at").desc(), F.col("id")], rows_per_file, by_day=False)
        segment = Segment(name, sorted({r for s in old for r in s.runs}), paths)
        seen = {s.id for s in old}
        # runs that were committed meanwhile stay behind the compacted rows, and win over them
        return self._swap(lambda now: [segment] + [s for s in now if s.id not in seen])

    def _clustered(self, rows: DataFrame, path: str, day: str, order: list[Column], per_file: int, by_day: bool = True) -> None:
        n = rows.count()
        ranged = rows.repartitionByRange(max(1, -(-n // per_file)), *order).sortWithinPartitions(*order)
        writer = ranged.write.mode("overwrite").option("maxRecordsPerFile", per_file).options(**scan_job.ID_BLOOM)
        (writer.partitionBy(day) if by_day else writer).parquet(f"{self.root}/{path}")

    def vacuum(self, keep_versions: int = 1) -> list[str]:
        """Delete the folders that none of the newest ``keep_versions`` versions names, and the older versions.

        Only when no run is being written: its folders are named by no version yet.
        """
        versions = self.versions()
        kept = versions[-keep_versions:]
        named = {p for v in kept for s in self.segments(v) for p in s.tables.values()}
        gone = [f"{t}/{n}" for t in TABLES for n in self.files.names(f"{self.root}/{t}") if f"{t}/{n}" not in named]
        for p in gone:
            delete_path(self.spark, f"{self.root}/{p}")
        for v in versions[:-keep_versions]:
            delete_path(self.spark, self._file(v))
        return gone


def file_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """``file, rows`` and the least and greatest value of each column: the files that a filter can't skip."""
    aggs = [f(F.col(c)).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("rows"), *aggs)
