"""The scan store: commits of both tables, crashes, conflicts, compaction and file skipping."""
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lurescope.operators import scoring
from lurescope.plans import catalog, scan_store
from lurescope.plans.scan_store import ScanStore, file_bounds
from lurescope.session import materialize, scratch_path
from conftest import ROOT, SF_SMALL


@pytest.fixture(scope="module")
def scans(spark):
    return materialize(catalog.fixture_scans(spark, SF_SMALL), "store_test")


def _ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_both_tables_or_neither(spark, scans, monkeypatch):
    store = ScanStore(spark, scratch_path(spark, "both"))
    assert store.scans().count() == 0 and store.feed().count() == 0
    store.write_run(scans.limit(100), "a")
    before = _ids(store.scans()), _ids(store.feed())

    def broken(*a, **k):
        raise OSError("no space left")

    monkeypatch.setattr(scoring, "threat_feed", broken)
    with pytest.raises(OSError):
        store.write_run(scans, "b")
    assert (_ids(store.scans()), _ids(store.feed())) == before
    monkeypatch.undo()
    store.write_run(scans, "b")
    assert store.scans().count() == 100 + scans.count()


KILLED = """
import os, sys
sys.path.insert(0, {root!r})
from lurescope.session import get_session
from lurescope.plans import scan_store
spark = get_session("local[2]", shuffle_partitions=2)
spark.sparkContext.setLogLevel("OFF")
scan_store.scoring.threat_feed = lambda *a, **k: os._exit(9)  # the scans are written, the feed is not
scan_store.ScanStore(spark, {store!r}).write_run(spark.read.parquet({scans!r}), "killed")
"""


def test_a_killed_writer_leaves_nothing_visible(spark, scans):
    root, rows = scratch_path(spark, "killed"), scratch_path(spark, "killed_rows")
    scans.limit(50).write.parquet(rows)
    store = ScanStore(spark, root)
    store.write_run(scans.limit(20), "a")
    done = subprocess.run([sys.executable, "-c", KILLED.format(root=ROOT, store=root, scans=rows)], timeout=180, capture_output=True)
    assert done.returncode == 9, done.stderr[-800:]
    folders = os.listdir(root.replace("file:", "") + "/scans")
    assert any(f.startswith("segment=killed.") for f in folders)  # it had written its scans
    assert store.scans().count() == 20 and store.scans().filter("run_id = 'killed'").count() == 0
    assert store.feed().join(store.scans().select(F.col("id").alias("scan_id")), "scan_id", "left_anti").count() == 0
    assert any("killed" in p for p in store.vacuum()) and store.scans().count() == 20


def test_two_writers_of_one_version(spark, scans):
    """The version that the other made first is kept, and the loser commits on top of it."""
    root = scratch_path(spark, "two")
    a, b = ScanStore(spark, root), ScanStore(spark, root)
    a.write_run(scans.limit(10), "a")
    seen = a.segments()
    assert not b.files.create(b._file(1), "{}")  # never replaced

    def change(old):
        if old == seen:  # the other writer commits while this one decides
            b.write_run(scans.limit(5), "b")
        return old + [scan_store.Segment("c", ["c"], dict(seen[0].tables))]

    a._swap(change)
    assert [s.runs for s in a.segments()] == [["a"], ["b"], ["c"]]


def test_compaction_bounds_files_and_readers_skip(spark, scans):
    store = ScanStore(spark, scratch_path(spark, "compact"))
    days = [r.d for r in scans.select(F.dayofmonth("created_at").alias("d")).distinct().collect()]
    for d in days[:12]:
        store.write_run(scans.filter(F.dayofmonth("created_at") == d), f"day-{d}")
    want = _ids(store.scans()), _ids(store.feed())
    runs = {r.run_id: r["count"] for r in store.scans().groupBy("run_id").count().collect()}
    assert len(store.segments()) == 12
    store.compact(rows_per_file=15)
    assert (_ids(store.scans()), _ids(store.feed())) == want and len(store.segments()) == 1
    assert {r.run_id: r["count"] for r in store.scans().groupBy("run_id").count().collect()} == runs
    files, feed = (file_bounds(df, cols).collect() for df, cols in ((store.scans(), ["domain"]), (store.feed(), ["category", "verdict"])))
    assert len(files) <= -(-len(want[0]) // 15) + 12 and len(feed) <= -(-len(want[1]) // 15) + 1  # ranges, and a cut where a day ends in one
    per_domain = [sum(f.min_domain <= d <= f.max_domain for f in files) for d in {r.domain for r in store.scans().collect()}]
    assert sum(per_domain) / len(per_domain) < 0.6 * len(files)  # files that a domain filter opens
    for column, value in (("category", "banking"), ("category", "upi"), ("verdict", "PHISHING")):
        opened = [f for f in feed if f[f"min_{column}"] <= value <= f[f"max_{column}"]]
        assert sum(f.rows for f in opened) >= store.feed().filter(F.col(column) == value).count()
        assert column == "verdict" or len(opened) < len(feed)


def test_a_run_committed_during_compaction_wins(spark, scans, monkeypatch):
    store = ScanStore(spark, scratch_path(spark, "meanwhile"))
    store.write_run(scans.limit(30), "a")
    store.write_run(scans.limit(30).withColumn("id", F.concat(F.lit("b-"), "id")), "b")
    write, other = store._clustered, ScanStore(spark, store.root)
    once = []

    def slow(*a, **k):
        write(*a, **k)
        if not once:
            once.append(other.write_run(scans.limit(7), "a"))

    monkeypatch.setattr(store, "_clustered", slow)
    store.compact()
    assert {r.run_id: r["count"] for r in store.scans().groupBy("run_id").count().collect()} == {"a": 7, "b": 30}
    monkeypatch.undo()
    store.compact()
    assert len(store.segments()) == 1
    assert {r.run_id: r["count"] for r in store.scans().groupBy("run_id").count().collect()} == {"a": 7, "b": 30}


def test_old_versions_can_be_read_until_the_vacuum(spark, scans):
    store = ScanStore(spark, scratch_path(spark, "versions"))
    one = store.write_run(scans.limit(10), "a")
    store.write_run(scans.limit(4), "a")
    assert store.scans().count() == 4 and store.scans(one).count() == 10
    assert store.vacuum() and store.scans().count() == 4 and store.versions() == [2]


def test_jobs_write_and_compact_a_store(spark, tmp_path):
    from lurescope.plans import jobs
    from lurescope.sources import fixtures as fx
    req, root = scratch_path(spark, "job_requests"), scratch_path(spark, "job_store")
    fx.scan_requests(spark, SF_SMALL).limit(60).repartition(3).write.parquet(req)
    batch = ["batch", "--requests", req, "--store", root, "--run-id", "one", "--as-of", "2024-01-31"]
    for _ in range(2):
        jobs.run_batch(spark, jobs._args(batch))
    stream = ["stream", "--requests", req, "--store", root, "--checkpoint", scratch_path(spark, "job_ck"), "--once", "--as-of", "2024-01-31",
              "--max-files-per-trigger", "1"]
    jobs.run_stream(spark, jobs._args(stream))
    store = ScanStore(spark, root)
    assert store.scans().count() == 120 and store.scans().select("id").distinct().count() == 60
    jobs.run_compact(spark, jobs._args(["compact", "--store", root]))
    assert store.scans().count() == 120 and len(store.segments()) == 1 and len(store.versions()) == 1
    with pytest.raises(SystemExit):
        jobs._args(["batch", "--requests", req])
