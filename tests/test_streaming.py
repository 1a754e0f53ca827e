"""Streaming: exactly-once reruns, row-local twin equals the batch plan."""
import os

import pytest
from pyspark.sql import functions as F

from lurescope.plans import catalog, scan_job
from lurescope.session import scratch_path, shared_dir
from lurescope.sources import fixtures as fx
from lurescope.streaming import scan_stream as st
from conftest import SF_SMALL


def test_foreach_batch_job_is_exactly_once(spark):
    src = scratch_path(spark, "landing")
    fx.scan_requests(spark, SF_SMALL).repartition(3).write.parquet(src)
    dns, who, tls_obs = catalog._records(spark, SF_SMALL)
    sp, fp, ck = scratch_path(spark, "s"), scratch_path(spark, "f"), scratch_path(spark, "ck")
    for _ in range(2):  # second run resumes from the checkpoint: nothing new, nothing duplicated
        stream = st.request_stream(spark, src, max_files_per_trigger=1)
        st.scan_job_stream(stream, sp, fp, ck, dns, who, tls_obs, fx.AGES_AS_OF, fx.FIXTURE_CATEGORY_RULES,
                           zero_day_fn=fx.fixture_zero_day)
    scans = scan_job.read_scan_results(spark, sp)
    n_req = catalog.valid_requests(spark, SF_SMALL).count()
    assert scans.count() == n_req == scans.select("id").distinct().count()
    assert scans.select("run_id").distinct().count() >= 2
    feed = scan_job.read_threat_feed(spark, fp)
    assert feed.count() == scans.filter("score >= 40").count()


def test_rowlocal_stream_equals_batch(spark):
    a = catalog.q_stream_scan_rowlocal(spark, SF_SMALL)
    b = catalog.q_scan_results(spark, SF_SMALL)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_two_checkpoints_append_to_one_table(spark):
    req = fx.scan_requests(spark, SF_SMALL)
    sp, fp = scratch_path(spark, "s2"), scratch_path(spark, "f2")
    for half in (0, 1):
        src = scratch_path(spark, f"landing{half}")
        req.filter(F.col("request_id") % 2 == half).write.parquet(src)
        st.scan_job_stream(st.request_stream(spark, src), sp, fp, scratch_path(spark, f"ck{half}"), as_of=fx.AGES_AS_OF)
    scans = scan_job.read_scan_results(spark, sp)
    assert scans.count() == catalog.valid_requests(spark, SF_SMALL).count() == scans.select("id").distinct().count()


def test_daily_stats_have_every_day(spark):
    df = catalog.q_stream_daily_stats(spark, SF_SMALL).collect()
    scans = catalog.q_scan_results(spark, SF_SMALL)
    assert {r.day for r in df} == {r.d for r in scans.select(F.to_date("created_at").alias("d")).distinct().collect()}
    assert sum(r.threats for r in df) == scans.filter("score >= 40").count()


def test_micro_batches_leave_no_scratch_tables(spark):
    """Twenty micro-batches: intermediate tables are deleted with their batch."""
    src = scratch_path(spark, "landing20")
    fx.scan_requests(spark, SF_SMALL).limit(200).repartition(20).write.parquet(src)
    base = shared_dir(spark).replace("file:", "")
    before = set(os.listdir(base))
    st.scan_job_stream(st.request_stream(spark, src, max_files_per_trigger=1), scratch_path(spark, "s20"), scratch_path(spark, "f20"),
                       scratch_path(spark, "ck20"), *catalog._records(spark, SF_SMALL), as_of=fx.AGES_AS_OF)
    new = {x.split("-")[0] for x in set(os.listdir(base)) - before}
    assert new <= {"s20", "f20", "ck20", "fixture_hosts", "dns_records", "whois_records", "tls_observations"}, new


def test_record_rollups_are_renewed(spark, monkeypatch):
    """With a refresh age of 0, records that arrive between micro-batches are seen."""
    src = scratch_path(spark, "landing_clock")
    req = spark.createDataFrame([(i, "https://late.example.com") for i in range(4)], "request_id long, url string") \
               .withColumn("ts", F.to_timestamp(F.lit("2024-01-30 00:00:00"))).withColumn("client_id", F.lit(1).cast("long"))
    req.select("request_id", "ts", "client_id", "url").repartition(4).write.parquet(src)
    reads = []

    def dns():
        reads.append(1)
        rows = [("late.example.com", "A", "10.0.0.1")] if len(reads) > 1 else []
        return spark.createDataFrame(rows, "domain string, rtype string, rdata string")

    sp = scratch_path(spark, "s_clock")
    st.scan_job_stream(st.request_stream(spark, src, max_files_per_trigger=1), sp, scratch_path(spark, "f_clock"),
                       scratch_path(spark, "ck_clock"), dns=dns, as_of=fx.AGES_AS_OF, refresh_s=0.0)
    seen = scan_job.read_scan_results(spark, sp, parse_features=True).select("features.dns_resolves").collect()
    assert len(reads) >= 2 and {r.dns_resolves for r in seen} == {True, False}


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="shared folder"):
        shared_dir(Session())
