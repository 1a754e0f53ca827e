"""The spark-submit entry points, run in-process on written fixture tables."""
from lurescope.plans import catalog, jobs
from lurescope.session import scratch_path
from lurescope.sources import fixtures as fx
from conftest import SF_SMALL


def _inputs(spark):
    paths = {k: scratch_path(spark, k) for k in ("requests", "dns", "whois", "tls")}
    req = fx.scan_requests(spark, SF_SMALL)
    bad = spark.createDataFrame([(10**9, None, 1, "   "), (10**9 + 1, None, 1, "x" * 600)],
                                "request_id long, ts timestamp, client_id long, url string")
    req.unionByName(bad).write.parquet(paths["requests"])
    dns, who, tls = catalog._records(spark, SF_SMALL)
    dns.write.parquet(paths["dns"])
    who.write.parquet(paths["whois"])
    tls.write.parquet(paths["tls"])
    return paths


def test_batch_job(spark):
    p = _inputs(spark)
    out = {k: scratch_path(spark, k) for k in ("scans", "feed", "quarantine")}
    argv = ["batch", "--requests", p["requests"], "--dns", p["dns"], "--whois", p["whois"], "--tls", p["tls"],
            "--scans", out["scans"], "--feed", out["feed"], "--quarantine", out["quarantine"],
            "--as-of", "2024-01-31T00:00:00"]
    a = jobs._args(argv)
    a.run_id = jobs.run_batch(spark, a)
    jobs.run_batch(spark, a)                                  # a repeated run id replaces the run
    scans = spark.read.parquet(out["scans"])
    assert scans.count() == catalog.valid_requests(spark, SF_SMALL).count()
    assert spark.read.parquet(out["feed"]).count() == scans.filter("score >= 40").count()
    q = {r.reject_reason for r in spark.read.parquet(out["quarantine"]).collect()}
    assert q == {"empty", "too_long"}


def test_stream_job_once(spark):
    p = _inputs(spark)
    out = {k: scratch_path(spark, k) for k in ("sscans", "sfeed", "sck")}
    a = jobs._args(["stream", "--requests", p["requests"], "--dns", p["dns"], "--whois", p["whois"],
                    "--tls", p["tls"], "--scans", out["sscans"], "--feed", out["sfeed"],
                    "--checkpoint", out["sck"], "--once", "--as-of", "2024-01-31T00:00:00"])
    jobs.run_stream(spark, a)
    assert spark.read.parquet(out["sscans"]).count() == catalog.valid_requests(spark, SF_SMALL).count()
