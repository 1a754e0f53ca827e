"""spark-submit entry points: the batch scan job and the streaming scan job.

    spark-submit --py-files lurescope.zip run_job.py batch --requests R --dns D --whois W --tls T \
        --scans OUT/scan_results --feed OUT/threat_feed --quarantine OUT/quarantine --work-dir SHARED [--as-of ISO]
    spark-submit --py-files lurescope.zip run_job.py stream --requests R ... --checkpoint CK --work-dir SHARED [--once]
    spark-submit --py-files lurescope.zip run_job.py compact --store STORE

Inputs are Parquet tables with the schemas in ``sources.tables``; outputs are
the ``run_id=/created_date=`` sinks of ``scan_job``.  Every run appends; only a
run that is given the id of an earlier one (``--run-id``) replaces that one.  With
``--store`` both tables are committed together (``scan_store``).
"""

from __future__ import annotations

import argparse
import datetime as dt
import functools
import sys

from pyspark.sql import DataFrame, SparkSession

from ..operators import blacklist, fitted, scoring
from ..session import apply_job_conf, scratch_scope
from ..sources import fixed_values as FV
from ..sources import dimensions, tables
from ..streaming import scan_stream
from . import scan_job
from .scan_store import ScanStore


def _args(argv):
    p = argparse.ArgumentParser(prog="lurescope.plans.jobs")
    p.add_argument("mode", choices=["batch", "stream", "compact"])
    p.add_argument("--requests")
    p.add_argument("--json", action="store_true", help="requests are JSON lines; malformed ones go to the quarantine")
    p.add_argument("--store", help="scan store to commit to (scans and feed become visible together) instead of --scans and --feed")
    p.add_argument("--dns")
    p.add_argument("--whois")
    p.add_argument("--tls")
    p.add_argument("--scans")
    p.add_argument("--feed")
    p.add_argument("--quarantine")
    p.add_argument("--checkpoint", help="stream checkpoint location (shared storage)")
    p.add_argument("--as-of", help="ISO instant for ages / expiry (default: now)")
    p.add_argument("--once", action="store_true", help="stream: process what is there, then stop")
    p.add_argument("--max-files-per-trigger", type=int)
    p.add_argument("--work-dir", help="folder that driver and executors share, for intermediate tables "
                                      "(default: spark.checkpoint.dir)")
    p.add_argument("--run-id", help="batch: id of the run; a repeated id replaces that run (default: a new one)")
    p.add_argument("--blacklist", help="Parquet table of known domains (column domain): others are zero-day")
    p.add_argument("--blacklist-parents", action="store_true", help="a listed domain also covers the hosts below it")
    p.add_argument("--model", help="saved pipeline (operators.fitted) that scores instead of the rule score")
    p.add_argument("--brands", help="JSON brand dictionary instead of the built-in one")
    p.add_argument("--tlds", help="JSON suffix risk table instead of the built-in one")
    p.add_argument("--high", type=int, default=FV.HIGH_RISK_THRESHOLD, help="score from which a verdict is PHISHING")
    p.add_argument("--medium", type=int, default=FV.MEDIUM_RISK_THRESHOLD,
                   help="score from which a verdict is SUSPICIOUS and the feed gets the scan")
    p.add_argument("--shuffle-partitions", type=int,
                   help="shuffle partitions (about input bytes / 200 MB; Spark's default of 200 suits small inputs)")
    p.add_argument("--refresh-seconds", type=float, default=3600.0, help="stream: age at which record rollups are renewed")
    a = p.parse_args(argv)
    if a.mode == "compact" and not a.store:
        p.error("compact needs --store")
    if a.mode != "compact" and not (a.requests and (a.store or a.scans and a.feed)):
        p.error("--requests, and --store or both --scans and --feed, are required")
    return a


def _records(spark: SparkSession, a):
    dns = tables.read_dns_records(spark, a.dns) if a.dns else None
    who = tables.read_whois_records(spark, a.whois) if a.whois else None
    tls = tables.read_tls_observations(spark, a.tls) if a.tls else None
    return dns, who, tls


def _scorer(a):
    if a.model:
        return fitted.LinearScorer.load(a.model, high=a.high, medium=a.medium)
    return functools.partial(scoring.rule_scorer, high=a.high, medium=a.medium)


def _blacklist(spark: SparkSession, a) -> DataFrame | blacklist.Screen | None:
    if not a.blacklist:
        return None
    table = spark.read.parquet(a.blacklist)
    return blacklist.screen(table) if a.blacklist_parents else table


def _dictionaries(spark: SparkSession, a) -> dict[str, DataFrame | None]:
    return {"keywords": dimensions.read_brand_dictionary(spark, a.brands) if a.brands else None,
            "suffixes": dimensions.read_tld_table(spark, a.tlds) if a.tlds else None}


def run_batch(spark: SparkSession, a) -> str:
    as_of = dt.datetime.fromisoformat(a.as_of) if a.as_of else None
    dns, who, tls = _records(spark, a)
    run_id = a.run_id or scan_job.new_run_id()
    with scratch_scope(spark):
        read = tables.read_json_requests if a.json else tables.read_scan_requests
        out = scan_job.run_scan(read(spark, a.requests), dns, who, tls, as_of,
                                blacklist=_blacklist(spark, a), scorer=_scorer(a), medium=a.medium,
                                **_dictionaries(spark, a))
        # the feed is derived from what the run has just written: one source of truth
        if a.store:
            ScanStore(spark, a.store).write_run(out.scans, run_id, a.medium)
        else:
            scan_job.write_run(spark, out.scans, a.scans, a.feed, run_id, a.medium)
        if a.quarantine:
            scan_job.write_quarantine(out.quarantine, a.quarantine, run_id)
    return run_id


def run_stream(spark: SparkSession, a):
    if not a.checkpoint:
        raise SystemExit("--checkpoint is required for the stream job")
    as_of = dt.datetime.fromisoformat(a.as_of) if a.as_of else None
    # read anew at each refresh
    dns = (lambda: tables.read_dns_records(spark, a.dns)) if a.dns else None
    who = (lambda: tables.read_whois_records(spark, a.whois)) if a.whois else None
    tls = (lambda: tables.read_tls_observations(spark, a.tls)) if a.tls else None
    req = (tables.read_json_requests(spark, a.requests, True, a.max_files_per_trigger) if a.json
           else scan_stream.request_stream(spark, a.requests, a.max_files_per_trigger))
    q = scan_stream.scan_job_stream(req, a.scans, a.feed, a.checkpoint, dns, who, tls, as_of,
                                    available_now=a.once, scorer=_scorer(a), medium=a.medium,
                                    quarantine_path=a.quarantine, refresh_s=a.refresh_seconds,
                                    blacklist=_blacklist(spark, a), store=ScanStore(spark, a.store) if a.store else None,
                                    **_dictionaries(spark, a))
    if not a.once:
        q.awaitTermination()
    return q


def run_compact(spark: SparkSession, a) -> None:
    """Rewrite the store clustered, and delete what no reader needs (not while a run is being written)."""
    store = ScanStore(spark, a.store)
    store.compact()
    store.vacuum()


def main(argv=None) -> None:
    a = _args(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName(f"lurescope-{a.mode}").getOrCreate()
    apply_job_conf(spark)
    if a.work_dir:
        spark.sparkContext.setCheckpointDir(a.work_dir)
    if a.shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", a.shuffle_partitions)
    if a.mode == "batch":
        run_batch(spark, a)
    elif a.mode == "compact":
        run_compact(spark, a)
    else:
        run_stream(spark, a)


if __name__ == "__main__":
    main()
