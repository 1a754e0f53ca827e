"""Structured Streaming twins of the batch job (T-1 ... T-4).

The same column functions as batch; the request side is only ever touched
row-locally, through stream-static joins (record rollups, fixed dimensions) or
per micro-batch.  Daily stats and one scan per domain and hour are merged from
the partial results of the micro-batches, so no row is dropped as too late.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import py_round
from ..operators import scoring
from ..plans import scan_job
from ..session import delete_path, scratch_path, scratch_scope
from ..sources import fixed_values as FV
from ..sources.tables import CORRUPT, SCAN_REQUEST_SCHEMA


def request_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """S1 (stream): Parquet files landing in ``path``."""
    r = spark.readStream.schema(SCAN_REQUEST_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def scan_stream(requests: DataFrame, dns=None, whois=None, tls_obs=None, as_of=None, category_rules=None,
                zero_day: Column | None = None, scorer=scoring.rule_scorer, suffixes: DataFrame | None = None) -> DataFrame:
    """T-1: validate -> row-local features -> score -> scan rows (a pure streaming
    plan; rejected requests are the job's quarantine, see ``scan_job_stream``)."""
    ok = scoring.accepted(scoring.validate(requests))
    return scoring.scan_results(ok, dns, whois, tls_obs, as_of, category_rules, zero_day,
                                scorer=scorer, rowlocal=True, suffixes=suffixes)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that the query keeps in its checkpoint: the same after a restart, another with another checkpoint."""
    meta = spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0]
    return json.loads(meta)["id"]


def _drain(stream: DataFrame, run_batch, checkpoint: str, available_now: bool, timeout_s: int | None):
    w = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    q = w.start()
    if available_now:
        q.awaitTermination(timeout_s)
        if q.exception() is not None:
            raise q.exception()
    return q


def scan_job_stream(requests: DataFrame, scans_path: str | None, feed_path: str | None, checkpoint: str, dns=None,
                    whois=None, tls_obs=None, as_of=None, category_rules=None,
                    zero_day_fn=None, scorer=scoring.rule_scorer, available_now: bool = True,
                    timeout_s: int | None = None, quarantine_path: str | None = None,
                    medium: int = FV.MEDIUM_RISK_THRESHOLD, refresh_s: float = 3600.0, blacklist=None,
                    keywords: DataFrame | None = None, suffixes: DataFrame | None = None, store=None):
    """T-1 + T-2 with the batch plan per micro-batch (``foreachBatch``).

    Each micro-batch is a static DataFrame, so it gets the batch plan: the
    features are computed once per distinct domain of the batch, not per
    request.  The batch is written to the sinks of the batch job under the run id
    ``<query id>-<batch id>``: a retried batch replaces its own rows
    (exactly-once), and a stream with another checkpoint appends its own.
    Rejected requests go to ``quarantine_path``.  ``keywords`` / ``suffixes``: the
    custom dictionaries of the batch job.  ``store``: a ``ScanStore`` that each
    micro-batch commits to, instead of the two paths.

    The record tables are rolled up into one written table that every micro-batch
    joins; it is renewed after ``refresh_s`` seconds (ages as of then, if ``as_of``
    is not fixed, and new records, if the tables are given as functions that read
    them).  The intermediate tables of a micro-batch
    are deleted when it is written.
    """
    from ..operators.enrich import record_rollups
    spark = requests.sparkSession
    facts = {"at": None, "table": None, "path": None}

    def rollups():
        if facts["at"] is None or time.monotonic() - facts["at"] >= refresh_s:
            # a reader function lists the table's files anew; a DataFrame keeps the files it was made with
            fresh = record_rollups(*[x() if callable(x) else x for x in (dns, whois, tls_obs)], as_of)
            old = facts["path"]
            if fresh is not None:
                path = scratch_path(spark, "record_rollups")
                fresh.write.parquet(path)
                facts.update(table=spark.read.parquet(path), path=path)
            facts["at"] = time.monotonic()
            if old:
                delete_path(spark, old)
        return facts["table"]

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        run_id = f"{stream_id(spark, checkpoint)}-{batch_id}"
        batch.persist()
        try:
            with scratch_scope(spark):
                v = scoring.validate_json(batch) if CORRUPT in batch.columns else scoring.validate(batch)
                flag = zero_day_fn(F.col("request_id")) if zero_day_fn is not None else None
                scans = scoring.scan_results(scoring.accepted(v).drop(CORRUPT), None, None, None, as_of, category_rules, flag,
                                             blacklist=blacklist, scorer=scorer, rollups=rollups(),
                                             keywords=keywords, suffixes=suffixes)
                if store is not None:
                    store.write_run(scans, run_id, medium)
                else:
                    scan_job.write_run(spark, scans, scans_path, feed_path, run_id, medium)
                if quarantine_path:
                    scan_job.write_quarantine(scoring.rejected(v), quarantine_path, run_id)
        finally:
            batch.unpersist()

    q = _drain(requests, run_batch, checkpoint, available_now, timeout_s)
    if available_now and facts["path"]:
        delete_path(spark, facts["path"])
    return q


def partials_stream(stream: DataFrame, partial, path: str, checkpoint: str, available_now: bool = True,
                    timeout_s: int | None = None):
    """Write ``partial(batch)`` of each micro-batch under its own run id.

    For figures that merge (counts, sums, minima): the reader merges the
    partials, so open periods and late or out-of-order rows are always
    included, there is no state to bound, and a retried batch replaces its own
    partial.  A micro-batch adds at most a row per group.
    """
    spark = stream.sparkSession

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        partial(batch).write.mode("overwrite").parquet(
            scan_job.run_path(path, f"{stream_id(spark, checkpoint)}-{batch_id}"))

    return _drain(stream, run_batch, checkpoint, available_now, timeout_s)


def feed_stream(scans: DataFrame) -> DataFrame:
    """T-2: the live threat feed (score >= 40) of a scan stream."""
    return scoring.threat_feed(scans)


def daily_partial(scans: DataFrame, medium: int = FV.MEDIUM_RISK_THRESHOLD) -> DataFrame:
    """T-3, per batch and UTC day: counts and the exact sum of the confidence."""
    return scans.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count_if(F.col("score") >= medium).alias("threats"), F.count("confidence").alias("n"),
        F.sum(F.col("confidence").cast("decimal(30,15)")).alias("confidence"),
        F.count_if("is_zero_day").alias("zero_day_count"))


def daily_stats(spark: SparkSession, path: str) -> DataFrame:
    """T-3: per UTC day (today and late days included) feed-worthy scans, average confidence x100, zero-day scans."""
    g = spark.read.parquet(path).groupBy("day").agg(
        F.sum("threats").alias("threats"), F.sum("n").alias("_n"), F.sum("confidence").alias("_c"),
        F.sum("zero_day_count").alias("zero_day_count"))
    mean = F.when(F.col("_n") > 0, F.col("_c").cast("double") / F.col("_n")).otherwise(0.0)
    return g.select("day", F.col("threats").cast("long").alias("threats"),
                    py_round(mean * F.lit(100.0), 1).alias("avg_confidence"),
                    F.col("zero_day_count").cast("long").alias("zero_day_count"))


def first_scan_partial(requests: DataFrame, ts_col: str = "ts") -> DataFrame:
    """T-4, per batch: the first valid request of each (domain, UTC hour), by (time, request_id)."""
    from ..functions.url import domain_key
    ok = scoring.accepted(scoring.validate(requests)).withColumn("domain", domain_key(F.col("url")))
    return ok.groupBy("domain", F.date_trunc("hour", F.col(ts_col).cast("timestamp")).alias("hour")) \
             .agg(F.min(F.struct(F.col(ts_col).alias("ts"), "request_id")).alias("first"))


def first_scans(spark: SparkSession, path: str) -> DataFrame:
    """T-4: one scan per domain and hour over all batches: ``domain, hour, request_id, ts``."""
    g = spark.read.parquet(path).groupBy("domain", "hour").agg(F.min("first").alias("first"))
    return g.select("domain", "hour", "first.request_id", "first.ts")


def run_available_now(df: DataFrame, path: str, checkpoint: str, mode: str = "append",
                      fmt: str = "parquet", timeout_s: int | None = None) -> None:
    """Drain everything available into ``path`` (exactly-once file sink) and stop."""
    q = (df.writeStream.format(fmt).outputMode(mode)
           .option("path", path).option("checkpointLocation", checkpoint)
           .trigger(availableNow=True).start())
    q.awaitTermination(timeout_s)
    if q.exception() is not None:
        raise q.exception()
