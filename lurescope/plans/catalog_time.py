"""Named queries over time and commits: reuse window, point-in-time enrichment, closed days, the scan store."""

from __future__ import annotations

import datetime as dt
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.url import domain_key
from ..operators import asof, brand, scoring, tld
from ..session import materialize, scratch_path
from ..sources import dimensions, fixtures as fx
from ..sources.tables import read_json_requests, read_table
from ..streaming import reuse, scan_stream as st, windows
from . import catalog
from .scan_store import ScanStore

#: A time after all requests, at which a heartbeat lets the watermark pass them.
HEARTBEAT = dt.datetime(2024, 6, 1)
#: How late a request lands: up to half a day behind its neighbours, by a hash of its id.
DISORDER_S = 43_200
#: Slices of the time that requests arrive in: four, more from 40 million rows on (a slice is a micro-batch).
SLICES = 4
SLICE_ROWS = 10_000_000


def _land_in_order(spark: SparkSession, rows: DataFrame, time: str, key: str, heartbeat: DataFrame, name: str,
                   drain: Callable[[str], None], slices: int | None = None) -> str:
    """Rows that arrive in the order of a time with some disorder, then a heartbeat; ``drain(path)`` runs after each arrival.

    An arrival is one micro-batch whatever its files: taken a few files at a time, the first of
    them would move the watermark past rows of the others, the sooner the more tasks wrote them.
    """
    path, by_slice = scratch_path(spark, name), scratch_path(spark, f"{name}_slices")
    n = slices or max(SLICES, -(-rows.count() // SLICE_ROWS))
    arrives = F.unix_seconds(time) + F.pmod(F.xxhash64(key), F.lit(DISORDER_S))
    start = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    part = F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((arrives - start) / (31 * 86_400 / n))))
    rows.withColumn("_part", part.cast("int")).write.partitionBy("_part").parquet(by_slice)
    landed = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(by_slice)
    for k in range(n):
        landed.filter(F.col("_part") == k).drop("_part").write.mode("append").parquet(path)
        drain(path)
    heartbeat.write.mode("append").parquet(path)
    drain(path)
    return path


def q_stream_reuse_window(spark, sf_dir):
    """T-4: which scan answers each request, by a window of 3,600 s after a domain's last scan."""
    reuse.state_store_conf(spark)
    req = materialize(fx.scan_requests(spark, sf_dir), "reuse_requests")
    beat = spark.range(1).select(F.lit(None).cast("long").alias("request_id"), F.lit(HEARTBEAT).cast("timestamp").alias("ts"),
                                 F.lit(None).cast("long").alias("client_id"), F.lit(None).cast("string").alias("url"))
    out, ck = scratch_path(spark, "reuse"), scratch_path(spark, "reuse_ckpt")
    _land_in_order(spark, req, "ts", "request_id", beat, "reuse_landing", lambda src: st.run_available_now(
        reuse.reuse_stream(st.request_stream(spark, src), "1 day"), out, ck))
    rows = spark.read.parquet(out)
    return rows.select("request_id", "domain", F.col("ts").cast("timestamp_ntz").alias("ts"), "scan_id",
                       F.col("scan_ts").cast("timestamp_ntz").alias("scan_ts"), "fresh")


def q_stream_closed_days(spark, sf_dir):
    """T-3: statistics of closed days, and the scans that came after their day was closed."""
    reuse.state_store_conf(spark)
    scans = materialize(catalog.fixture_scans(spark, sf_dir).select("id", "created_at", "score", "confidence", "is_zero_day"), "closed_scans")
    beat = scans.limit(0).unionByName(spark.range(1).select(F.lit("heartbeat").alias("id"), F.lit(HEARTBEAT).cast("timestamp").alias("created_at")),
                                      allowMissingColumns=True)
    closed, late, ck = (scratch_path(spark, f"closed_{x}") for x in ("days", "late", "ckpt"))

    def drain(src: str) -> None:
        windows.write_closed_days(spark.readStream.schema(scans.schema).parquet(src), closed, late, ck, "1 day")

    src = _land_in_order(spark, scans, "created_at", "id", beat, "closed_landing", drain)
    # scans of the first week that turn up again after everything else: late, every one of them
    again = scans.filter(F.col("created_at") < F.lit(dt.datetime(2024, 1, 8)).cast("timestamp")).withColumn("id", F.concat(F.lit("again-"), "id"))
    again.write.mode("append").parquet(src)
    drain(src)
    n_late = spark.read.parquet(late).groupBy("day").agg(F.count(F.lit(1)).alias("late"))
    return windows.closed_day_stats(spark, closed).join(n_late, "day", "left").withColumn("late", F.coalesce("late", F.lit(0)))


def _histories(spark, sf_dir):
    hosts = materialize(fx.hosts(fx.scan_requests(spark, sf_dir)), "history_hosts")
    return fx.dns_history(hosts), fx.whois_history(hosts), fx.tls_history(hosts)


def q_enrich_point_in_time(spark, sf_dir):
    """What was known about the host when the request was made (a host of 200 rows and more is split by time)."""
    req = catalog.valid_requests(spark, sf_dir).select("request_id", "ts", domain_key(F.col("url")).alias("domain"))
    out = asof.enrich_at_request_time(materialize(req, "asof_requests"), *_histories(spark, sf_dir), hot_rows=200)
    return out.drop("ts")


# ---------------------------------------------------------------- scan store

def _store(spark, sf_dir, runs: int) -> ScanStore:
    """The fixture scans committed in ``runs`` runs (by day of the month), and a run that stopped before its commit."""
    scans = materialize(catalog.fixture_scans(spark, sf_dir), "store_scans")
    store = ScanStore(spark, scratch_path(spark, "store"))
    for k in range(runs):
        store.write_run(scans.filter(F.dayofmonth("created_at") % runs == k), f"run-{k}")
    # what a crash leaves behind: scans without a commit
    store._write(scans.limit(50).withColumn("run_id", F.lit("crashed")), "scans/segment=crashed.0", "created_date", "created_at", ["domain"])
    return store


def _scan_rows(store: ScanStore) -> DataFrame:
    feed = store.feed().select(F.col("scan_id").alias("f_id"), F.col("run_id").alias("f_run"))
    s = store.scans().select("id", "domain", "score", "verdict", "run_id", F.col("created_at").cast("timestamp_ntz").alias("created_at"))
    return s.join(feed, (F.col("id") == F.col("f_id")) & (F.col("run_id") == F.col("f_run")), "left") \
            .withColumn("in_feed", F.col("f_id").isNotNull()).drop("f_id", "f_run")


def q_store_commit(spark, sf_dir):
    """K3: scans and feed of the committed runs only; a run that is written again replaces its rows in both."""
    store = _store(spark, sf_dir, 3)
    again = store.scans().filter("run_id = 'run-1'").withColumn("score", F.lit(10)).drop("run_id", "created_date")
    store.write_run(materialize(again, "store_again"), "run-1")
    return _scan_rows(store)


def q_store_compacted(spark, sf_dir):
    """K1, K5: the same rows after compaction, a run that is committed after it, and a vacuum."""
    store = _store(spark, sf_dir, 5)
    store.compact(rows_per_file=2000)
    again = store.scans().filter("run_id = 'run-2'").withColumn("score", F.lit(10)).drop("run_id", "created_date")
    store.write_run(materialize(again, "store_again"), "run-2")
    store.compact(rows_per_file=2000)
    store.vacuum()
    return _scan_rows(store)


# ------------------------------------------------------- JSON requests, dictionaries

def q_json_requests(spark, sf_dir):
    """JSON lines, some of them cut off or of a wrong type; accepted + rejected + malformed = lines."""
    req = fx.scan_requests(spark, sf_dir)
    line = F.to_json(F.struct("request_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), "client_id", "url"))
    broken = (F.when(F.col("request_id") % 20 == 0, F.expr("left(line, length(line) - 9)"))
               .when(F.col("request_id") % 31 == 0, F.regexp_replace("line", '"request_id":[0-9]+', '"request_id":"none"'))
               .when(F.col("request_id") % 37 == 0, F.regexp_replace("line", '"url":"[^"]*"', '"url":"  "')).otherwise(F.col("line")))
    path = scratch_path(spark, "json_requests")
    req.withColumn("line", line).select(broken.alias("value")).write.text(path)
    v = scoring.validate_json(read_json_requests(spark, path))
    return v.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("request_id").alias("ids"))


def q_stream_json_requests(spark, sf_dir):
    """S1 in the stream: malformed lines go to the quarantine with their text."""
    req = fx.scan_requests(spark, sf_dir)
    line = F.to_json(F.struct("request_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), "client_id", "url"))
    path = scratch_path(spark, "json_stream")
    req.select(F.when(F.col("request_id") % 20 == 0, F.concat(F.lit("{cut "), line)).otherwise(line).alias("value")).write.text(path)
    out = {k: scratch_path(spark, f"json_{k}") for k in ("scans", "feed", "rejects", "ckpt")}
    st.scan_job_stream(read_json_requests(spark, path, stream=True, max_files_per_trigger=4), out["scans"], out["feed"], out["ckpt"],
                       as_of=fx.AGES_AS_OF, quarantine_path=out["rejects"])
    ok = spark.read.parquet(out["scans"]).select(F.lit("accepted").alias("outcome"), F.lit(0).alias("text"))
    bad = spark.read.parquet(out["rejects"]).select(F.col("reject_reason").alias("outcome"), F.col("_corrupt").startswith("{cut ").cast("int").alias("text"))
    return ok.union(bad).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("text").alias("with_text"))


def _json_file(spark, entries: DataFrame, name: str) -> str:
    """One JSON object of the ``(key, value)`` rows, as a dictionary file has it (as many entries as the dictionary)."""
    path = scratch_path(spark, name)
    body = entries.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), "key", F.lit('":'), "value"))), ",").alias("b"))
    body.select(F.concat(F.lit("{"), "b", F.lit("}")).alias("value")).coalesce(1).write.text(path)
    return path


def q_brand_score_file(spark, sf_dir):
    """A brand dictionary read from its JSON file."""
    kws = catalog._page_dictionary(spark, sf_dir)
    lists = kws.groupBy("brand").agg(F.to_json(F.array_sort(F.collect_list("keyword"))).alias("value")).withColumnRenamed("brand", "key")
    path = _json_file(spark, lists, "brand_file")
    return catalog._brand_view(brand.brand_features(catalog.request_domains(spark, sf_dir), keywords=dimensions.read_brand_dictionary(spark, path)))


def q_tld_risk_file(spark, sf_dir):
    """S3: a suffix table read from its JSON file."""
    two = F.regexp_extract(F.regexp_extract("url", "^https?://([^/]*)", 1), "([a-z]+[.][a-z]+)$", 1).alias("key")
    own = read_table(spark, sf_dir, "pages").select(two).filter("key <> '' and key <> 'example.org'").distinct()
    rows = own.select("key", (F.length("key") / 100.0).cast("string").alias("value")).union(spark.range(1).select(F.lit("org"), F.lit("0.75")))
    path = _json_file(spark, rows, "tld_file")
    return tld.with_tld_risk(catalog.request_domains(spark, sf_dir), suffixes=dimensions.read_tld_table(spark, path))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "stream_reuse_window": q_stream_reuse_window,
    "stream_closed_days": q_stream_closed_days,
    "enrich_point_in_time": q_enrich_point_in_time,
    "store_commit": q_store_commit,
    "store_compacted": q_store_compacted,
    "json_requests": q_json_requests,
    "stream_json_requests": q_stream_json_requests,
    "brand_score_file": q_brand_score_file,
    "tld_risk_file": q_tld_risk_file,
}
