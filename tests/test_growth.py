"""What must not grow faster than the input: work per row, rows per task, micro-batches, bytes per file."""
import datetime as dt

from pyspark.sql import functions as F

from lurescope.operators import brand, features
from lurescope.plans import catalog, catalog_time, scan_job
from lurescope.plans.scan_store import ScanStore
from lurescope.session import delete_path, file_count, scratch_path
from lurescope.streaming import reuse, scan_stream as st, windows

BASE = dt.datetime(2024, 1, 1)
SCAN = "id string, domain string, url string, score int, verdict string, category string, created_at timestamp, is_zero_day boolean, confidence double"


def _scans(spark, n):
    rows = spark.range(n).select(F.format_string("%08d", "id").alias("id"), F.concat(F.lit("d"), F.col("id") % 7).alias("domain"),
                                 F.lit("https://x").alias("url"), F.when(F.col("id") % 2 == 0, 85).otherwise(12).alias("score"),
                                 F.lit("SAFE").alias("verdict"), F.lit("generic").alias("category"),
                                 (F.lit(BASE).cast("timestamp") + F.make_dt_interval((F.col("id") % 5).cast("int"))).alias("created_at"),
                                 (F.col("id") % 10 == 0).alias("is_zero_day"), F.lit(0.5).alias("confidence"))
    have = set(rows.columns)
    return rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in scan_job.SCAN_RESULTS_SCHEMA.fields
                              if f.name not in have | {"run_id", "created_date"}])


def test_rowlocal_brand_hits_are_computed_once_a_row(spark):
    """One edit distance to filter and one for the hits, not a pair for each brand column."""
    df = spark.createDataFrame([("secure-sbi-login.paypa1.com",), ("x" * 40 + ".org",), ("",), (None,)], "domain string")
    got = brand.brand_features_rowlocal(df)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("levenshtein(") == 2
    want = brand.brand_features(df.filter("domain is not null")).select(got.columns)
    assert sorted(map(str, got.filter("domain is not null").collect())) == sorted(map(str, want.collect()))


def test_landing_has_a_file_for_every_core(spark, tmp_path):
    spark.range(400).select(F.col("id").alias("event_id"), F.lit(BASE).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"),
                            F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(40).select(F.col("id").alias("page_id"), F.lit("https://a.example.com/1").alias("url"), F.lit("").alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    path = catalog._landed_requests(spark, str(tmp_path))
    assert len(spark.read.parquet(path).inputFiles()) == 2 * max(2, spark.sparkContext.defaultParallelism)
    assert spark.read.parquet(path).count() == 400


def test_join_back_bounds_the_rows_of_a_task(spark, monkeypatch):
    """A domain of half of all requests, far below the hot threshold, is not one task."""
    monkeypatch.setattr(features, "TASK_ROWS", 100, raising=False)
    req = spark.range(4000).select(F.col("id").alias("request_id"), F.when(F.col("id") % 2 == 0, "hot.example").otherwise(
        F.concat(F.lit("d"), F.col("id") % 500)).alias("domain"))
    counts = req.groupBy("domain").agg(F.count(F.lit(1)).alias("_n"))
    j = features.join_back_salted(req, counts.withColumn("known", F.lit(1)), counts)
    per_task = j.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("known")).collect()
    assert sum(r.n for r in per_task) == sum(r.known for r in per_task) == 4000
    assert max(r.n for r in per_task) <= 400


def test_no_request_is_dropped_however_many_files_arrive(spark):
    reuse.state_store_conf(spark)
    rows = spark.range(800).select(F.col("id").alias("request_id"), (F.lit(BASE).cast("timestamp") + F.make_dt_interval(
        mins=(F.col("id") * 53 % 44_000).cast("int"))).alias("ts"), F.lit(1).cast("long").alias("client_id"),
        F.concat(F.lit("https://d"), F.col("id") % 3, F.lit(".example.com/")).alias("url")).repartition(8)
    beat = spark.range(1).select(F.lit(None).cast("long").alias("request_id"), F.lit(catalog_time.HEARTBEAT).cast("timestamp").alias("ts"),
                                 F.lit(None).cast("long").alias("client_id"), F.lit(None).cast("string").alias("url"))
    out, ck, drains = scratch_path(spark, "all_out"), scratch_path(spark, "all_ck"), []

    def drain(src):
        drains.append(src)
        st.run_available_now(reuse.reuse_stream(st.request_stream(spark, src), "1 day"), out, ck)

    catalog_time._land_in_order(spark, rows, "ts", "request_id", beat, "all_landing", drain, slices=3)
    assert len(drains) == 4
    assert sorted(r.request_id for r in spark.read.parquet(out).select("request_id").collect()) == list(range(800))


def test_no_day_closes_early_however_many_files_arrive(spark):
    reuse.state_store_conf(spark)
    scans = spark.range(800).select(F.format_string("s%d", "id").alias("id"), (F.lit(BASE).cast("timestamp") + F.make_dt_interval(
        mins=(F.col("id") * 53 % 44_000).cast("int"))).alias("created_at"), F.lit(85).alias("score"), F.lit(0.85).alias("confidence"),
        F.lit(False).alias("is_zero_day")).repartition(8)
    beat = scans.limit(0).unionByName(spark.range(1).select(F.lit("beat").alias("id"), F.lit(catalog_time.HEARTBEAT).cast("timestamp").alias(
        "created_at")), allowMissingColumns=True)
    closed, late, ck = (scratch_path(spark, f"early_{x}") for x in ("closed", "late", "ck"))
    catalog_time._land_in_order(spark, scans, "created_at", "id", beat, "early_landing", lambda src: windows.write_closed_days(
        spark.readStream.schema(scans.schema).parquet(src), closed, late, ck, "1 day"), slices=3)
    assert spark.read.parquet(late).count() == 0
    assert sum(r.scans for r in windows.closed_day_stats(spark, closed).collect()) == 800


def test_small_files_have_small_bloom_filters(spark):
    root = scratch_path(spark, "small_store")
    store = ScanStore(spark, root)
    store.write_run(_scans(spark, 300), "a")
    store.compact(rows_per_file=20)
    sp, fp = scratch_path(spark, "small_scans"), scratch_path(spark, "small_feed")
    scan_job.write_run(spark, _scans(spark, 300), sp, fp, "a")
    for path in (root, sp, fp):
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
        assert size < 40_000 * file_count(spark, path)
    assert scan_job.read_scan_results(spark, sp).filter("id = '00000042'").count() == 1
    assert store.scans().count() == 300 and store.feed().count() == 150


def test_daily_statistics_read_many_files_in_few_batches(spark, monkeypatch):
    path = scratch_path(spark, "many_files")
    scan_job.write_scan_results(_scans(spark, 600).repartition(40), path, "a")
    assert len(spark.read.parquet(path).inputFiles()) > 100
    batches, plain = [], st.daily_partial
    monkeypatch.setattr(catalog, "_stream_tables", lambda spark, sf_dir: (path, None))
    monkeypatch.setattr(st, "daily_partial", lambda batch: batches.append(1) or plain(batch))
    got = catalog.q_stream_daily_stats(spark, "unused").collect()
    assert 2 <= len(batches) <= 8
    assert sum(r.threats for r in got) == 300 and sum(r.zero_day_count for r in got) == 60
    delete_path(spark, path)
