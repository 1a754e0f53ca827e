"""Keyed streaming state and as-of joins against plain Python."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lurescope.operators import asof
from lurescope.session import scratch_path
from lurescope.streaming import reuse, scan_stream as st, windows

BASE = dt.datetime(2024, 1, 1)
REQUESTS = "request_id long, ts timestamp, client_id long, url string"


def _append(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _expected_reuse(rows):
    last, out = {}, []
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        domain = r[3][8:].split("/")[0]
        if domain not in last or (r[1] - last[domain][0]).total_seconds() >= 3600:
            last[domain] = (r[1], r[0])
        out.append((domain, r[0], r[1], last[domain][1], last[domain][0], last[domain][1] == r[0]))
    return sorted(out)


def test_reuse_window_across_batches_and_restarts(spark):
    """Out-of-order requests, ties, exactly 3,600 s, a restart between two drains; no state is left at the end."""
    reuse.state_store_conf(spark)
    rng = random.Random(4)
    rows = [(i, BASE + dt.timedelta(seconds=rng.randrange(0, 30_000)), 1, f"https://d{rng.randrange(3)}.example.com/{i}") for i in range(240)]
    rows += [(1000 + i, BASE + dt.timedelta(seconds=3600 * (i // 2)), 1, "https://exact.example.com") for i in range(12)]
    parts = [[r for r in rows if (r[1] - BASE).total_seconds() // 7600 == k] for k in range(4)]
    src, out, ck = (scratch_path(spark, f"reuse_{x}") for x in ("src", "out", "ck"))
    for half in (parts[:2], parts[2:] + [[(None, BASE + dt.timedelta(days=9), None, None)]]):
        for part in half:
            rng.shuffle(part)
            _append(spark, src, part, REQUESTS)
        stream = reuse.reuse_stream(st.request_stream(spark, src, 1), "20 minutes")
        q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination(300)
        assert q.exception() is None
    got = spark.read.parquet(out).collect()
    assert sorted((r.domain, r.request_id, r.ts, r.scan_id, r.scan_ts, r.fresh) for r in got) == _expected_reuse(rows)
    assert [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress][-1] == 0


def test_days_close_once_and_late_scans_are_kept(spark):
    reuse.state_store_conf(spark)
    rng = random.Random(6)
    schema = "id string, created_at timestamp, score int, confidence double, is_zero_day boolean"
    scans = [(f"s{i}", BASE + dt.timedelta(hours=rng.randrange(0, 200)), rng.choice([10, 40, 85]), rng.choice([None, 0.12, 0.85]), rng.random() < .3)
             for i in range(300)]
    order = sorted(scans, key=lambda r: r[1] + dt.timedelta(hours=rng.randrange(0, 70)))
    parts = [order[k:k + 75] for k in range(0, 300, 75)] + [[("beat", BASE + dt.timedelta(days=60), None, None, None)]]
    src, closed, late, ck = (scratch_path(spark, f"days_{x}") for x in ("src", "closed", "late", "ck"))
    mark, counted, kept = None, {}, []
    for part in parts:  # what the watermark of each micro-batch makes of its scans
        for s in part[:]:
            day = s[1].date()
            end = dt.datetime.combine(day, dt.time()) + dt.timedelta(days=1)
            if mark is not None and end <= mark:
                kept.append(s[0])
            elif s[0] != "beat":
                counted.setdefault(day, []).append(s)
        mark = max(mark or BASE - dt.timedelta(days=99), max(s[1] for s in part) - dt.timedelta(hours=12))
        _append(spark, src, part, schema)
        windows.write_closed_days(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), closed, late, ck, "12 hours")
    assert kept and sorted(r.id for r in spark.read.parquet(late).collect()) == sorted(kept)
    got = {r.day: r for r in windows.closed_day_stats(spark, closed).collect()}
    assert {d: r.scans for d, r in got.items()} == {d: len(s) for d, s in counted.items()}
    assert sum(r.scans for r in got.values()) + len(kept) == len(scans)
    for d, own in counted.items():
        known = [s[3] for s in own if s[3] is not None]
        assert got[d].threats == sum(s[2] >= 40 for s in own) and got[d].zero_day_count == sum(s[4] for s in own)
        assert got[d].avg_confidence == pytest.approx(100 * sum(known) / len(known) if known else 0.0, abs=0.0501)


def _expected_asof(left, right):
    out = []
    for key, t, i in left:
        seen = [r for r in right if r[0] == key and r[1] is not None and t is not None and r[1] <= t and key is not None]
        best = max(seen, key=lambda r: (r[1], r[2]), default=None)
        out.append((i, best and best[1], best and best[2]))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot_rows", [10 ** 9, 40, 3])
def test_asof_join_with_and_without_split_keys(spark, hot_rows):
    rng = random.Random(8)

    def time():
        return BASE + dt.timedelta(minutes=rng.randrange(0, 300)) if rng.random() > .05 else None

    def key():
        return rng.choice(["hot"] * 6 + ["a", "b", "none", None])

    left = [(key(), time(), i) for i in range(250)]
    right = [(k, time(), rng.randrange(5)) for k in (key() for _ in range(120)) if k != "none"]
    got = asof.asof_join(spark.createDataFrame(left, "k string, ts timestamp, i int").withColumn("_seen", F.lit(1)),
                         spark.createDataFrame(right, "k string, at timestamp, v int"), "k", "ts", "at", ["v"], hot_rows=hot_rows)
    assert sorted(((r.i, r.seen and r.seen["at"], r.seen and r.seen["v"]) for r in got.collect()), key=str) == _expected_asof(left, right)


def test_asof_join_without_rows(spark):
    left = spark.createDataFrame([("a", BASE, 1)], "k string, ts timestamp, i int")
    right = spark.createDataFrame([], "k string, at timestamp, m map<string,string>")
    assert [r.seen for r in asof.asof_join(left, right, "k", "ts", "at", ["m"]).collect()] == [None]
    assert asof.asof_join(left.limit(0), right, "k", "ts", "at", ["m"]).collect() == []


def test_asof_shuffles_once(spark):
    """The rows meet in one exchange by key; nothing is joined row against row."""
    left = spark.createDataFrame([("a", BASE, 1)], "k string, ts timestamp, i int")
    rights = {n: (spark.createDataFrame([("a", BASE, 1)], "k string, at timestamp, v int"), ["v"]) for n in "xyz"}
    plan = asof.asof_join_all(left, rights, "k", "ts", "at")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Window [") == 1
