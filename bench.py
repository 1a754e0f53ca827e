"""Benchmark the headline queries; prints ONE JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)

Each query is planned, then forced to completion with the ``noop`` sink (the
whole plan runs, nothing is collected to the driver).  Untimed warm-up: the
flagship feature/scan pipeline once on the smallest tables (sf0.001), so JIT
and generated-code caches are loaded and the timings are steady-state.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "url_lexical", "brand_score", "brand_score_rowlocal", "tld_risk", "idn_homograph",
    "dns_rollup", "whois_derive", "tls_derive", "feature_vector", "scan_results",
    "threat_feed", "scan_job_write", "feed_page", "feed_page_category", "daily_stats",
    "scan_by_id", "incident_report", "stream_scan",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from lurescope.plans import catalog
    from lurescope.session import get_session

    spark = get_session(f"local[{cpus}]", app_name="lurescope-bench", shuffle_partitions=cpus,
                        extra={"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    qs = catalog.queries()

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):  # warm-up, untimed
        for name in ("url_lexical", "brand_score", "scan_results", "threat_feed"):
            run(qs[name](spark, warm_dir))

    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        if name == "scan_job_write":
            catalog.scan_tables(spark, sf_dir)  # validate + features + score + both sinks
        else:
            run(qs[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - t0, 3)

    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_queries_total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
