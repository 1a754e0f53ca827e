"""Custom dictionaries reach the row-local form and the stream job, or are refused."""
import json

import pytest
from pyspark.sql import functions as F

from lurescope.operators import scoring
from lurescope.plans import jobs
from lurescope.session import scratch_path
from lurescope.sources import dimensions as dims

URLS = ["https://sbi-login.com/a", "http://zorbex-pay.qqq/x", "http://z0rbex.org/", "https://plain.org/"]


def _requests(spark):
    return spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "request_id long, url string") \
                .select("request_id", F.to_timestamp(F.lit("2024-01-02 03:04:05")).alias("ts"),
                        F.lit(1).cast("long").alias("client_id"), "url")


def _files(tmp_path):
    brands, tlds = tmp_path / "brands.json", tmp_path / "tlds.json"
    brands.write_text(json.dumps({"Zorbex": ["zorbex"]}))
    tlds.write_text(json.dumps({"qqq": 0.9, "org": 0.3}))
    return str(brands), str(tlds)


def _features(scans):
    return sorted((r.url, r.features_json, r.closest_brand) for r in scans.select("url", "features_json", "closest_brand").collect())


def test_rowlocal_takes_suffixes_and_refuses_keywords(spark, tmp_path):
    brands, tlds = _files(tmp_path)
    ok = scoring.accepted(scoring.validate(_requests(spark)))
    suffixes = dims.read_tld_table(spark, tlds)
    got = _features(scoring.scan_results(ok, rowlocal=True, suffixes=suffixes))
    assert got == _features(scoring.scan_results(ok, suffixes=suffixes))
    assert got != _features(scoring.scan_results(ok, rowlocal=True))
    with pytest.raises(ValueError, match="keywords"):
        scoring.scan_results(ok, rowlocal=True, keywords=dims.read_brand_dictionary(spark, brands))


def test_stream_job_uses_the_dictionaries(spark, tmp_path):
    brands, tlds = _files(tmp_path)
    req = scratch_path(spark, "dict_requests")
    _requests(spark).write.parquet(req)
    out = {}
    for mode in ("batch", "stream"):
        to = {k: scratch_path(spark, f"dict_{mode}_{k}") for k in ("scans", "feed", "ck")}
        a = jobs._args([mode, "--requests", req, "--scans", to["scans"], "--feed", to["feed"], "--checkpoint", to["ck"],
                        "--once", "--as-of", "2024-01-31T00:00:00", "--brands", brands, "--tlds", tlds])
        (jobs.run_batch if mode == "batch" else jobs.run_stream)(spark, a)
        out[mode] = _features(spark.read.parquet(to["scans"]))
    assert out["stream"] == out["batch"] and len(out["batch"]) == len(URLS)
    assert "Zorbex" in {r[2] for r in out["stream"]}
