"""Dictionary files read with Spark give the same results as the
built-in fixed tables."""
import json
import os
import tempfile

from pyspark.sql import functions as F

from lurescope.operators import brand, tld
from lurescope.sources import dimensions as dims
from lurescope.sources import fixed_values as FV

DOMAINS = ["sbi-hdfc-alert.info", "sb1-login.com", "wikipedia.org", "www.onlinesbi.com", "amazon.in",
           "hdfcbank-kyc.top", "incometax9.gov.in", "ic1ci.co.in", "a.b.c.example.co.uk"]


def _write(obj):
    d = tempfile.mkdtemp(prefix="lurescope-dict-")
    p = os.path.join(d, "t.json")
    with open(p, "w", encoding="utf-8") as f:
        json.dump(obj, f, ensure_ascii=False)
    return p


def test_brand_dictionary_file_matches_builtin(spark):
    kw = dims.read_brand_dictionary(spark, _write(FV.BRAND_KEYWORDS))
    assert kw.count() == 85 and kw.select("brand").distinct().count() == 63
    d = spark.createDataFrame([(x,) for x in DOMAINS], "domain string")
    a = brand.brand_features(d).select("domain", *brand.BRAND_COLUMNS)
    b = brand.brand_features(d, keywords=kw).select("domain", *brand.BRAND_COLUMNS)
    assert sorted(a.collect()) == sorted(b.collect())


def test_custom_path_equals_the_fixed_one(spark):
    kw = dims.read_brand_dictionary(spark, _write(FV.BRAND_KEYWORDS))
    d = spark.createDataFrame([(x,) for x in DOMAINS], "domain string")
    fixed = sorted(brand.keyword_hits(d).collect())
    custom = sorted(brand.keyword_hits(d, keywords=kw).collect())
    assert fixed == custom and len(custom) > 0
    cols = ["domain", "pos", "token", "brand", "keyword", "distance", "weight"]
    assert sorted(brand.typosquat_hits(d).select(cols).collect()) == sorted(brand.typosquat_hits(d, keywords=kw).select(cols).collect())


def test_repeated_and_empty_keywords(spark):
    kw = spark.createDataFrame([("A", "sbi", 3, 0), ("A", "sbi", 3, 1), ("B", "", 0, 2), ("C", "zzzz", 4, 3)],
                               "brand string, keyword string, kw_len int, ord long")
    d = spark.createDataFrame([("sbi-sbi.com",), ("plain.org",)], "domain string")
    got = sorted(map(tuple, brand.keyword_hits(d, keywords=kw).collect()))
    assert got == [("plain.org", "B", ""), ("sbi-sbi.com", "A", "sbi"), ("sbi-sbi.com", "A", "sbi"), ("sbi-sbi.com", "B", "")]


def test_deletions_cover_edit_distance_two(spark):
    pairs = [("paytm", "paytn"), ("abcd", "bcde"), ("sbi", "sbix1"), ("abc", "abc"), ("hdfc", "fdhc")]
    from pyspark.sql import functions as G
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(G.levenshtein("a", "b").alias("d"), G.size(G.array_intersect(brand.deletions(G.col("a")), brand.deletions(G.col("b")))).alias("n"))
    assert all(r.n > 0 for r in got.collect() if r.d <= 2)


def test_tld_file_with_three_label_suffix(spark):
    table = dict(FV.TLD_RISK)
    table["gov.co.uk"] = 0.05
    table["co.uk"] = 0.2
    s = dims.read_tld_table(spark, _write(table))
    df = spark.createDataFrame([("x.gov.co.uk",), ("a.co.uk",), ("incometax.gov.in",), ("q.zzz",)],
                               "domain string")
    r = {x.domain: x for x in tld.with_tld_risk(df, suffixes=s).collect()}
    assert (r["x.gov.co.uk"].tld, r["x.gov.co.uk"].tld_risk_score) == ("gov.co.uk", 0.05)
    assert (r["a.co.uk"].tld, r["a.co.uk"].tld_risk_score) == ("co.uk", 0.2)
    assert (r["incometax.gov.in"].tld, r["incometax.gov.in"].tld_risk_score) == ("gov.in", 0.01)
    assert (r["q.zzz"].tld, r["q.zzz"].tld_known, r["q.zzz"].tld_risk_score) == ("zzz", 0, 0.5)
    builtin = {x.domain: (x.tld, x.tld_risk_score, x.tld_known) for x in tld.with_tld_risk(df).collect()}
    assert builtin["incometax.gov.in"] == ("gov.in", 0.01, 1)
