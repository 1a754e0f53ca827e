"""Golden values worked out from the detection rules (FIXTURES.md section 2)."""
import pytest
from pyspark.sql import functions as F

from lurescope.functions.url import domain_key
from lurescope.operators import brand, idn, lexical, tld

# url, entropy, brand score, brands/kw/typo/action, tld, risk, known, homograph, n, idn risk, puny
GOLDEN = [
    ("https://example.com", 3.0958, 0.0, (0, 0, 0, 0), "com", 0.15, 1, 0, 0, 0.0, 0),
    ("https://secure-sbi-login.xyz/verify/account", 3.9219, 0.65, (3, 1, 2, 1), "xyz", 0.94, 1, 0, 0, 0.0, 0),
    ("https://secure-sbi-login-verify.xyz", 4.0043, 0.65, (3, 1, 2, 1), "xyz", 0.94, 1, 0, 0, 0.0, 0),
    ("https://www.onlinesbi.com", 3.3372, 0.5, (1, 2, 0, 0), "com", 0.15, 1, 0, 0, 0.0, 0),
    ("sbi-hdfc-alert.info", 3.9321, 0.9833, (5, 2, 3, 1), "info", 0.55, 1, 0, 0, 0.0, 0),
    ("sb1-login.com", 3.5466, 0.4, (2, 0, 2, 1), "com", 0.15, 1, 0, 0, 0.0, 0),
    ("wikipedia.org", 3.3347, 0.0, (0, 0, 0, 0), "org", 0.1, 1, 0, 0, 0.0, 0),
    ("sbi-service.com", 3.3736, 0.65, (3, 1, 2, 1), "com", 0.15, 1, 0, 0, 0.0, 0),
    ("sbi-info.com", 3.2516, 0.5833, (4, 1, 3, 0), "com", 0.15, 1, 0, 0, 0.0, 0),
    ("sbi-verify.com", 3.6645, 0.65, (3, 1, 2, 1), "com", 0.15, 1, 0, 0, 0.0, 0),
    ("upi-payment-alert.xyz", 3.8209, 0.5667, (3, 1, 2, 1), "xyz", 0.94, 1, 0, 0, 0.0, 0),
    ("sbi-hdfc-icici-paytm-upi-aadhaar-verify-login-secure-account.xyz", 4.2153, 1.0, (8, 6, 5, 1),
     "xyz", 0.94, 1, 0, 0, 0.0, 0),
    ("https://incometax.gov.in", 3.5, 0.3333, (2, 1, 1, 0), "gov.in", 0.01, 1, 0, 0, 0.0, 0),
    ("something.qzxy", 3.8074, 0.0, (0, 0, 0, 0), "qzxy", 0.5, 0, 0, 0, 0.0, 0),
    ("sbа.com", 2.8074, 0.25, (2, 0, 2, 0), "com", 0.15, 1, 1, 1, 0.65, 0),
    ("xn--sb-lka.com", 3.4677, 0.0, (0, 0, 0, 0), "com", 0.15, 1, 1, 0, 0.6, 1),
    ("http://192.168.1.1/login", 2.2999, 0.0, (0, 0, 0, 0), "1", 0.5, 0, 0, 0, 0.0, 0),
    ("https://amazon.in", 2.7255, 0.3333, (1, 1, 1, 0), "in", 0.2, 1, 0, 0, 0.0, 0),
    ("https://u:p@evil.xyz:8443/a;b?x=1&&y=2", 3.0, 0.0, (0, 0, 0, 0), "xyz", 0.94, 1, 0, 0, 0.0, 0),
]


@pytest.fixture(scope="module")
def golden_rows(spark):
    df = spark.createDataFrame([(g[0],) for g in GOLDEN], "url string") \
              .withColumn("domain", domain_key(F.col("url")))
    out = idn.with_idn(tld.with_tld_risk(lexical.with_lexical_features(df)))
    b = brand.brand_features(df.select("domain").distinct())
    rl = brand.brand_features_rowlocal(df.select("domain").distinct()) \
              .select("domain", *[F.col(c).alias("rl_" + c) for c in brand.BRAND_COLUMNS + ["typosquat_details"]])
    return {r.url: r for r in out.join(b, "domain", "left").join(rl, "domain", "left").collect()}


@pytest.mark.parametrize("g", GOLDEN, ids=[g[0] for g in GOLDEN])
def test_golden(golden_rows, g):
    url, ent, score, counts, tld_, risk, known, homo, n, idn_risk, puny = g
    r = golden_rows[url]
    assert r.entropy == ent
    assert r.brand_impersonation_score == score
    assert (r.brand_matched_count, r.brand_keyword_hit_count, r.brand_typosquat_hit_count,
            r.brand_has_action_word) == counts
    assert (r.tld, r.tld_risk_score, r.tld_known) == (tld_, risk, known)
    assert (r.idn_is_homograph, r.idn_confusable_count, r.idn_risk_score, r.idn_punycode_flag) == \
        (homo, n, idn_risk, puny)
    for c in brand.BRAND_COLUMNS + ["typosquat_details"]:
        assert r["rl_" + c] == r[c], c
    assert len(r.typosquat_details) == r.brand_typosquat_hit_count


def test_last_url_structure(golden_rows):
    r = golden_rows["https://u:p@evil.xyz:8443/a;b?x=1&&y=2"]
    assert (r.path_length, r.query_param_count, r.special_char_count) == (2, 3, 7)
    assert r.has_at_symbol == 1 and r.has_https == 1


def test_typosquat_details_order(golden_rows):
    r = golden_rows["sbi-hdfc-alert.info"]
    assert [(h.token, h.keyword, h.distance) for h in r.typosquat_details] == \
        [("sbi", "upi", 2), ("sbi", "sebi", 1), ("info", "epfo", 2)]


def test_sbi_hdfc_alert_hits(spark):
    d = spark.createDataFrame([("sbi-hdfc-alert.info",)], "domain string")
    kw = {(r.keyword) for r in brand.keyword_hits(d).collect()}
    ty = {(r.token, r.keyword, r.distance) for r in brand.typosquat_hits(d).collect()}
    assert kw == {"sbi", "hdfc"}
    assert ty == {("sbi", "upi", 2), ("sbi", "sebi", 1), ("info", "epfo", 2)}
