"""The reference test suite's expectations, re-expressed over DataFrames."""
import datetime as dt

from pyspark.sql import functions as F

from lurescope.functions.url import domain_key
from lurescope.operators import brand, enrich, features, idn, lexical, tld


def lex(spark, url):
    df = spark.createDataFrame([(url,)], "url string")
    return lexical.with_lexical_features(df).first()


def brand_of(spark, domain):
    return brand.brand_features(spark.createDataFrame([(domain,)], "domain string")).first()


def test_lexical_literals(spark):
    url = "https://secure-sbi-login.xyz/verify/account"
    assert lex(spark, url).url_length == len(url)
    assert lex(spark, "https://secure-sbi-login.xyz").hyphen_count == 2
    assert lex(spark, "https://example.com").has_https == 1
    assert lex(spark, "http://example.com").has_https == 0
    assert lex(spark, "http://192.168.1.1/login").is_ip_address == 1
    assert lex(spark, "http://example.com").is_ip_address == 0
    assert lex(spark, "https://a.b.example.com").subdomain_depth == 2
    assert lex(spark, "https://example.com").subdomain_depth == 0


def test_entropy_random_higher(spark):
    assert lex(spark, "https://xk29fj83qz.com").entropy > lex(spark, "https://google.com").entropy


def test_any_dotted_quad_is_ip_and_ipv6_is_not(spark):
    assert lex(spark, "http://999.1.1.1/").is_ip_address == 1
    assert lex(spark, "http://[::1]/").is_ip_address == 0


def test_brand_expectations(spark):
    r = brand_of(spark, "sbi-hdfc-alert.info")
    assert r.brand_impersonation_score >= 0.6
    assert {"SBI", "HDFC"} <= set(r.matched_brands)
    typo = brand.typosquat_hits(spark.createDataFrame([("sb1-login.com",)], "domain string")).collect()
    assert any(h.token == "sb1" and h.distance == 1 and h.brand == "SBI" for h in typo)
    w = brand_of(spark, "wikipedia.org")
    assert w.brand_impersonation_score == 0.0 and w.matched_brands == []
    assert brand_of(spark, "sbi-hdfc-service.com").brand_impersonation_score > \
        brand_of(spark, "sbi-service.com").brand_impersonation_score
    no_action, action = brand_of(spark, "sbi-info.com"), brand_of(spark, "sbi-verify.com")
    assert action.brand_has_action_word == 1 and no_action.brand_has_action_word == 0
    assert action.brand_impersonation_score > no_action.brand_impersonation_score
    u = brand_of(spark, "upi-payment-alert.xyz")
    assert "UPI" in u.matched_brands and "upi" in u.keyword_hits
    cap = brand_of(spark, "sbi-hdfc-icici-paytm-upi-aadhaar-verify-login-secure-account.xyz")
    assert cap.brand_impersonation_score == 1.0


def test_tld_expectations(spark):
    df = spark.createDataFrame([(d,) for d in ["secure-login.xyz", "free-gift.tk", "incometax.gov.in",
                                               "something.qzxy", "example.com", "a.com.", "WWW.Gov.IN"]],
                               "domain string")
    r = {x.domain: x for x in tld.with_tld_risk(df).collect()}
    assert r["secure-login.xyz"].tld_risk_score == 0.94
    assert r["free-gift.tk"].tld_risk_score == 0.96
    assert (r["incometax.gov.in"].tld, r["incometax.gov.in"].tld_risk_score) == ("gov.in", 0.01)
    assert (r["something.qzxy"].tld_known, r["something.qzxy"].tld_risk_score) == (0, 0.5)
    assert r["example.com"].tld_risk_score == 0.15
    assert (r["a.com."].tld, r["a.com."].tld_known) == ("", 0)      # trailing dot -> empty TLD
    assert r["WWW.Gov.IN"].tld == "gov.in"                          # www. kept (case-sensitive), lowered after


def test_idn_expectations(spark):
    df = spark.createDataFrame([("sbа.com",), ("sbi.com",), ("xn--sb-lka.com",), (" Аа ",)],
                               "domain string")
    r = {x.domain: x for x in idn.with_idn(df).collect()}
    assert r["sbа.com"].idn_is_homograph == 1 and r["sbа.com"].idn_confusable_count == 1
    assert r["sbi.com"].idn_is_homograph == 0 and r["sbi.com"].idn_risk_score == 0.0
    assert r["xn--sb-lka.com"].idn_punycode_flag == 1 and r["xn--sb-lka.com"].idn_is_homograph == 1
    assert r[" Аа "].idn_confusable_count == 2          # upper-case look-alike lowered first
    det = idn.confusable_details(df).filter("domain = 'sbа.com'").first()
    assert (det.codepoint, det.ch, det.looks_like) == ("U+0430", "а", "a")
    assert det.script == "CYRILLIC SMALL LETTER A"


def _records(spark):
    dns = spark.createDataFrame(
        [("example.com", "A", "93.184.216.34"), ("example.com", "MX", "10 mail.example.com."),
         ("example.com", "A", "93.184.216.34"), ("ipv6-only.example", "AAAA", "2606:2800:220:1::1")],
        "domain string, rtype string, rdata string")
    now = dt.datetime(2024, 1, 31)
    whois = spark.createDataFrame([
        ("onlinesbi.com", now, now - dt.timedelta(days=3650), ["MarkMonitor Inc."], None),
        ("fresh.xyz", now, now - dt.timedelta(days=2), ["NameCheap"], None),
        ("listy.com", now, now - dt.timedelta(days=100), ["Reg A", "Reg B"], None),
        ("private.com", now, now - dt.timedelta(days=400), ["X"], "WhoisGuard Protected"),
        ("future.com", now, now + dt.timedelta(hours=5), ["X"], None),
    ], "domain string, observed_at timestamp, creation_date timestamp, registrars array<string>, org string")
    tls = spark.createDataFrame([
        ("valid.com", now, "VALID", {"organizationName": "Let's Encrypt, Inc.", "commonName": "R3"}, {"commonName": "valid.com"},
         "Mar 31 00:00:00 2024 GMT"),
        ("self.com", now, "UNTRUSTED", {"commonName": "self.com"}, {"commonName": "self.com"}, "Jun  1 12:00:00 2024 GMT"),
        ("closed.com", now, "NO_LISTENER", None, None, None),
        ("nodate.com", now, "UNTRUSTED", {"commonName": "x"}, {"commonName": "y"}, None),
    ], "domain string, observed_at timestamp, status string, "
       "issuer map<string,string>, subject map<string,string>, not_after string")
    return dns, whois, tls, now


def test_dns_rollup(spark):
    dns, _, _, _ = _records(spark)
    r = {x.domain: x for x in enrich.dns_rollup(dns).collect()}
    e = r["example.com"]
    assert (e.dns_resolves, e.dns_a_record_count, e.dns_has_mx, e.dns_has_aaaa) == (True, 1, True, False)
    assert e.dns_resolved_ips == ["93.184.216.34"]
    v6 = r["ipv6-only.example"]
    assert v6.dns_resolves and v6.dns_has_aaaa and v6.dns_a_record_count == 0


def test_whois_derive(spark):
    _, whois, _, now = _records(spark)
    r = {x.domain: x for x in enrich.whois_derive(whois, now).collect()}
    assert (r["onlinesbi.com"].whois_domain_age_days, r["onlinesbi.com"].whois_recently_registered) == (3650, False)
    assert r["onlinesbi.com"].whois_registrar == "MarkMonitor Inc." and r["onlinesbi.com"].whois_found
    assert r["fresh.xyz"].whois_domain_age_days == 2 and r["fresh.xyz"].whois_recently_registered
    assert r["listy.com"].whois_registrar == "Reg A"
    assert r["private.com"].whois_privacy_protected
    assert r["future.com"].whois_domain_age_days == -1 and r["future.com"].whois_recently_registered


def test_tls_derive(spark):
    _, _, tls, now = _records(spark)
    r = {x.domain: x for x in enrich.tls_derive(tls, now).collect()}
    v = r["valid.com"]
    assert (v.ssl_valid, v.ssl_self_signed, v.ssl_issuer, v.ssl_days_until_expiry, v.ssl_expired) == \
        (True, False, "Let's Encrypt, Inc.", 60, False)
    s = r["self.com"]
    assert (s.ssl_valid, s.ssl_self_signed, s.ssl_issuer) == (False, True, "self.com")
    c = r["closed.com"]
    assert (c.ssl_valid, c.ssl_self_signed, c.ssl_issuer, c.ssl_days_until_expiry, c.ssl_expired) == \
        (False, False, None, None, None)
    n = r["nodate.com"]
    assert n.ssl_days_until_expiry is None and n.ssl_expired is False   # cert without a date


def test_missing_records_give_defaults_and_38_columns(spark):
    dns, whois, tls, now = _records(spark)
    req = spark.createDataFrame([(1, now, "https://example.com"), (2, now, "https://nowhere.tk")],
                                "request_id long, ts timestamp, url string")
    fv = features.feature_vector(req, dns, whois, tls, now)
    cols = [c for c in fv.columns if c in features.FEATURE_COLUMNS]
    assert len(cols) == 38
    r = {x.url: x for x in fv.collect()}
    e, n = r["https://example.com"], r["https://nowhere.tk"]
    assert e.dns_resolves is True and e.visual_similarity_score is None and e.dom_credential_form_detected is None
    assert (n.dns_resolves, n.whois_found, n.whois_domain_age_days, n.ssl_valid, n.ssl_days_until_expiry) == \
        (False, 0, None, False, None)


def test_phishing_scores_higher_than_legit(spark):
    req = spark.createDataFrame([(1, "https://secure-sbi-login-verify.xyz"), (2, "https://www.onlinesbi.com")],
                                "request_id long, url string")
    r = {x.request_id: x.aggregate_lexical_risk_score for x in features.feature_vector(req).collect()}
    assert r[1] > r[2]
    assert 0.0 <= r[2] <= 1.0


def test_domain_key_falls_back_to_url(spark):
    df = spark.createDataFrame([("example.com/?u=http://x",), ("sbi.com",)], "url string")
    r = [x.d for x in df.select(domain_key(F.col("url")).alias("d")).collect()]
    assert r == ["example.com/?u=http://x", "sbi.com"]


def test_tls_empty_attributes_and_observation_order(spark):
    now = dt.datetime(2024, 1, 31)
    tls = spark.createDataFrame([
        ("empty.com", now, "UNTRUSTED", {}, {}, None),
        ("same.com", now, "UNTRUSTED", {"commonName": "b", "organizationName": ""}, {"organizationName": "", "commonName": "b"}, None),
        ("twice.com", now - dt.timedelta(days=1), "VALID", {"organizationName": "Old, Ltd"}, {"commonName": "a"}, None),
        ("twice.com", now, "VALID", {"organizationName": "New, Ltd"}, {"commonName": "a"}, None),
    ], "domain string, observed_at timestamp, status string, issuer map<string,string>, subject map<string,string>, not_after string")
    r = {x.domain: x for x in enrich.tls_derive(tls, now).collect()}
    assert r["empty.com"].ssl_self_signed is False      # empty issuer is falsy
    assert r["same.com"].ssl_self_signed is True and r["same.com"].ssl_issuer == "b"
    assert r["twice.com"].ssl_issuer == "New, Ltd"


def test_whois_lists(spark):
    now = dt.datetime(2024, 1, 31)
    who = spark.createDataFrame([("l.com", now, [now - dt.timedelta(days=7), now], ["A", "B"], ["Domains By Proxy", "x"]),
                                 ("n.com", now, [], [], [])],
                                "domain string, observed_at timestamp, creation_date array<timestamp>, registrars array<string>, org array<string>")
    r = {x.domain: x for x in enrich.whois_derive(who, now).collect()}
    assert (r["l.com"].whois_domain_age_days, r["l.com"].whois_registrar, r["l.com"].whois_privacy_protected) == (7, "A", True)
    assert not r["n.com"].whois_found
