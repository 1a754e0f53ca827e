"""Segment join, blacklists with parent domains, IPv6 literals, the fitted scorer: against brute force."""
import ipaddress
import math
import random
import urllib.parse

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from lurescope.functions.url import bad_netloc, is_ipv6
from lurescope.operators import blacklist, brand, features, fitted, scoring
from lurescope.plans import catalog, catalog_screening, jobs
from lurescope.session import scratch_path
from lurescope.sources import fixtures as fx
from conftest import SF_SMALL


# ------------------------------------------------------------------ J1

def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("alphabet, seed", [("ab", 1), ("abcd", 2), ("abcdéя", 3)])
def test_segment_join_finds_every_typosquat(spark, alphabet, seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    keywords = sorted({word(r.randint(1, 10)) for _ in range(200)})
    tokens = sorted({word(r.randint(1, 12)) for _ in range(500)})
    kw = spark.createDataFrame([("b", k, i) for i, k in enumerate(keywords)] + [("b", "", 0), ("b", None, 0)],
                               "brand string, keyword string, ord long")
    hits = brand.typosquat_hits(spark.createDataFrame([(t,) for t in tokens], "domain string"), keywords=kw)
    got = [tuple(x) for x in hits.select("token", "keyword", "distance").collect()]
    expected = {(t, k, _distance(t, k)) for t in tokens for k in keywords
                if len(t) >= 3 and abs(len(t) - len(k)) <= 2 and 1 <= _distance(t, k) <= 2}
    assert len(got) == len(set(got)) and set(got) == expected


def test_segment_keys_are_spread(spark):
    """No key holds over 1 % of the keys of 20,000 distinct tokens, whatever their length."""
    r = random.Random(4)
    tokens = {"".join(r.choice("etaoinshrdlucm") for _ in range(r.choice([3, 4, 5, 6, 8, 10]))) for _ in range(20_000)}
    keys = spark.createDataFrame([(t,) for t in tokens], "t string").select(F.inline(brand.token_segments(F.col("t"))))
    most = keys.groupBy(*keys.columns).count().agg(F.max("count"), F.sum("count")).first()
    assert most[0] < 0.01 * most[1]


# ------------------------------------------------------------------ J8

HOSTS = ["a.b.evil.com", "evil.com", "EVIL.com:8080", "user@x.evil.com", "notevil.com", "evil.com.org", "com", "10.0.0.1", "1.10.0.0.1.example",
         "good.org", "x.good.org.", "0.0.1", None, "", "b.evil.com"]
LISTED = ["Evil.com", "evil.com", "0.0.1", "good.org.", None, "", "b.evil.com:80"]


def _covered(domain, listed):
    host = (domain or "").split("@")[-1].split(":")[0].lower().removesuffix(".")
    entries = {(e or "").split(":")[0].lower().removesuffix(".") for e in listed} - {""}
    numeric = host != "" and set(host) <= set("0123456789.")
    return any(host == e or (not numeric and host.endswith("." + e)) for e in entries)


@pytest.mark.parametrize("use_bloom", [True, False])
def test_parent_domains(spark, use_bloom):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(HOSTS * 2)], "i int, domain string")
    bl = blacklist.screen(spark.createDataFrame([(x,) for x in LISTED], "domain string"), use_bloom)
    got = {r.i: r.is_zero_day for r in scoring.with_zero_day(df, bl).collect()}
    assert got == {i: not _covered(h, LISTED) for i, h in enumerate(HOSTS * 2)}


def test_empty_blacklist_and_input(spark):
    none = spark.createDataFrame([], "domain string")
    some = spark.createDataFrame([("a.com",)], "domain string")
    assert scoring.with_zero_day(some, blacklist.screen(none)).first().is_zero_day
    assert scoring.with_zero_day(none, blacklist.screen(some)).count() == 0


def test_bloom_filter_thins_the_join(spark):
    """Every listed suffix passes, and of the others few do: rows that reach the join, with and without."""
    listed = spark.range(5_000).select(F.format_string("bad%d.example", "id").alias("domain"))
    hosts = spark.range(20_000).select(F.concat(F.lit("h."), F.when(F.col("id") % 100 == 0, F.format_string("bad%d.example", F.col("id") % 5_000))
                                                .otherwise(F.format_string("fine%d.example", "id"))).alias("domain"))
    with_it, without = blacklist.screen(listed), blacklist.screen(listed, use_bloom=False)
    rows = {s is with_it: blacklist.candidates(hosts, s).count() for s in (with_it, without)}
    hits = {s is with_it: {r.domain for r in blacklist.listed_domains(hosts, s).collect()} for s in (with_it, without)}
    assert hits[True] == hits[False] and len(hits[True]) == 50
    assert rows[False] > 59_000 and 50 <= rows[True] < 0.03 * rows[False]


def test_too_large_a_blacklist_goes_without_a_filter(spark, monkeypatch):
    monkeypatch.setattr(blacklist, "MAX_WORDS", 16)
    bl = blacklist.screen(spark.range(2_000).select(F.format_string("d%d.org", "id").alias("domain")))
    assert bl.bloom is None
    df = spark.createDataFrame([("x.d7.org",), ("x.e7.org",)], "domain string")
    assert [r.is_zero_day for r in scoring.with_zero_day(df, bl).orderBy("domain").collect()] == [False, True]


# ------------------------------------------------------------------ P1

def _literals():
    r = random.Random(5)
    pool = ["", "0", "1", "ab", "FFFF", "12345", "g", "1.2.3.4", "256.1.1.1", "01.2.3.4"]
    out = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.4",
           "1.2.3.4", ":::", ":1", "1:", "", "%a", "::%", "::%a%b", "::%eth0"]
    for _ in range(2_000):
        t = ":".join(r.choice(pool[:r.choice([4, 5, 5, 5, 7, 8, 10])]) for _ in range(r.randint(1, 9)))
        out.append((t.replace(":", "::", 1) if r.random() < .5 else t) + r.choice(["", "", "", "%eth0", "%", "%a%b"]))
    return out


def _is_address(text):
    try:
        return isinstance(ipaddress.ip_address(text), ipaddress.IPv6Address)
    except ValueError:
        return False


def test_ipv6_grammar_is_pythons(spark):
    literals = sorted(set(_literals()))
    rows = spark.createDataFrame([(x,) for x in literals], "t string").select("t", is_ipv6(F.col("t")).alias("ok")).collect()
    got, expected = {r.t: r.ok for r in rows}, {x: _is_address(x) for x in literals}
    assert got == expected and 100 < sum(expected.values()) < len(expected) - 100


def _rejected(text):
    """A bracket in the user info or outside ``[literal]`` or ``[literal]:port``, or what Python's parser refuses."""
    url = text if text.startswith(("http://", "https://")) else "https://" + text
    try:
        netloc = urllib.parse.urlsplit(url).netloc
    except ValueError:
        return True
    if "[" not in netloc:
        return False
    user_info, _, host = netloc.rpartition("@")
    if "[" in user_info or "]" in user_info:
        return True
    literal, closed, port = host[1:].partition("]")
    future = literal.startswith("v") and literal[1:].partition(".")[2] != ""  # the URL parser has checked the rest
    return not (host.startswith("[") and closed and (not port or port.startswith(":")) and (future or _is_address(literal)))


def test_bracketed_hosts(spark):
    texts = []
    for t in _literals()[:400] + ["v1.x", "v.x", "vG.x", "v1.", "v1.a:b"]:
        texts += [f"http://[{t}]/x", f"[{t}]:80?q", f"http://u[1]@{t}/", f"https://u@[{t}]x/", f"a[{t}]", f"http://[{t}", f"{t}]",
                  f"http://[a@{t}]", f"http://a]@[{t}", f"http://[{t}]]:8", f"h\t[{t}]", f"http://x/[{t}", f"http://[{t}\t]", f"u[1]@[{t}]"]
    texts = sorted(set(texts))
    rows = spark.createDataFrame([(x,) for x in texts], "u string").select("u", bad_netloc(F.col("u")).alias("bad")).collect()
    assert {r.u: r.bad for r in rows} == {x: _rejected(x) for x in texts}


# ------------------------------------------------------------------ U2

@pytest.fixture(scope="module")
def model_path(spark):
    path = scratch_path(spark, "test_model")
    catalog_screening.train_fixture(spark, SF_SMALL).write().save(path)
    return path


def test_contributions_add_up_to_the_model(spark, model_path):
    dns, who, tls = catalog._records(spark, SF_SMALL)
    fv = features.feature_vector(catalog.valid_requests(spark, SF_SMALL), dns, who, tls, fx.AGES_AS_OF)
    model = PipelineModel.load(model_path)
    rows = fitted.LinearScorer.load(model_path)(model.transform(fv)).select("_margin", "_probability", "shap", "confidence", "score", "domain", "ts").collect()
    for r in rows:
        total = math.fsum(e.shap_value for e in r.shap)
        assert len(r.shap) == len(fitted.NUMERIC_FEATURES) + 1 and r.shap[-1].feature == fitted.BASE
        assert abs(total - r._margin[1]) < 1e-9 and abs(r.confidence - r._probability[1]) < 1e-12
        assert abs(100 * r.confidence - r.score) <= 0.5 + 1e-9
        assert all(e.direction == ("up" if e.shap_value > 0 else "down" if e.shap_value < 0 else "none") for e in r.shap)
    labelled = fitted.LinearScorer.load(model_path)(fv).withColumn("hit", scoring.rule_score(F.col("domain")) >= 70) \
        .filter(F.col("ts") >= F.lit("2024-01-15").cast("timestamp")).select("hit", "score").collect()
    right, held = sum((r.score >= 50) == r.hit for r in labelled), len(labelled)
    majority = max(sum(r.hit for r in labelled), sum(not r.hit for r in labelled))
    assert held > 100 and right > majority


def test_missing_features_constant_features_and_labels(spark):
    rows = [(1.0, None, 5.0, True), (2.0, 1.0, 5.0, True), (-1.0, None, 5.0, False), (-2.0, 3.0, 5.0, False), (9.0, 9.0, 9.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y boolean")
    scorer = fitted.LinearScorer.of(fitted.fit(df, "y", ["a", "b", "c"]), high=90, medium=50, labels={"a": "the A"})
    out = scorer(df).collect()
    assert all(e.shap_value == 0.0 for r in out for e in r.shap if e.feature == "c") and out[0].shap[0].label == "the A"
    assert [r.score >= 50 for r in out[:4]] == [True, True, False, False] and out[0].shap[1].value == 0.0
    assert scorer(df.limit(0)).count() == 0
    single = fitted.LinearScorer.of(fitted.fit(df.filter("y"), "y", ["a", "b", "c"]))(df).select("score").distinct().collect()
    assert len(single) == 1


def test_job_with_model_and_parent_blacklist(spark, model_path):
    req, bl, out = (scratch_path(spark, k) for k in ("m_requests", "m_blacklist", "m_out"))
    fx.scan_requests(spark, SF_SMALL).write.parquet(req)
    catalog_screening.parent_blacklist(spark, SF_SMALL).write.parquet(bl)
    a = jobs._args(["batch", "--requests", req, "--scans", out + "/s", "--feed", out + "/f", "--model", model_path,
                    "--blacklist", bl, "--blacklist-parents", "--as-of", "2024-01-31T00:00:00"])
    jobs.run_batch(spark, a)
    scans = spark.read.parquet(out + "/s")
    listed = [r.domain for r in spark.read.parquet(bl).distinct().collect()]
    known = {r.domain: r.is_zero_day for r in scans.select("domain", "is_zero_day").distinct().collect()}
    assert known == {d: not _covered(d, listed) for d in known} and len(set(known.values())) == 2
    assert scans.filter("size(from_json(shap_json, 'array<struct<feature:string>>')) <> 36").count() == 0
