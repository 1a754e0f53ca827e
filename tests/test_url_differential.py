"""Brute-force differential check of the URL / text expressions against
Python's own urllib.parse and str methods on seeded random URL-like strings
(one Spark job for all of them)."""
import math
import random
from collections import Counter
from urllib.parse import urlparse

from pyspark.sql import functions as F

from lurescope.functions.text import py_strip
from lurescope.functions.url import host_of_netloc, split_url, with_default_scheme
from lurescope.operators import lexical

ALPHABET = list("abcxyz019-._~:/?#[]@!$&'()*+,;=% ") + ["\t", "é", "а", "²", "　", "HTTP"]
PREFIXES = ["", "http://", "https://", "HTTPS://", "ftp://", "//", " ", "\x01"]


def _strings(n=3000, seed=7):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        body = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 30)))
        out.append(rnd.choice(PREFIXES) + body)
    return out


def _py(url):
    u = url if "://" in url else "https://" + url
    try:
        p = urlparse(u)
    except ValueError:
        return None  # the parser rejects it (bracketed netloc): quarantined as bad_netloc
    host = p.netloc.split("@")[-1].split(":")[0]
    counts = Counter(host)
    ent = -sum((c / len(host)) * math.log2(c / len(host)) for c in counts.values()) if host else 0.0
    return (p.scheme, p.netloc, p.path, p.query, host, round(ent, 4),
            sum(ch.isdigit() for ch in host), url.strip())


def test_url_split_matches_urlparse(spark):
    urls = _strings()
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    parts = split_url(with_default_scheme(F.col("url")))
    staged = df.select("i", "url", *[parts[k].alias(k) for k in ("scheme", "netloc", "path", "query")])
    staged = staged.withColumn("host", host_of_netloc(F.col("netloc")))
    got = staged.select(
        "i", "scheme", "netloc", "path", "query", "host",
        lexical.lexical_columns(F.col("url"), {k: F.col(k) for k in ("scheme", "netloc", "path", "query")},
                                F.col("host"))["entropy"].alias("entropy"),
        lexical.digit_count(F.col("host")).alias("digits"),
        py_strip(F.col("url")).alias("stripped"),
    ).collect()
    checked, mismatches = 0, []
    for r in got:
        want = _py(urls[r.i])
        if want is None:
            continue
        checked += 1
        have = (r.scheme, r.netloc, r.path, r.query, r.host, r.entropy, r.digits, r.stripped)
        if have != want:
            mismatches.append((urls[r.i], have, want))
    assert checked > 2000
    assert not mismatches, mismatches[:5]
