"""Fixture views derived by Spark from the given ``pages`` and ``events`` tables.

``pages`` hosts are all ``*.example.*``, so brand, TLD and IDN rules would
see almost nothing; these views put risky URLs in deterministically and
derive DNS / WHOIS / TLS record tables from the scanned hosts (the rules are
written out in FIXTURES.md).  Everything grows with the input tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import read_table

# Fixed fixture values: 12 lure templates, ``{n}`` becomes the page id.
LURES = [
    (1, "https://", "secure-sbi-login{n}.xyz"),
    (2, "http://", "sb1-{n}-verify.tk"),
    (3, "https://", "hdfcbank-kyc.top"),
    (4, "http://", "192.168.1.{n}"),
    (5, "https://", "xn--sb-lka{n}.com"),
    (6, "https://", "amazon.in"),
    (7, "https://", "u@paytm-{n}.click:8443"),
    (8, "https://", "incometax{n}.gov.in"),
    (9, "http://", "wikipedia.org"),
    (10, "https://", "phonepee-offer{n}.zzz"),
    (11, "http://", "ic1ci.co.in"),
    (12, "https://", "www.onlinesbi.com"),
]
LURE_MODULUS = 24

# Fixture-only choices (the rules we reproduce have none): category rules in
# order, the zero-day flag and the as-of instants.
FIXTURE_CATEGORY_RULES = [("upi|paytm", "upi"), ("gov|incometax", "gov"), ("sbi|hdfc|ic1ci", "banking")]
STATS_AS_OF = dt.datetime(2024, 1, 30, 0, 0, 0)
AGES_AS_OF = dt.datetime(2024, 1, 31, 0, 0, 0)
WHOIS_BASE = dt.datetime(2024, 1, 31, 0, 0, 0)
NOT_AFTER_TIMES = ["Mar  1 12:00:00", "Jun 15 00:00:00", "Dec 31 23:59:59"]


def fixture_zero_day(request_id: Column) -> Column:
    return (request_id % 10) == 0


def lures(spark: SparkSession) -> DataFrame:
    from .dimensions import literal_table
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("scheme", T.StringType()),
                           T.StructField("lure", T.StringType())])
    return literal_table(spark, LURES, schema)


def scan_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(request_id, ts, client_id, url)``: one request per event, on page
    ``event_id % n_pages``, rewritten to a lure host for 12 of 24 page ids."""
    # each given table is one file, which would be one task: spread by the key of the join, in as many tasks as the session has
    events = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id").repartition("event_id")
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    n_pages = pages.select(F.count(F.lit(1))).scalar()
    req = (events.withColumn("_page_key", F.col("event_id") % n_pages)
                 .join(pages, F.col("page_id") == F.col("_page_key"))
                 .join(F.broadcast(lures(spark)), F.col("i") == F.col("page_id") % LURE_MODULUS, "left"))
    lure_url = F.concat(F.col("scheme"),
                        F.replace(F.col("lure"), F.lit("{n}"), F.col("page_id").cast("string")),
                        F.regexp_replace(F.col("url"), r"^https?://[^/]*", ""))
    return req.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("client_id"),
        F.when(F.col("i").isNull(), F.col("url")).otherwise(lure_url).alias("url"),
    )


def hosts(requests: DataFrame) -> DataFrame:
    """``(domain, host_id)``: per scanned netloc, the first request id."""
    return (requests.select(F.regexp_extract("url", r"^https?://([^/?#]*)", 1).alias("domain"),
                            "request_id")
                    .groupBy("domain").agg(F.min("request_id").alias("host_id")))


def dns_records(hosts_df: DataFrame) -> DataFrame:
    h = F.col("host_id")
    a = (hosts_df.filter(h % 5 != 0)
         .select("domain", "host_id", F.explode(F.sequence(F.lit(0), (h % 3).cast("int"))).alias("k"))
         .select("domain", F.lit("A").alias("rtype"),
                 F.concat(F.lit("10.0."), F.col("k").cast("string"), F.lit("."),
                          (h % 250).cast("string")).alias("rdata")))
    aaaa = (hosts_df.filter(h % 4 == 1)
            .select("domain", F.lit("AAAA").alias("rtype"),
                    F.concat(F.lit("2001:db8::"), (h % 250).cast("string")).alias("rdata")))
    mx = (hosts_df.filter(h % 2 == 0)
          .select("domain", F.lit("MX").alias("rtype"),
                  F.concat(F.lit("10 mail."), F.col("domain"), F.lit(".")).alias("rdata")))
    return a.unionByName(aaaa).unionByName(mx)


def _ts(d: dt.datetime) -> Column:
    return F.lit(d).cast("timestamp")


def whois_records(hosts_df: DataFrame) -> DataFrame:
    h = F.col("host_id")
    ks = F.when(h % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    w = hosts_df.filter(h % 7 != 0).select("domain", "host_id", F.explode(ks).alias("k"))
    base_us = int(WHOIS_BASE.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    age_days = (h * 37) % 400 - 5
    created = F.timestamp_micros(F.lit(base_us) - age_days * F.lit(86_400_000_000) + F.lit(7 * 3_600_000_000))
    return w.select(
        "domain",
        F.when(F.col("k") == 1, _ts(dt.datetime(2024, 1, 20))).otherwise(_ts(dt.datetime(2024, 1, 10))).alias("observed_at"),
        F.when(h % 3 == 0, F.array(created, created + F.expr("INTERVAL 9 DAYS"))).otherwise(F.array(created)).alias("creation_date"),
        F.when(h % 6 == 0, F.lit(None).cast("array<string>"))
         .when(h % 6 == 1, F.array(F.lit("Registrar 1"), F.lit("Registrar 1b")))
         .otherwise(F.array(F.concat(F.lit("Registrar "), (h % 4).cast("string")))).alias("registrars"),
        F.when(h % 5 == 0, F.array(F.lit("WhoisGuard Protected")))
         .when(h % 5 == 1, F.array(F.lit("REDACTED FOR PRIVACY")))
         .when(h % 5 == 2, F.lit(None).cast("array<string>"))
         .when(F.col("k") == 1, F.array(F.lit("Acme Ltd"), F.lit("Other Ltd")))
         .otherwise(F.array(F.lit("Domains By Proxy"))).alias("org"),
    )


def tls_observations(hosts_df: DataFrame) -> DataFrame:
    h = F.col("host_id")
    status = (F.when(h % 4 == 0, F.lit("NO_LISTENER")).when(h % 4 == 3, F.lit("UNTRUSTED"))
               .otherwise(F.lit("VALID")))
    no_listener = status == "NO_LISTENER"
    own_ca = h % 8 == 3
    org, name = F.lit("organizationName"), F.lit("commonName")
    issuer = (F.when(no_listener, F.lit(None).cast("map<string,string>"))
               .when(own_ca, F.create_map(org, F.lit("MyOwnCA"), name, F.lit("x")))
               .when(h % 3 == 0, F.create_map(name, F.lit("R3")))
               .otherwise(F.create_map(org, F.lit("Trusty, Inc."))))
    subject = (F.when(no_listener, F.lit(None).cast("map<string,string>"))
                .when(own_ca, F.create_map(name, F.lit("x"), org, F.lit("MyOwnCA")))
                .otherwise(F.create_map(name, F.col("domain"))))
    times = F.array(*[F.lit(t) for t in NOT_AFTER_TIMES])
    year = F.when(status == "UNTRUSTED", F.lit(" 2023 GMT")).otherwise(F.lit(" 2024 GMT"))
    not_after = (F.when(no_listener | (h % 16 == 7), F.lit(None).cast("string"))
                  .otherwise(F.concat(F.element_at(times, (h % 3 + 1).cast("int")), year)))
    return hosts_df.select("domain", _ts(dt.datetime(2024, 1, 20)).alias("observed_at"),
                           status.alias("status"), issuer.alias("issuer"),
                           subject.alias("subject"), not_after.alias("not_after"))


# ------------------------------------------------------ observation histories

HISTORY_START = dt.datetime(2024, 1, 2, 0, 0, 0)


def _observed(k: Column, step_days: int) -> Column:
    base_us = int(HISTORY_START.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    return F.timestamp_micros(F.lit(base_us) + k * F.lit(step_days * 86_400_000_000) + (F.col("host_id") % 24) * F.lit(3_600_000_000))


def dns_history(hosts_df: DataFrame) -> DataFrame:
    """Four answer sets a host, a week apart; every fourth one is empty (a row of type NONE)."""
    g = F.col("host_id") + F.col("k")
    h = hosts_df.select("domain", "host_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")) \
                .withColumn("observed_at", _observed(F.col("k"), 7))
    some = h.filter(g % 4 != 0)
    a = some.select("domain", "observed_at", F.lit("A").alias("rtype"), "host_id", "k",
                    F.explode(F.sequence(F.lit(0), (g % 3).cast("int"))).alias("j")) \
            .select("domain", "observed_at", "rtype", F.concat_ws(".", F.lit("10"), "k", "j", F.col("host_id") % 250).alias("rdata"))

    def one(rows, rtype, rdata):
        return rows.select("domain", "observed_at", F.lit(rtype).alias("rtype"), rdata.alias("rdata"))

    return (a.unionByName(one(some.filter(g % 3 == 1), "AAAA", F.lit("2001:db8::1")))
             .unionByName(one(some.filter(g % 2 == 0), "MX", F.concat(F.lit("10 mail."), F.col("domain"))))
             .unionByName(one(h.filter(g % 4 == 0), "NONE", F.lit(""))))


def whois_history(hosts_df: DataFrame) -> DataFrame:
    """Two records a host, ten days apart; the owner changes, the registrar may."""
    h = F.col("host_id")
    base_us = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    created = F.timestamp_micros(F.lit(base_us) - ((h * 37) % 400 - 5) * F.lit(86_400_000_000))
    rows = hosts_df.filter(h % 7 != 0).select("domain", "host_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    org = F.when(h % 5 == F.col("k"), F.array(F.lit("WhoisGuard Protected"))).otherwise(F.array(F.lit("Acme Ltd")))
    return rows.select("domain", _observed(F.col("k"), 10).alias("observed_at"), F.array(created).alias("creation_date"),
                       F.array(F.concat(F.lit("R"), (h % 4 + F.col("k")).cast("string"))).alias("registrars"), org.alias("org"))


def tls_history(hosts_df: DataFrame) -> DataFrame:
    """Three handshakes a host, nine days apart; status and issuer change."""
    h, k = F.col("host_id"), F.col("k")
    rows = hosts_df.select("domain", "host_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    status = F.when((h + k) % 4 == 0, F.lit("NO_LISTENER")).when((h + k) % 4 == 3, F.lit("UNTRUSTED")).otherwise(F.lit("VALID"))
    issuer = F.create_map(F.lit("organizationName"), F.concat(F.lit("CA "), k.cast("string")))
    subject = F.when(h % 3 == 0, issuer).otherwise(F.create_map(F.lit("commonName"), F.col("domain")))
    day = F.concat(F.lit("Jan "), F.lpad((F.lit(5) + (h % 20)).cast("string"), 2, " "), F.lit(" 12:00:00 2024 GMT"))
    return rows.select("domain", _observed(k, 9).alias("observed_at"), status.alias("status"), issuer.alias("issuer"),
                       subject.alias("subject"), day.alias("not_after"))
