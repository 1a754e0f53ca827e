"""DNS / WHOIS / TLS enrichment from collected record tables.

Live lookups become per-domain rollups of record tables (one shuffle per
table, partial aggregation map-side, so a hot domain collapses before the
exchange) and left joins on the lookup host: a domain without records keeps
its row and gets the "lookup failed" defaults.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import floor_days, regex_alternation
from ..functions.url import join_host
from ..sources import fixed_values as FV

DNS_COLUMNS = ["dns_resolves", "dns_a_record_count", "dns_has_aaaa", "dns_has_mx"]
WHOIS_COLUMNS = ["whois_domain_age_days", "whois_recently_registered", "whois_privacy_protected", "whois_found"]
SSL_COLUMNS = ["ssl_valid", "ssl_self_signed", "ssl_days_until_expiry"]

CERT_DATE_FORMAT = "MMM d HH:mm:ss yyyy z"


def _as_of(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of
    if as_of is None:
        return F.current_timestamp()
    return F.lit(as_of).cast("timestamp")


# ------------------------------------------------------------------------ DNS

def dns_rollup(dns_records: DataFrame, with_ips: bool = True) -> DataFrame:
    """``(domain, dns_resolves, dns_a_record_count, dns_has_aaaa, dns_has_mx
    [, dns_resolved_ips])`` per lower-cased domain.

    Answers are sets (an RRset has no duplicates), so repeated observations
    of one record count once.  Two levels, both skew-safe: distinct
    ``(domain, rtype, rdata)`` (the exchange is spread by ``rdata``, so a hot
    domain is not one task), then plain counts per domain (partial
    aggregation, one row per domain per partition).  The IP list -- A then
    AAAA, each sorted, since a table keeps no server order -- is a detail
    column, collected only when ``with_ips``.
    """
    rt = F.upper(F.col("rtype"))
    recs = (dns_records.select(F.lower("domain").alias("domain"), rt.alias("rtype"), "rdata")
                       .filter(F.col("rtype").isin("A", "AAAA", "MX")).distinct())
    aggs = [F.count_if(F.col("rtype") == "A").cast("int").alias("dns_a_record_count"),
            F.count_if(F.col("rtype") == "AAAA").alias("_n_aaaa"),
            F.count_if(F.col("rtype") == "MX").alias("_n_mx")]
    if with_ips:
        aggs += [F.collect_list(F.when(F.col("rtype") == "A", F.col("rdata"))).alias("_a"),
                 F.collect_list(F.when(F.col("rtype") == "AAAA", F.col("rdata"))).alias("_aaaa")]
    agg = recs.groupBy("domain").agg(*aggs)
    cols = [
        "domain",
        ((F.col("dns_a_record_count") + F.col("_n_aaaa")) > 0).alias("dns_resolves"),
        "dns_a_record_count",
        (F.col("_n_aaaa") > 0).alias("dns_has_aaaa"),
        (F.col("_n_mx") > 0).alias("dns_has_mx"),
    ]
    if with_ips:
        cols.append(F.concat(F.array_sort("_a"), F.array_sort("_aaaa")).alias("dns_resolved_ips"))
    return agg.select(*cols)


# ---------------------------------------------------------------------- WHOIS

def _first(c: Column, dtype: T.DataType) -> Column:
    """First element of a list-valued field, the value itself when scalar."""
    if isinstance(dtype, T.ArrayType):
        return F.try_element_at(c, F.lit(1))
    return c


def latest_observation(records: DataFrame, as_of=None, cols: list[str] | None = None) -> DataFrame:
    """The newest observation per lower-cased domain not later than ``as_of``.

    ``max(struct(observed_at, ...))`` is a plain aggregate, so it combines
    map-side: a domain with millions of observations still sends one row per
    partition to the exchange.  Ties on ``observed_at`` break on the other
    fields, so the choice is deterministic; maps have no order, so they are
    compared as their sorted entries.
    """
    cols = cols or [c for c in records.columns if c not in ("domain", "observed_at")]
    maps = {f.name for f in records.schema.fields if isinstance(f.dataType, T.MapType)}
    r = records.filter(F.col("observed_at") <= _as_of(as_of)) if as_of is not None else records
    fields = [F.array_sort(F.map_entries(c)).alias(c) if c in maps else F.col(c) for c in cols]
    latest = (r.withColumn("domain", F.lower("domain"))
               .groupBy("domain").agg(F.max(F.struct("observed_at", *fields)).alias("_r")))
    return latest.select("domain", *[(F.map_from_entries(F.col("_r")[c]) if c in maps else F.col("_r")[c]).alias(c)
                                     for c in ["observed_at", *cols]])


def whois_derive(whois_records: DataFrame, as_of=None) -> DataFrame:
    """``(domain, whois_found, whois_domain_age_days, whois_registrar,
    whois_recently_registered, whois_privacy_protected)`` from the latest record.

    ``registrars``, ``creation_date`` and ``org`` may be scalars or arrays (first
    element used).
    """
    types = {f.name: f.dataType for f in whois_records.schema.fields}
    names = ["creation_date", "registrars", "org"]
    latest = latest_observation(whois_records, as_of, names)
    fields = whois_fields({c: F.col(c) for c in names}, types, _as_of(as_of))
    return latest.select("domain", *[c.alias(n) for n, c in fields.items()])


def whois_fields(record: dict[str, Column], types: dict[str, T.DataType], at: Column) -> dict[str, Column]:
    """The derived columns of one WHOIS record, as of ``at``."""
    registrar = _first(record["registrars"], types["registrars"])
    created = _first(record["creation_date"], types["creation_date"])
    org = _first(record["org"], types["org"])
    age = floor_days(at, created)
    return {
        "whois_found": created.isNotNull() | registrar.isNotNull(),
        "whois_domain_age_days": age,
        "whois_registrar": registrar,
        "whois_recently_registered": F.coalesce(age < FV.RECENTLY_REGISTERED_DAYS, F.lit(False)),
        "whois_privacy_protected": F.lower(F.coalesce(org, F.lit(""))).rlike(regex_alternation(FV.WHOIS_PRIVACY_TERMS)),
    }


# ------------------------------------------------------------------------ TLS

def parse_cert_date(s: Column) -> Column:
    """``'Jun  1 12:00:00 2026 GMT'`` -> timestamp; null when it does not parse."""
    return F.try_to_timestamp(F.regexp_replace(s, " +", " "), F.lit(CERT_DATE_FORMAT))


def tls_derive(tls_observations: DataFrame, as_of=None) -> DataFrame:
    """``(domain, ssl_valid, ssl_self_signed, ssl_issuer, ssl_days_until_expiry,
    ssl_expired)`` from the latest handshake observation.

    ``status`` VALID = trusted handshake; UNTRUSTED = certificate present but
    not verified (self-signed decided here); anything else = no certificate.
    ``issuer`` / ``subject`` are attribute maps.
    """
    names = ["status", "issuer", "subject", "not_after"]
    latest = latest_observation(tls_observations, as_of, names)
    fields = tls_fields({c: F.col(c) for c in names}, _as_of(as_of))
    return latest.select("domain", *[c.alias(n) for n, c in fields.items()])


def tls_fields(observation: dict[str, Column], at: Column) -> dict[str, Column]:
    """The derived columns of one handshake observation, as of ``at``."""
    iss, sub = observation["issuer"], observation["subject"]
    st = F.upper(observation["status"])
    valid, untrusted = st == "VALID", st == "UNTRUSTED"
    has_cert = valid | untrusted
    name = F.coalesce(F.nullif(F.try_element_at(iss, F.lit("organizationName")), F.lit("")),
                      F.try_element_at(iss, F.lit("commonName")))
    days = floor_days(parse_cert_date(observation["not_after"]), at)
    self_signed = (untrusted & F.coalesce(F.size(iss) > 0, F.lit(False))
                   & F.coalesce(F.array_sort(F.map_entries(iss)) == F.array_sort(F.map_entries(sub)), F.lit(False)))
    return {
        "ssl_valid": F.coalesce(valid, F.lit(False)),
        "ssl_self_signed": F.coalesce(self_signed, F.lit(False)),
        "ssl_issuer": F.when(has_cert, name),
        "ssl_days_until_expiry": F.when(has_cert, days),
        "ssl_expired": F.when(valid, days < 0).when(untrusted, F.coalesce(days < 0, F.lit(False))),
    }


# ---------------------------------------------------------------- J6 / J7

def record_rollups(dns_records: DataFrame | None, whois_records: DataFrame | None,
                   tls_observations: DataFrame | None, as_of=None, with_ips: bool = False) -> DataFrame | None:
    """The three per-domain rollups in one table keyed by ``domain`` (the lookup
    host), without defaults; ``None`` when no record table is given.

    Each rollup comes out of an aggregate hash-partitioned on ``domain``, so
    the first full outer join adds no exchange; its coalesced key is
    re-hashed once for the third (per-domain rows only).  A streaming job
    computes this once (``session.materialize``) and joins every micro-batch
    to it, instead of re-aggregating the record tables per trigger.
    """
    parts = []
    if dns_records is not None:
        parts.append(dns_rollup(dns_records, with_ips))
    if whois_records is not None:
        parts.append(whois_derive(whois_records, as_of))
    if tls_observations is not None:
        parts.append(tls_derive(tls_observations, as_of))
    out = None
    for p in parts:
        out = p if out is None else out.join(p, "domain", "full_outer")
    return out


_ROLLUP_TYPES = {
    "dns_resolves": "boolean", "dns_a_record_count": "int", "dns_has_aaaa": "boolean", "dns_has_mx": "boolean",
    "dns_resolved_ips": "array<string>", "whois_found": "boolean", "whois_domain_age_days": "int",
    "whois_registrar": "string", "whois_recently_registered": "boolean", "whois_privacy_protected": "boolean",
    "ssl_valid": "boolean", "ssl_self_signed": "boolean", "ssl_issuer": "string",
    "ssl_days_until_expiry": "int", "ssl_expired": "boolean",
}


def with_enrichment(domains: DataFrame, dns_records: DataFrame | None, whois_records: DataFrame | None,
                    tls_observations: DataFrame | None, as_of=None, domain_col: str = "domain",
                    with_ips: bool = False, rollups: DataFrame | None = None) -> DataFrame:
    """J6 + J7: left-join the domains to the record rollups on the lookup
    host, then the "lookup failed" defaults.

    Run on distinct domains (or a stream, as a stream-static join).  With a
    precomputed ``rollups`` table (``record_rollups``, what a stream uses) it
    is one join; otherwise one left join per record table.  AQE turns a join
    into a broadcast only when the runtime size of its right side is under
    the broadcast threshold.
    """
    d = domains.withColumn("_jh", join_host(F.col(domain_col)))
    if rollups is not None:
        j = d.join(rollups.withColumnRenamed("domain", "_jh"), "_jh", "left")
    else:
        # Batch: each rollup leaves its aggregate hash-partitioned on the host,
        # so three left joins from the domain side re-hash nothing but the
        # domains (a pre-joined table would re-hash its coalesced full-outer key).
        j = d
        parts = [(dns_records, lambda r: dns_rollup(r, with_ips)),
                 (whois_records, lambda r: whois_derive(r, as_of)),
                 (tls_observations, lambda r: tls_derive(r, as_of))]
        for records, rollup in parts:
            if records is not None:
                j = j.join(rollup(records).withColumnRenamed("domain", "_jh"), "_jh", "left")

    def col(name):
        return F.col(name) if name in j.columns else F.lit(None).cast(_ROLLUP_TYPES[name])

    return j.select(
        *[c for c in domains.columns],
        F.coalesce(col("dns_resolves"), F.lit(False)).alias("dns_resolves"),
        F.coalesce(col("dns_a_record_count"), F.lit(0)).alias("dns_a_record_count"),
        F.coalesce(col("dns_has_aaaa"), F.lit(False)).cast("int").alias("dns_has_aaaa"),
        F.coalesce(col("dns_has_mx"), F.lit(False)).cast("int").alias("dns_has_mx"),
        *([F.coalesce(col("dns_resolved_ips"), F.array().cast("array<string>")).alias("dns_resolved_ips")]
          if with_ips else []),
        col("whois_domain_age_days").alias("whois_domain_age_days"),
        F.coalesce(col("whois_recently_registered"), F.lit(False)).cast("int").alias("whois_recently_registered"),
        F.coalesce(col("whois_privacy_protected"), F.lit(False)).cast("int").alias("whois_privacy_protected"),
        F.coalesce(col("whois_found"), F.lit(False)).cast("int").alias("whois_found"),
        col("whois_registrar").alias("whois_registrar"),
        F.coalesce(col("ssl_valid"), F.lit(False)).alias("ssl_valid"),
        F.coalesce(col("ssl_self_signed"), F.lit(False)).cast("int").alias("ssl_self_signed"),
        col("ssl_days_until_expiry").alias("ssl_days_until_expiry"),
        col("ssl_issuer").alias("ssl_issuer"),
        col("ssl_expired").alias("ssl_expired"),
    )


def domains_without_records(domains: DataFrame, records: DataFrame, domain_col: str = "domain") -> DataFrame:
    """Domains whose lookup host has no row in ``records`` (left anti join)."""
    keys = records.select(F.lower("domain").alias("_jh")).distinct()  # combined map-side: a hot domain is one row a task
    return (domains.withColumn("_jh", join_host(F.col(domain_col)))
                   .join(keys, "_jh", "left_anti").drop("_jh"))
