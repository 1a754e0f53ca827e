"""The 38-column feature vector (P17) and the aggregate lexical risk.

Plan shape: lexical features are row-local on the requests; everything that
depends only on the scan domain (brand, TLD, IDN, DNS, WHOIS, TLS) is
computed once per *distinct* domain and joined back in one domain-keyed join.
The per-domain count aggregates map-side, so a hot domain costs one row per
partition, and the domain set is checkpointed once because five branches
read it.  The join-back is where a hot domain lands: hot domains are split
over salts (``join_back_salted``), with AQE's skew-join split as a second line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_round
from ..functions.url import domain_key
from ..session import materialize
from . import brand as brand_op
from . import enrich, idn, lexical, tld

FEATURE_COLUMNS = [
    *lexical.LEXICAL_COLUMNS,
    *brand_op.BRAND_COLUMNS,
    "tld", "tld_risk_score", "tld_known",
    *idn.IDN_COLUMNS,
    *enrich.DNS_COLUMNS,
    *enrich.WHOIS_COLUMNS,
    *enrich.SSL_COLUMNS,
    "visual_similarity_score", "dom_credential_form_detected",
    "aggregate_lexical_risk_score",
]
assert len(FEATURE_COLUMNS) == 38

_BOOLEANS = {"dns_resolves", "ssl_valid", "dom_credential_form_detected"}
_DOUBLES = {"entropy", "brand_impersonation_score", "tld_risk_score", "idn_risk_score", "visual_similarity_score",
            "aggregate_lexical_risk_score"}
#: The 38 columns as the stored JSON has them.
FEATURE_SCHEMA = T.StructType([
    T.StructField(c, T.BooleanType() if c in _BOOLEANS else T.DoubleType() if c in _DOUBLES
                  else T.StringType() if c == "tld" else T.IntegerType()) for c in FEATURE_COLUMNS])

DETAIL_COLUMNS = ["matched_brands", "keyword_hits", "closest_brand", "typosquat_details",
                  "whois_registrar", "ssl_issuer", "ssl_expired"]


def aggregate_lexical_risk(brand_score: Column, tld_risk: Column, idn_risk: Column, entropy: Column) -> Column:
    raw = (F.lit(0.4) * brand_score + F.lit(0.3) * tld_risk + F.lit(0.2) * idn_risk
           + F.lit(0.1) * F.least(entropy / F.lit(5.0), F.lit(1.0)))
    return py_round(F.least(raw, F.lit(1.0)), 4)


def domain_features(domains: DataFrame, dns_records=None, whois_records=None, tls_observations=None,
                    as_of=None, brand_form: str = "join", with_ips: bool = False, rollups=None,
                    keywords: DataFrame | None = None, suffixes: DataFrame | None = None) -> DataFrame:
    """All domain-level features for a DataFrame of distinct ``domain`` values
    (other input columns are carried along).  ``keywords`` / ``suffixes``: the
    caller's dictionaries (``dimensions.read_*``) instead of the fixed ones."""
    if brand_form == "join" or keywords is not None:
        b = brand_op.brand_features(domains, keywords=keywords)
    else:
        b = brand_op.brand_features_rowlocal(domains)
    t = tld.with_tld_risk(b, suffixes=suffixes)
    i = idn.with_idn(t)
    return enrich.with_enrichment(i, dns_records, whois_records, tls_observations, as_of, with_ips=with_ips,
                                  rollups=rollups)


HOT_DOMAIN_ROWS = 2_000_000
MAX_HOT_DOMAINS = 100_000
SALT_BUCKETS = 64
#: Rows that one task joins back (they get the stored JSON there and are sorted with it); a domain of more is split.
TASK_ROWS = 200_000


def join_back_salted(requests: DataFrame, per_domain: DataFrame, counts: DataFrame, counts_col: str = "_n",
                     hot_domain_rows: int = HOT_DOMAIN_ROWS, max_hot_domains: int = MAX_HOT_DOMAINS,
                     salt_buckets: int = SALT_BUCKETS) -> DataFrame:
    """Left-join per-domain rows back to requests, splitting hot domains.

    A domain is hot when it has at least ``max(min(hot_domain_rows, TASK_ROWS / 4), total /
    max_hot_domains)`` requests, so at most ``max_hot_domains`` domains are
    hot whatever the data: that list is broadcast (proven bound) to tag the
    requests.  Hot domains' rows are replicated over ``salt_buckets`` salts
    (more for a domain of many times ``TASK_ROWS``) and their requests spread by a hash of the whole row (deterministic, so a
    retried task salts identically); every other domain keeps salt 0.  One
    domain holding a third of all requests then lands in ``salt_buckets``
    tasks instead of one.  ``counts`` is the small (checkpointed) per-domain
    request count table ``(domain, counts_col)``; ``per_domain`` carries the
    same count column.

    From as many requests on as ``TASK_ROWS`` a core, the number of partitions is their
    number over ``TASK_ROWS``: the rows grow after the shuffle (features, JSON), so
    partitions of equal bytes before it would hold ever more memory at the sinks' sort.
    """
    total = counts.agg(F.sum(counts_col)).first()[0] or 0
    threshold = max(min(hot_domain_rows, TASK_ROWS // 4), total // max_hot_domains + 1)
    is_hot = F.col(counts_col) >= F.lit(threshold)
    # as many salts as the domain has task-sized shares, at least salt_buckets
    n_salts = F.greatest(F.lit(salt_buckets), F.ceil(F.col(counts_col) / TASK_ROWS)).cast("long")
    hot = counts.filter(is_hot).select("domain", n_salts.alias("_hot"))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in requests.columns]), F.col("_hot")).cast("int")
    req = (requests.join(F.broadcast(hot), "domain", "left")
                   .withColumn("_salt", F.when(F.col("_hot").isNotNull(), salt).otherwise(F.lit(0)))
                   .drop("_hot"))
    salts = F.when(is_hot, F.sequence(F.lit(0), (n_salts - 1).cast("int"))).otherwise(F.array(F.lit(0)))
    dom = per_domain.select("*", F.explode(salts).alias("_salt")).drop(counts_col)
    tasks = -(-total // TASK_ROWS)
    if tasks > requests.sparkSession.sparkContext.defaultParallelism:
        req, dom = (x.repartition(tasks, "domain", "_salt") for x in (req, dom))
    return req.join(dom, ["domain", "_salt"], "left").drop("_salt")


def feature_vector(requests: DataFrame, dns_records=None, whois_records=None, tls_observations=None,
                   as_of=None, url_col: str = "url", brand_form: str = "join",
                   keep_details: bool = False, hot_domain_rows: int = HOT_DOMAIN_ROWS,
                   salt_buckets: int = SALT_BUCKETS, with_ips: bool = False,
                   max_hot_domains: int = MAX_HOT_DOMAINS, rollups=None,
                   keywords: DataFrame | None = None, suffixes: DataFrame | None = None) -> DataFrame:
    """Input columns + ``domain`` + the 38 features (+ detail columns if asked;
    ``with_ips`` adds the resolved IP list)."""
    base = requests.withColumn("domain", domain_key(F.col(url_col)))
    lex = lexical.with_lexical_features(base, url_col)
    counts = materialize(base.groupBy("domain").agg(F.count(F.lit(1)).alias("_n")), "domain_counts")
    dom = domain_features(counts, dns_records, whois_records, tls_observations, as_of, brand_form, with_ips,
                          rollups, keywords, suffixes)
    j = join_back_salted(lex, dom, counts, "_n", hot_domain_rows, max_hot_domains, salt_buckets)
    j = (j.withColumn("visual_similarity_score", F.lit(None).cast(T.DoubleType()))
          .withColumn("dom_credential_form_detected", F.lit(None).cast(T.BooleanType()))
          .withColumn("aggregate_lexical_risk_score",
                      aggregate_lexical_risk(F.col("brand_impersonation_score"), F.col("tld_risk_score"),
                                             F.col("idn_risk_score"), F.col("entropy"))))
    keep = [c for c in requests.columns if c != "domain"] + ["domain", *FEATURE_COLUMNS]
    if keep_details:
        keep += DETAIL_COLUMNS
    if with_ips:
        keep.append("dns_resolved_ips")
    return j.select(*keep)


def feature_vector_rowlocal(requests: DataFrame, dns=None, whois=None, tls_obs=None, as_of=None,
                            url_col: str = "url", keep_details: bool = False, rollups=None,
                            suffixes: DataFrame | None = None) -> DataFrame:
    """Stream-friendly twin: no distinct / aggregation on the request side.

    Brand, TLD and IDN are row-local or joins to fixed broadcast tables; the
    record rollups are static tables joined to the stream (stream-static
    left joins); so is a custom ``suffixes`` table.
    """
    base = requests.withColumn("domain", domain_key(F.col(url_col)))
    lex = lexical.with_lexical_features(base, url_col)
    b = brand_op.brand_features_rowlocal(lex)
    t = tld.with_tld_risk(b, suffixes=suffixes)
    i = idn.with_idn(t)
    e = enrich.with_enrichment(i, dns, whois, tls_obs, as_of, rollups=rollups)
    e = (e.withColumn("visual_similarity_score", F.lit(None).cast(T.DoubleType()))
          .withColumn("dom_credential_form_detected", F.lit(None).cast(T.BooleanType()))
          .withColumn("aggregate_lexical_risk_score",
                      aggregate_lexical_risk(F.col("brand_impersonation_score"), F.col("tld_risk_score"),
                                             F.col("idn_risk_score"), F.col("entropy"))))
    keep = [c for c in requests.columns if c != "domain"] + ["domain", *FEATURE_COLUMNS]
    if keep_details:
        keep += DETAIL_COLUMNS
    return e.select(*keep)


def features_struct() -> Column:
    """The 38 features as one struct (stored as JSON at the sink)."""
    return F.struct(*[F.col(c) for c in FEATURE_COLUMNS])
