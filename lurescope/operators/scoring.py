"""Request validation, rule score, verdicts, scan-result rows and the threat feed."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_strip, regex_alternation
from ..functions.url import bad_netloc, domain_key
from ..sources import fixed_values as FV
from . import blacklist as blacklists
from . import features as feat

SCAN_RESULT_COLUMNS = [
    "id", "domain", "url", "score", "verdict", "confidence", "category", "is_zero_day",
    "features_json", "shap_json", "domain_age_days", "registrar", "ssl_issuer",
    "visual_similarity", "closest_brand", "incident_id", "report_generated", "created_at",
    "scan_duration_ms",
]
THREAT_FEED_COLUMNS = ["id", "domain", "score", "verdict", "category", "flagged_at", "scan_id"]

SHAP_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("feature", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("shap_value", T.DoubleType()),
    T.StructField("direction", T.StringType()),
]))


# ------------------------------------------------------------------- P1

def validate(requests: DataFrame, url_col: str = "url") -> DataFrame:
    """Strip, reject empty / over 500 characters / unparsable netloc, add
    ``https://`` unless the text starts with ``http://`` or ``https://``.

    Returns the input with ``url`` replaced by the normalised URL and a
    ``reject_reason`` column (null for accepted rows).  Use ``accepted`` /
    ``rejected`` to split; both are filters of one plan.
    """
    v = py_strip(F.col(url_col))
    norm = F.concat(F.when(v.rlike("^https?://"), F.lit("")).otherwise(F.lit("https://")), v)
    reason = (F.when(F.col(url_col).isNull() | (F.length(v) == 0), F.lit("empty"))
               .when(F.length(v) > FV.MAX_URL_LENGTH, F.lit("too_long"))
               .when(bad_netloc(v), F.lit("bad_netloc")))
    return (requests.withColumn("reject_reason", reason)
                    .withColumn(url_col, F.when(F.col("reject_reason").isNull(), norm)))


def validate_json(requests: DataFrame, corrupt: str = "_corrupt") -> DataFrame:
    """P1 for JSON requests (``read_json_requests``): a line that isn't a request is rejected as malformed and keeps its text."""
    v = validate(requests)
    reason = F.when(F.col(corrupt).isNotNull(), F.lit("malformed")).otherwise(F.col("reject_reason"))
    return v.withColumn("reject_reason", reason)


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reject_reason").isNotNull())


# ------------------------------------------------------------- P11 - P13

def rule_score(domain: Column) -> Column:
    """85 when the domain contains any rule word, else 12."""
    return (F.when(domain.rlike(regex_alternation(FV.RULE_SCORE_WORDS)), F.lit(FV.RULE_SCORE_HIT))
             .otherwise(F.lit(FV.RULE_SCORE_MISS)))


def verdict(score: Column, high: int = FV.HIGH_RISK_THRESHOLD, medium: int = FV.MEDIUM_RISK_THRESHOLD) -> Column:
    """PHISHING >= high (70), SUSPICIOUS >= medium (40), else SAFE."""
    return (F.when(score >= high, F.lit("PHISHING"))
             .when(score >= medium, F.lit("SUSPICIOUS"))
             .otherwise(F.lit("SAFE")))


def rule_scorer(df: DataFrame, high: int = FV.HIGH_RISK_THRESHOLD, medium: int = FV.MEDIUM_RISK_THRESHOLD) -> DataFrame:
    """U2 default scorer: adds ``score`` INT, ``verdict``, ``confidence``.

    Any ``DataFrame -> DataFrame`` adding the same three columns can replace
    it (a Spark ML model's ``transform``, a pandas UDF, ...).  A scorer may
    also add any of ``SCORER_OUTPUTS``; the scan rows keep what it adds.
    """
    s = rule_score(F.col("domain"))
    return (df.withColumn("score", s.cast("int"))
              .withColumn("verdict", verdict(F.col("score"), high, medium))
              .withColumn("confidence", F.col("score") / F.lit(100.0)))


#: Optional scorer columns that replace the defaults of a scan row (``shap``: SHAP_SCHEMA).
SCORER_OUTPUTS = ["category", "is_zero_day", "domain_age_days", "registrar", "ssl_issuer", "visual_similarity",
                  "closest_brand", "shap"]


# ----------------------------------------------------------- P20, J8

def categorize(domain: Column, rules: list[tuple[str, str]] | None, default: str = "generic") -> Column:
    """P20: first matching ``(regex, category)`` rule on the domain, else ``default``."""
    if not rules:
        return F.lit(default)
    out = None
    for pattern, cat in rules:
        out = (F.when(domain.rlike(pattern), F.lit(cat)) if out is None
               else out.when(domain.rlike(pattern), F.lit(cat)))
    return out.otherwise(F.lit(default))


def with_category_by_brand(df: DataFrame, brand_categories: DataFrame, default: str = "generic",
                           brand_col: str = "closest_brand") -> DataFrame:
    """P20, join form: ``category`` from a caller-supplied ``(brand, category)``
    table via the row's closest brand; ``default`` when no brand or no entry.

    A left equi join; the planner broadcasts the brand table when its size
    allows (one row per brand of the dictionary).
    """
    cats = brand_categories.select(F.col("brand").alias("_cb"), F.col("category").alias("_cat"))
    j = df.join(cats, F.col(brand_col) == F.col("_cb"), "left")
    out = j.withColumn("_category", F.coalesce(F.col("_cat"), F.lit(default))).drop("_cb", "_cat")
    if "category" in df.columns:
        out = out.drop("category")
    return out.withColumnRenamed("_category", "category")


def with_zero_day(df: DataFrame, blacklist: DataFrame | blacklists.Screen | None = None, flag: Column | None = None,
                  domains: DataFrame | None = None) -> DataFrame:
    """``is_zero_day`` = domain not in a known blacklist (left join on domain),
    or a caller-supplied flag expression; false when neither is given.

    A ``blacklist.Screen`` also covers the hosts below a listed domain; ``domains`` then spares
    computing ``df`` a second time for its distinct domains.
    """
    if blacklist is None:
        return df.withColumn("is_zero_day", flag if flag is not None else F.lit(False))
    if isinstance(blacklist, blacklists.Screen):
        known = blacklists.listed_domains(df if domains is None else domains, blacklist)
    else:
        known = blacklist.select("domain").distinct()
    bl = known.select(F.col("domain").alias("_bl"))  # one row per domain: the join adds none
    return (df.join(bl, F.col("domain") == F.col("_bl"), "left")
              .withColumn("is_zero_day", F.col("_bl").isNull()).drop("_bl"))


# --------------------------------------------------------------- P18, K2

def uuid_from(key: Column, namespace: str) -> Column:
    """A replay-safe UUID-shaped id: a re-run of the same request gets the same id."""
    h = F.sha2(F.concat(F.lit(namespace + ":"), key.cast("string")), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def scan_results(requests: DataFrame, dns=None, whois=None, tls_obs=None, as_of=None,
                 category_rules=None, zero_day: Column | None = None, blacklist: DataFrame | blacklists.Screen | None = None,
                 scorer: Callable[[DataFrame], DataFrame] = rule_scorer, brand_form: str = "join",
                 rowlocal: bool = False, rollups: DataFrame | None = None, keywords: DataFrame | None = None,
                 suffixes: DataFrame | None = None) -> DataFrame:
    """Validated requests ``(request_id, ts, url, ...)`` -> ``scan_results`` rows.

    ``url`` must already be validated (see ``validate``).  ``score`` comes
    from ``scorer``; the 38 features go to ``features_json``; registrar, TLS
    issuer, domain age and closest brand are filled from the features.  A custom
    brand dictionary needs shuffles, so ``rowlocal`` refuses ``keywords``.
    """
    if rowlocal:
        if keywords is not None:
            raise ValueError("the row-local form has only the built-in brand dictionary: keywords needs rowlocal=False")
        f = feat.feature_vector_rowlocal(requests, dns, whois, tls_obs, as_of, keep_details=True,
                                         rollups=rollups, suffixes=suffixes)
    else:
        f = feat.feature_vector(requests, dns, whois, tls_obs, as_of, brand_form=brand_form,
                                keep_details=True, rollups=rollups, keywords=keywords, suffixes=suffixes)
    plain = set(f.columns)
    f = scorer(f)
    # closest_brand and ssl_issuer are also feature details: a scorer replaces them in place
    scored = {c for c in SCORER_OUTPUTS if c in f.columns and c not in plain}
    if "is_zero_day" not in scored:
        f = with_zero_day(f, blacklist, zero_day, requests.select(domain_key(F.col("url")).alias("domain")))

    def pick(name: str, default: Column) -> Column:
        return F.col(name) if name in scored else default

    return f.select(
        uuid_from(F.col("request_id"), "scan").alias("id"),
        "domain", "url",
        F.col("score").cast("int").alias("score"),
        "verdict",
        F.col("confidence").cast("double").alias("confidence"),
        pick("category", categorize(F.col("domain"), category_rules)).alias("category"),
        F.col("is_zero_day").cast("boolean").alias("is_zero_day"),
        F.to_json(feat.features_struct(), {"ignoreNullFields": "false"}).alias("features_json"),
        (F.coalesce(F.to_json("shap"), F.lit("[]")) if "shap" in scored else F.lit("[]")).alias("shap_json"),
        pick("domain_age_days", F.col("whois_domain_age_days")).cast("int").alias("domain_age_days"),
        pick("registrar", F.col("whois_registrar")).alias("registrar"),
        "ssl_issuer",
        pick("visual_similarity", F.col("visual_similarity_score")).cast("double").alias("visual_similarity"),
        "closest_brand",
        F.lit(None).cast("string").alias("incident_id"),
        F.lit(False).alias("report_generated"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.lit(None).cast("int").alias("scan_duration_ms"),
    )


def threat_feed(scans: DataFrame, medium: int = FV.MEDIUM_RISK_THRESHOLD) -> DataFrame:
    """K2: one feed row per scan with ``score >= medium`` (40), derived from ``scan_results``
    (one source of truth, so the two tables cannot disagree)."""
    return (scans.filter(F.col("score") >= medium)
                 .select(uuid_from(F.col("id"), "feed").alias("id"), "domain", "score", "verdict",
                         "category", F.col("created_at").alias("flagged_at"),
                         F.col("id").alias("scan_id")))


def feed_of_requests(requests: DataFrame, category_rules=None, scorer: Callable[[DataFrame], DataFrame] = rule_scorer,
                     medium: int = FV.MEDIUM_RISK_THRESHOLD) -> DataFrame:
    """The threat feed of validated requests, for scorers that need only ``domain`` and ``url``.

    Row-local: no feature is computed, nothing is joined or shuffled.  The rows
    are those of ``threat_feed(scan_results(...))`` with the same scorer.
    """
    f = scorer(requests.withColumn("domain", domain_key(F.col("url"))))
    category = F.col("category") if "category" in f.columns else categorize(F.col("domain"), category_rules)
    return threat_feed(f.select(uuid_from(F.col("request_id"), "scan").alias("id"), "domain", F.col("score").cast("int").alias("score"),
                                "verdict", category.alias("category"), F.col("ts").cast("timestamp").alias("created_at")), medium)
