"""The batch scan job: requests -> validated -> features -> scan_results + threat_feed.

Sinks (K1-K5): Parquet in ``run_id=<run>/created_date=<UTC date>``, sorted by
domain inside each task's files, so day filters prune partitions and domain
filters skip row groups by min/max.  A run appends: it replaces only what the
same run id wrote before (all its days, also those that are empty now) and
leaves the rows of every other run, so a repeated run is idempotent and none
deletes another's rows.  A run's feed is derived from the scans that the run has
just written, and replaces the feed of the same run.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import features as feat
from ..operators import scoring
from ..sources import fixed_values as FV
from ..sources.tables import CORRUPT

_S = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
      "timestamp": T.TimestampType(), "date": T.DateType()}


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, _S[k]) for n, k in (x.split() for x in text.split(", "))])


SCAN_RESULTS_SCHEMA = _schema(
    "id string, domain string, url string, score int, verdict string, confidence double, category string, "
    "is_zero_day boolean, features_json string, shap_json string, domain_age_days int, registrar string, "
    "ssl_issuer string, visual_similarity double, closest_brand string, incident_id string, "
    "report_generated boolean, created_at timestamp, scan_duration_ms int, run_id string, created_date date")
THREAT_FEED_SCHEMA = _schema("id string, domain string, score int, verdict string, category string, "
                             "flagged_at timestamp, scan_id string, run_id string, flagged_date date")


def new_run_id() -> str:
    """A run id that no other run has."""
    return f"batch-{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"


def run_path(path: str, run_id: str) -> str:
    return f"{path.rstrip('/')}/run_id={run_id}"


@dataclass
class ScanOutputs:
    scans: DataFrame
    feed: DataFrame
    quarantine: DataFrame


def run_scan(requests: DataFrame, dns=None, whois=None, tls_obs=None, as_of=None, category_rules=None,
             zero_day=None, blacklist=None, scorer=scoring.rule_scorer, rowlocal: bool = False,
             medium: int = FV.MEDIUM_RISK_THRESHOLD, keywords: DataFrame | None = None,
             suffixes: DataFrame | None = None) -> ScanOutputs:
    """Plan the whole job.  Only the per-domain request counts run here (they
    decide the salting); the rest runs at a sink or an action."""
    v = scoring.validate_json(requests) if CORRUPT in requests.columns else scoring.validate(requests)
    ok = scoring.accepted(v).drop(CORRUPT)
    scans = scoring.scan_results(ok, dns, whois, tls_obs, as_of, category_rules, zero_day, blacklist,
                                 scorer, rowlocal=rowlocal, keywords=keywords, suffixes=suffixes)
    return ScanOutputs(scans, scoring.threat_feed(scans, medium), scoring.rejected(v))


MAX_RECORDS_PER_FILE = 5_000_000
#: A Bloom filter on the id of the size that a file's ids need (a plain one takes 1 MB however few rows a file has).
ID_BLOOM = {"parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.adaptive.enabled": "true",
            "parquet.bloom.filter.candidates.number#id": "10"}


def _write_run(rows: DataFrame, path: str, run_id: str, day: str, time: str) -> None:
    """Replace one run's rows: days below the run's folder, sorted by (day, domain) within each task.

    No extra shuffle: the rows arrive hash-partitioned by ``(domain, salt)``
    from the feature join-back, so each task holds a subset of domains (a hot
    domain is already split over salts), and sorting makes row groups narrow in
    ``domain``.  A Bloom filter on the id lets lookups by id skip files.
    """
    (rows.withColumn(day, F.to_date(time))
         .sortWithinPartitions(day, "domain")
         .write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
         .option("partitionOverwriteMode", "static")
         .options(**ID_BLOOM)
         .partitionBy(day).parquet(run_path(path, run_id)))


def write_scan_results(scans: DataFrame, path: str, run_id: str) -> None:
    """K1/K4/K5: append a run's scans (a repeated run id replaces its own)."""
    _write_run(scans, path, run_id, "created_date", "created_at")


def write_threat_feed(feed: DataFrame, path: str, run_id: str) -> None:
    """K2: append a run's feed rows (a repeated run id replaces its own)."""
    _write_run(feed, path, run_id, "flagged_date", "flagged_at")


def write_run(spark: SparkSession, scans: DataFrame, scans_path: str, feed_path: str, run_id: str,
              medium: int = FV.MEDIUM_RISK_THRESHOLD) -> None:
    """K3: a run's scans, then its feed from the scans as they were written."""
    write_scan_results(scans, scans_path, run_id)
    own = T.StructType([f for f in SCAN_RESULTS_SCHEMA.fields if f.name != "run_id"])
    written = spark.read.schema(own).parquet(run_path(scans_path, run_id))
    write_threat_feed(scoring.threat_feed(written, medium), feed_path, run_id)


def write_quarantine(rejected: DataFrame, path: str, run_id: str) -> None:
    """Rejected requests with their ``reject_reason``; a repeated run id replaces its own."""
    (rejected.withColumn("request_date", F.to_date("ts"))
             .write.mode("overwrite").option("partitionOverwriteMode", "static")
             .partitionBy("request_date").parquet(run_path(path, run_id)))


def read_scan_results(spark: SparkSession, path: str, parse_features: bool = False) -> DataFrame:
    """The scan table; optionally parse ``features_json`` / ``shap_json`` back
    into ``features`` (struct of the 38 columns) and ``shap`` (array of structs)."""
    df = spark.read.schema(SCAN_RESULTS_SCHEMA).parquet(path)
    if parse_features:
        df = (df.withColumn("features", F.from_json("features_json", feat.FEATURE_SCHEMA))
                .withColumn("shap", F.from_json("shap_json", scoring.SHAP_SCHEMA)))
    return df


def read_threat_feed(spark: SparkSession, path: str) -> DataFrame:
    """The threat feed table."""
    return spark.read.schema(THREAT_FEED_SCHEMA).parquet(path)
