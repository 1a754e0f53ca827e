"""Read queries over ``scan_results`` / ``threat_feed``: feed page, daily stats,
lookup by id, incident report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_round
from ..sources import fixed_values as FV


def _as_of(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of
    if as_of is None:
        return F.current_timestamp()
    return F.lit(as_of).cast("timestamp")


def feed_page(feed: DataFrame, page: int = 1, limit: int = FV.FEED_DEFAULT_LIMIT,
              category: str | None = None) -> DataFrame:
    """Newest feed rows first, ``limit`` per page.

    Category filter first (skipped when absent or empty), then order by
    ``flagged_at`` desc with ``id`` as tie-break, then offset/limit.  Spark
    plans this as a per-partition top-(offset+limit) and one small merge.
    """
    if not isinstance(limit, int) or limit < 0 or limit > FV.FEED_MAX_LIMIT:
        raise ValueError(f"limit must be an integer in 0..{FV.FEED_MAX_LIMIT}")
    if not isinstance(page, int) or page < 1:
        raise ValueError("page must be an integer >= 1")
    df = feed
    if category:
        df = df.filter(F.col("category") == F.lit(category))
    offset = (page - 1) * limit
    ordered = df.select("id", "domain", "score", "verdict", "category", "flagged_at", "scan_id") \
                .orderBy(F.col("flagged_at").desc(), F.col("id").asc())
    if offset:
        ordered = ordered.offset(offset)
    return ordered.limit(limit)


def feed_page_after(feed: DataFrame, after_flagged_at=None, after_id: str | None = None,
                    limit: int = FV.FEED_DEFAULT_LIMIT, category: str | None = None) -> DataFrame:
    """Keyset page: the ``limit`` newest rows strictly after the cursor
    ``(flagged_at, id)`` of the previous page's last row.

    Same order as ``feed_page``, but the cost is a top-``limit`` at any
    depth (``flagged_at`` bounds also prune date partitions of the table).
    """
    if not isinstance(limit, int) or limit < 0 or limit > FV.FEED_MAX_LIMIT:
        raise ValueError(f"limit must be an integer in 0..{FV.FEED_MAX_LIMIT}")
    df = feed
    if category:
        df = df.filter(F.col("category") == F.lit(category))
    if after_flagged_at is not None:
        ts = F.lit(after_flagged_at).cast("timestamp")
        if "flagged_date" in df.columns:
            df = df.filter(F.col("flagged_date") <= F.to_date(ts))
        df = df.filter((F.col("flagged_at") < ts) |
                       ((F.col("flagged_at") == ts) & (F.col("id") > F.lit(after_id or ""))))
    return (df.select("id", "domain", "score", "verdict", "category", "flagged_at", "scan_id")
              .orderBy(F.col("flagged_at").desc(), F.col("id").asc()).limit(limit))


def daily_stats(feed: DataFrame, scans: DataFrame, as_of=None) -> DataFrame:
    """One row -- threats since UTC midnight of ``as_of``, average
    confidence x100 (1 decimal, 0 when no scans), zero-day scans, cert alerts 0.

    Both tables go through one global aggregate over a tagged union: each
    partition pre-aggregates, one task merges a row per partition.
    """
    day = F.date_trunc("DAY", _as_of(as_of))
    # Tables written by the sinks carry their UTC date as a partition column:
    # bounding it lets the scan skip every earlier day's files.
    if "flagged_date" in feed.columns:
        feed = feed.filter(F.col("flagged_date") >= F.to_date(day))
    if "created_date" in scans.columns:
        scans = scans.filter(F.col("created_date") >= F.to_date(day))
    f = feed.select(F.lit(True).alias("_feed"), F.col("flagged_at").alias("_ts"),
                    F.lit(None).cast("double").alias("_conf"), F.lit(False).alias("_zd"))
    s = scans.select(F.lit(False).alias("_feed"), F.col("created_at").alias("_ts"),
                     F.col("confidence").cast("double").alias("_conf"),
                     F.col("is_zero_day").alias("_zd"))
    one_row = f.unionByName(s).filter(F.col("_ts") >= day).agg(
        F.count_if(F.col("_feed")).alias("threats_today"),
        F.avg(F.when(~F.col("_feed"), F.col("_conf"))).alias("_avg"),
        F.count_if(~F.col("_feed") & F.col("_zd")).alias("zero_day_count"))
    return one_row.select(
        F.col("threats_today").cast("long").alias("threats_today"),
        py_round(F.coalesce(F.col("_avg"), F.lit(0.0)) * F.lit(100.0), 1).alias("avg_confidence"),
        F.col("zero_day_count").cast("long").alias("zero_day_count"),
        F.lit(FV.CERT_ALERTS_COUNT).cast("long").alias("cert_alerts_count"),
    )


def scan_by_id(scans: DataFrame, scan_id: str) -> DataFrame:
    """At most one row; the equality filter reaches the Parquet scan."""
    return scans.filter(F.col("id") == F.lit(scan_id))


def scans_by_ids(scans: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """P14 for many ids at once: a left-semi join (no duplicates from ``ids``)."""
    return scans.join(ids.select(F.col(id_col).alias("id")), "id", "left_semi")


def incident_report(scans: DataFrame) -> DataFrame:
    """``(incident_id, domain, score, verdict, status)`` for every scan given
    (filter first with ``scan_by_id`` for one report)."""
    return scans.select(
        F.concat(F.lit(FV.INCIDENT_ID_PREFIX), F.upper(F.substring("id", 1, 4))).alias("incident_id"),
        "domain", "score", "verdict",
        F.lit(FV.REPORT_STATUS).alias("status"),
    )
