"""T-4: one scan per domain and hour as a rolling window, in keyed streaming state.

A request needs a new scan only if its domain had none in the ``ttl`` before it,
by event time; any other request reuses the scan that is still valid.  The
decision depends on the order of the requests, which arrive out of order, so a
request waits in the state until the watermark has passed it: from then on every
earlier one has been seen.  Timers (event time) settle the waiting requests of a
domain and drop its last scan when that can't be reused any more, so a quiet
domain keeps no state.

State per domain: the waiting requests (a list in the state store, at most those
of the watermark delay) and the time and id of the last scan.  Only requests of
one domain in one micro-batch meet in one task; ``maxFilesPerTrigger`` bounds
them, and several requests of the same instant wait as one row of the list.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.url import domain_key
from ..operators import scoring

#: Seconds for which a domain's scan is reused.
REUSE_SECONDS = 3600
OUTPUT = "domain string, request_id long, at long, scan_id long, scan_at long"


class ReuseProcessor(StatefulProcessor):
    """Decides per domain, in order of (time, request id), which requests are scanned."""

    def __init__(self, ttl_seconds: int = REUSE_SECONDS) -> None:
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, ids array<long>")
        self.scan = handle.getValueState("scan", "at long, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[int, list[int]] = {}
        for frame in rows:
            for at, request in zip(frame["at"].tolist(), frame["request_id"].tolist()):
                fresh.setdefault(int(at), []).append(int(request))
        if fresh:
            self.waiting.appendList([(at, sorted(ids)) for at, ids in fresh.items()])
            self._wake(min(fresh))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        scan = tuple(self.scan.get()) if self.scan.exists() else None
        held = [(int(w[0]), [int(i) for i in w[1]]) for w in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((at, request) for at, ids in held if at <= passed for request in ids)
        out = []
        for at, request in due:
            if scan is None or at - scan[0] >= self.ttl:
                scan = (at, request)
            out.append((key[0], request, at, scan[1], scan[0]))
        later = [w for w in held if w[0] > passed]
        if due:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if later:
            self._wake(min(at for at, _ in later))
        if scan is not None and scan[0] + self.ttl <= passed:
            self.scan.clear()  # every request that may still come is later than its window
        elif scan is not None:
            self.scan.update(scan)
            self._wake(scan[0] + self.ttl)
        if out:
            yield pd.DataFrame(out, columns=["domain", "request_id", "at", "scan_id", "scan_at"])

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))  # the first millisecond that isn't before it

    def close(self) -> None:
        pass


def reuse_stream(requests: DataFrame, delay: str = "1 hour", ttl_seconds: int = REUSE_SECONDS) -> DataFrame:
    """``domain, request_id, ts, scan_id, scan_ts, fresh``: the scan that answers each valid request.

    ``fresh`` marks the requests that are scanned themselves (``scan_id`` is the
    request id of the scan).  A request later than ``delay`` behind the newest
    one of the micro-batches before is dropped by the watermark, as are requests
    without a time or before 1970.  Needs the RocksDB state store (``state_store_conf``).
    """
    # the watermark also moves by requests that are rejected and by rows without a URL (heartbeats)
    marked = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    # (a filter that doesn't read the time would be pushed below the watermark and hide them)
    known_time = F.when(F.col("ts").isNull() | (F.unix_micros("ts") < 0), F.lit("time"))
    ok = scoring.validate(marked).filter(F.coalesce("reject_reason", known_time).isNull()).select(
        domain_key(F.col("url")).alias("domain"), "request_id", "ts", F.unix_micros("ts").alias("at"))
    plan = ok.groupBy("domain").transformWithStateInPandas(
        statefulProcessor=ReuseProcessor(ttl_seconds), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
    return plan.select("domain", "request_id", F.timestamp_micros("at").alias("ts"), "scan_id",
                       F.timestamp_micros("scan_at").alias("scan_ts"), (F.col("request_id") == F.col("scan_id")).alias("fresh"))


def state_store_conf(spark) -> None:
    """The state store that keyed state with several variables needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
