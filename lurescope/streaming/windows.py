"""T-3: daily statistics over event-time windows, each day emitted once.

A day's sums live in the state store until the watermark passes the end of the
day; a timer then emits them, and the day is closed for good.  A scan that arrives
for a closed day is not counted and not lost: it comes out marked late, and the
sink writes it to a table of its own, so counted + late = input.

The state is keyed by (day, part): the parts of a day, chosen by a hash of the
scan id, keep one busy day from being one task.  A closed part is a row, so a day
has at most PARTS rows in the table of closed days; they add up on reading.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import py_round
from ..plans.scan_job import run_path
from ..sources import fixed_values as FV
from .scan_stream import _drain, stream_id

DAY_US = 86_400_000_000
PARTS = 16
#: Confidences are summed as integers of this unit (exact, whatever the order).
UNIT = 10 ** 12
OUTPUT = "kind string, day date, threats long, n long, confidence decimal(38,0), zero_days long, scans long, id string, at long"


class DayProcessor(StatefulProcessor):
    """Sums per (day, part); rows of a closed day go out as late."""

    def __init__(self, medium: int) -> None:
        self.medium = medium

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the sum of confidences as text: it may pass 63 bits
        self.sums = handle.getValueState("sums", "threats long, n long, confidence string, zero_days long, scans long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        end_us = (int(key[0]) + 1) * DAY_US
        if end_us <= timerValues.getCurrentWatermarkInMs() * 1000:
            for frame in rows:
                yield self._out("late", key, ids=frame["id"].tolist(), at=frame["at"].tolist())
            return
        threats, n, confidence, zero_days, scans = self._held()
        for frame in rows:
            known = frame["confidence_units"].dropna()
            threats += int((frame["score"] >= self.medium).sum())
            n += len(known)
            confidence += sum(int(x) for x in known)
            zero_days += int(frame["zero_day"].sum())
            scans += len(frame)
        if not self.sums.exists():
            self.handle.registerTimer(end_us // 1000)
        self.sums.update((threats, n, str(confidence), zero_days, scans))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.sums.exists():
            yield self._out("closed", key, sums=self._held())
            self.sums.clear()

    def _held(self) -> tuple[int, int, int, int, int]:
        if not self.sums.exists():
            return 0, 0, 0, 0, 0
        s = self.sums.get()
        return int(s[0]), int(s[1]), int(s[2]), int(s[3]), int(s[4])

    def _out(self, kind, key, sums=None, ids=(None,), at=(None,)) -> pd.DataFrame:
        import datetime
        import decimal
        size = len(ids)
        day = datetime.date(1970, 1, 1) + datetime.timedelta(days=int(key[0]))
        t, n, c, z, s = sums or (None,) * 5
        c = None if c is None else decimal.Decimal(c)
        return pd.DataFrame({
            "kind": [kind] * size, "day": [day] * size, "threats": pd.array([t] * size, "Int64"), "n": pd.array([n] * size, "Int64"),
            "confidence": pd.Series([c] * size, dtype=object), "zero_days": pd.array([z] * size, "Int64"),
            "scans": pd.array([s] * size, "Int64"), "id": pd.Series(list(ids), dtype=object), "at": pd.array(list(at), "Int64")})

    def close(self) -> None:
        pass


def closed_days_stream(scans: DataFrame, delay: str = "1 day", medium: int = FV.MEDIUM_RISK_THRESHOLD, parts: int = PARTS) -> DataFrame:
    """Rows of ``kind`` closed (a part of a day whose window has ended) and late (a scan of a day that was closed).

    Scans without a time belong to no day and are left out, like those of a null ``created_at`` in the batch statistics.
    """
    at = F.col("created_at").cast("timestamp")
    marked = scans.withColumn("created_at", at).filter(F.col("created_at").isNotNull()).withWatermark("created_at", delay)
    # the time goes on as a number: rows behind the watermark must reach the processor, which routes them
    rows = marked.select(
        F.floor(F.unix_micros("created_at") / DAY_US).cast("int").alias("day_no"),
        F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", F.unix_micros("created_at").alias("at"),
        F.coalesce("score", F.lit(0)).alias("score"),
        F.round(F.col("confidence").cast("decimal(30,12)") * UNIT).cast("long").alias("confidence_units"),
        F.coalesce("is_zero_day", F.lit(False)).alias("zero_day"))
    return rows.groupBy("day_no", "part").transformWithStateInPandas(
        statefulProcessor=DayProcessor(medium), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def write_closed_days(scans: DataFrame, closed_path: str, late_path: str, checkpoint: str, delay: str = "1 day",
                      medium: int = FV.MEDIUM_RISK_THRESHOLD, available_now: bool = True, timeout_s: int | None = None):
    """Append closed days to one table and late scans to another; a retried micro-batch replaces its own rows."""
    spark = scans.sparkSession

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            run = f"{stream_id(spark, checkpoint)}-{batch_id}"
            closed = batch.filter("kind = 'closed'").select("day", "threats", "n", "confidence", "zero_days", "scans")
            late = batch.filter("kind = 'late'").select("day", "id", F.timestamp_micros("at").alias("created_at"))
            closed.write.mode("overwrite").parquet(run_path(closed_path, run))
            late.write.mode("overwrite").parquet(run_path(late_path, run))
        finally:
            batch.unpersist()

    return _drain(closed_days_stream(scans, delay, medium), run_batch, checkpoint, available_now, timeout_s)


def closed_day_stats(spark: SparkSession, closed_path: str) -> DataFrame:
    """Per closed day: feed-worthy scans, average confidence x100, zero-day scans, all scans."""
    g = spark.read.parquet(closed_path).groupBy("day").agg(
        F.sum("threats").alias("threats"), F.sum("n").alias("_n"), F.sum("confidence").alias("_c"),
        F.sum("zero_days").alias("zero_day_count"), F.sum("scans").alias("scans"))
    mean = F.when(F.col("_n") > 0, F.col("_c").cast("double") / F.lit(float(UNIT)) / F.col("_n")).otherwise(0.0)
    return g.select("day", F.col("threats").cast("long").alias("threats"), py_round(mean * F.lit(100.0), 1).alias("avg_confidence"),
                    F.col("zero_day_count").cast("long").alias("zero_day_count"), F.col("scans").cast("long").alias("scans"))
