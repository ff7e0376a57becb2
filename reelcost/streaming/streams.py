"""Structured Streaming forms of the windowed operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def tumbling_means(stream: DataFrame, ts: str, width: str, cols: Sequence[str], keys: Sequence[str] = (), late: str = "10 minutes") -> DataFrame:
    """Mean per fixed window; rows later than the watermark are dropped."""
    src = stream.withWatermark(ts, late) if stream.isStreaming else stream
    agg = src.groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in cols])
    return agg.select(F.col("window.start").alias("start"), *keys, "n", *cols)


def sliding_stats(stream: DataFrame, ts: str, width: str, slide: str, col: str, keys: Sequence[str] = (), late: str = "10 minutes") -> DataFrame:
    """Mean and deviation over overlapping windows."""
    src = stream.withWatermark(ts, late) if stream.isStreaming else stream
    agg = src.groupBy(F.window(ts, width, slide), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"))
    return agg.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "mean", "std")


def gap_sessions(stream: DataFrame, ts: str, gap: str, col: str, keys: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """Sessions that close after a gap. Spark joins two rows only when they are less than the gap apart."""
    src = stream.withWatermark(ts, late) if stream.isStreaming else stream
    agg = src.groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(col).alias("mean"))
    return agg.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n", "mean")


def unique_rows(stream: DataFrame, ts: str, keys: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """First row per key among rows that arrive within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


TURNUP_SCHEMA = "machine string, reel_id long, ts timestamp, value double, n_rows long"


class TurnupEmitter(StatefulProcessor):
    """Emits a machine's turn-up row when its reel id changes.

    State holds the last two rows of the open reel only. Rows of one machine must come in time
    order across batches. An open reel is closed by a timer after ``idle_ms`` without rows.
    """

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts timestamp, value double")
        self.before = handle.getValueState("before", "ts timestamp, value double")
        self.open = handle.getValueState("open", "reel_id long, seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        machine = key[0]
        reel, seen = self.open.get() if self.open.exists() else (None, 0)
        last = self.last.get() if self.last.exists() else None
        before = self.before.get() if self.before.exists() else None
        out: list = []
        pdf = pd.concat(list(rows)).sort_values(["ts", "reel_id"])
        for ts, reel_id, value in zip(pdf["ts"], pdf["reel_id"], pdf["value"]):
            if seen and reel != reel_id:
                out.append((machine, reel, *(before if seen > 1 else last), seen))
                seen = 0
            before = last if seen else None
            last, reel, seen = (ts.to_pydatetime(), float(value)), int(reel_id), seen + 1
        self.open.update((reel, seen))
        self.last.update(last)
        if before is None:
            self.before.clear()
        else:
            self.before.update(before)
        if self.idle_ms is not None:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["machine", "reel_id", "ts", "value", "n_rows"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.open.exists():
            reel, seen = self.open.get()
            out.append((key[0], reel, *(self.before if seen > 1 else self.last).get(), seen))
        for s in (self.open, self.last, self.before):
            s.clear()
        yield pd.DataFrame(out, columns=["machine", "reel_id", "ts", "value", "n_rows"])

    def close(self) -> None:
        pass


def turnup_stream(stream: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Turn-up rows of a stream with (machine, reel_id, ts, value)."""
    src = stream.select("machine", "reel_id", "ts", "value")
    return src.groupBy("machine").transformWithStateInPandas(
        statefulProcessor=TurnupEmitter(idle_ms),
        outputStructType=TURNUP_SCHEMA,
        outputMode="Append",
        # Timers keep a stream busy for ever, so they are only switched on when they are wanted.
        timeMode="None" if idle_ms is None else "ProcessingTime",
    )
