"""Turn-up rows and break edges of machines whose rows reach the stream out of order.

Rows wait in time slots until the watermark has passed a slot's end; then the slot is read in time order by a small state
machine that carries a machine's last two rows over to the next slot. So rows may be late by the watermark's delay, in any
order and file, and the result is the one of the batch operators on the rows of all finished slots.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROW = np.dtype([("us", "i8"), ("tie", "i8"), ("reel_id", "i8"), ("code", "f8"), ("power", "f8"), ("value", "f8")])
OUT_COLUMNS = ["machine", "kind", "reel_id", "us", "value", "n_rows"]
OUT_SCHEMA = "machine string, kind string, reel_id long, us long, value double, n_rows long"


@dataclass
class Carry:
    """What a machine's next row needs of the rows before it: the open reel, the last row and the one before it in the reel."""

    reel_id: int
    n_rows: int
    broken: bool
    us: int
    code: float
    power: float
    value: float
    before_us: int
    before_value: float


CARRY_SCHEMA = "reel_id long, n_rows long, broken boolean, us long, code double, power double, value double, before_us long, before_value double"


def read_in_order(last: Carry | None, rows: np.ndarray, level: float) -> tuple[Carry | None, list[tuple]]:
    """Events (kind, reel, time, value, rows of the reel) of rows in time order, and what is to be carried on.

    A reel ends with a row of another reel: its last but one row is the turn-up row, or its only one. A reel has a break edge
    when its code falls to zero or its power is above the level and below it in the machine's next row; the first edge counts.
    """
    out = []
    for us, _, reel, code, power, value in rows.tolist():
        seen, broken = 0, False
        if last is not None:
            if last.power > level > power and not last.broken:
                out.append(("break", last.reel_id, last.us, None, None))
                last.broken = True
            if reel == last.reel_id:
                seen, broken = last.n_rows, last.broken
            else:
                at, held = (last.before_us, last.before_value) if last.n_rows > 1 else (last.us, last.value)
                out.append(("turnup", last.reel_id, at, None if np.isnan(held) else held, last.n_rows))
            if code == 0 and last.code == last.code and last.code != 0 and not broken:
                out.append(("break", reel, us, None, None))
                broken = True
        before = (last.us, last.value) if seen else (us, value)
        last = Carry(reel, seen + 1, broken, us, code, power, value, *before)
    return last, out


class ReelEvents(StatefulProcessor):
    """One machine's waiting rows by slot and its carry. A timer at a slot's end reads the slot."""

    def __init__(self, level: float, slot_ms: int):
        self.level, self.slot_ms = level, slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long", "rows binary")
        self.carry = handle.getValueState("carry", CARRY_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            packed = np.empty(len(pdf), ROW)
            for name in ROW.names:
                packed[name] = pdf[name].to_numpy()
            slots = packed["us"] // (self.slot_ms * 1000)
            for slot in np.unique(slots).tolist():
                held = self.waiting.getValue((slot,))
                self.waiting.updateValue((slot,), ((bytes(held[0]) if held else b"") + packed[slots == slot].tobytes(),))
                self.handle.registerTimer((slot + 1) * self.slot_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # The first timer reads all finished slots in order, the others of this batch find theirs gone.
        if not self.waiting.containsKey((expiredTimerInfo.getExpiryTimeInMs() // self.slot_ms - 1,)):
            return
        passed = timerValues.getCurrentWatermarkInMs()
        done = sorted(slot for (slot,) in list(self.waiting.keys()) if (slot + 1) * self.slot_ms <= passed)
        last = Carry(*self.carry.get()) if self.carry.exists() else None
        for slot in done:
            rows = np.frombuffer(bytes(self.waiting.getValue((slot,))[0]), ROW)
            last, events = read_in_order(last, np.sort(rows, order=["us", "tie"]), self.level)
            self.waiting.removeKey((slot,))
            if events:
                yield pd.DataFrame([(key[0], *e) for e in events], columns=OUT_COLUMNS).astype({"value": "float64", "n_rows": "Int64"})
        if last is not None:
            self.carry.update(astuple(last))

    def close(self) -> None:
        pass


def reel_event_stream(stream: DataFrame, ts: str = "ts", late: str = "6 hours", level: float = 50.0, slot_ms: int = 3_600_000) -> DataFrame:
    """Events of a stream of (machine, reel_id, ``ts``, tie, code, power, value): machine, kind, reel_id, ts, value, n_rows.

    ``kind`` is "turnup" with the turn-up row's time and value and the reel's number of rows, or "break" with the time of
    the reel's first break edge. ``tie`` orders rows of the same time. Rows later than the watermark are dropped, rows
    without a machine, reel, time or tie take no part, and NULL codes and powers make no edge. The last reel stays open. A
    reel that returns after another one is a new reel. State holds the rows of unfinished slots and a few numbers a machine.
    The session needs the RocksDB state store.
    """
    needed = ["machine", "reel_id", ts, "tie"]
    src = stream.dropna(subset=needed).withWatermark(ts, late).select(
        "machine", F.col("reel_id").cast("long"), ts, F.unix_micros(ts).alias("us"), F.col("tie").cast("long").alias("tie"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in ("code", "power", "value")],
    )
    got = src.groupBy("machine").transformWithStateInPandas(
        statefulProcessor=ReelEvents(level, slot_ms), outputStructType=OUT_SCHEMA, outputMode="Append", timeMode="EventTime"
    )
    return got.select("machine", "kind", "reel_id", F.timestamp_micros("us").alias("ts"), "value", "n_rows")
