import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from reelcost.operators import reels as W
from reelcost.queries import documents_and_streams as Q
from reelcost.streaming import reelstate as RS
from reelcost.streaming import streams as ST


def packed(rows):
    return np.array(rows, RS.ROW)


def test_edges_across_slots_and_reels():
    nan = float("nan")
    rows = packed([(1, 0, 7, 0, 60, 1.0), (2, 0, 7, 5, 40, 2.0), (3, 0, 8, 0, 60, 3.0), (4, 0, 8, nan, 70, nan), (5, 0, 9, 0, 10, 5.0), (6, 0, 9, 1, nan, 6.0), (7, 0, 10, 0, 99, 7.0)])
    expected = [("break", 7, 1, None, None), ("turnup", 7, 1, 1.0, 2), ("break", 8, 3, None, None), ("turnup", 8, 3, 3.0, 2), ("turnup", 9, 5, 5.0, 2), ("break", 10, 7, None, None)]
    for cut in range(len(rows) + 1):
        last, first = RS.read_in_order(None, rows[:cut], 50.0)
        last, rest = RS.read_in_order(last, rows[cut:], 50.0)
        assert first + rest == expected
        assert (last.reel_id, last.n_rows) == (10, 1)
    assert RS.read_in_order(None, rows[:0], 50.0) == (None, [])


@pytest.mark.parametrize("processor", [RS.ReelEvents, ST.TurnupEmitter])
def test_processors_take_the_arguments_that_spark_names(processor):
    for name in ("handleInputRows", "handleExpiredTimer"):
        assert list(inspect.signature(getattr(processor, name)).parameters) == list(inspect.signature(getattr(StatefulProcessor, name)).parameters)


def test_stream_out_of_order_gives_the_batch_result(spark):
    rng = np.random.default_rng(5)
    rows = []
    for machine in ("m1", "m2"):
        # The watermark of a new stream stands at 1970-01-01, so the rows begin later.
        at = np.sort(rng.integers(86_400, 4 * 86_400, 500))
        for i, t in enumerate(at.tolist()):
            code, power = rng.integers(0, 12), rng.integers(20, 70)
            # Up to an hour late: some rows of a day reach the stream with the next one.
            part = (t + int(rng.integers(0, 3600))) // 86_400
            rows.append((machine, t // 7200, t, i, None if code == 11 else float(code), None if power == 33 else float(power), float(i), int(part)))
    rows += [(None, 1, 5, 1, 0.0, 1.0, 1.0, 0), ("m1", None, 5, 1, 0.0, 1.0, 1.0, 0), ("m1", 1, None, 1, 0.0, 1.0, 1.0, 0)]
    schema = "machine string, reel_id long, s long, tie long, code double, power double, value double, part long"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).drop("s").repartition(3)
    with Q.rocksdb(spark):
        got = Q.feed(spark, df, lambda s: RS.reel_event_stream(s, late="2 hours", slot_ms=600_000), "test-reels").toPandas()

    end = max(r[2] for r in rows if r[2] is not None) - 7200
    done = df.dropna(subset=["machine", "reel_id", "ts"]).filter((F.unix_seconds("ts") / 600).cast("long") * 600 + 600 <= end)
    order = ["ts", "tie"]
    for machine in ("m1", "m2"):
        one = done.filter(F.col("machine") == machine)
        newest = one.agg(F.max("reel_id")).head()[0]
        breaks = {r[0] for r in W.break_edges(one, "code", "power", "reel_id", ["machine"], order).collect()}
        turnups = {(r.reel_id, r.value) for r in W.turnup_rows(one, ["value"], order=order).select("reel_id", "value").filter(F.col("reel_id") < newest).collect()}
        mine = got[got.machine == machine]
        assert sorted(mine[mine.kind == "break"].reel_id) == sorted(breaks) and breaks
        kept = mine[mine.kind == "turnup"]
        assert set(zip(kept.reel_id, kept.value)) == turnups and len(kept) == len(turnups) > 20
        sizes = {r.reel_id: r["count"] for r in one.groupBy("reel_id").count().collect()}
        assert {r: sizes[r] for r in kept.reel_id} == dict(zip(kept.reel_id, kept.n_rows))


def test_no_rows_reach_the_stream(spark):
    df = spark.createDataFrame([], "event_id long, ts timestamp, part long")
    assert Q.feed(spark, df, lambda s: ST.unique_rows(s, "ts", ["event_id"]), "test-none").count() == 0
