from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.session import fresh_path
from barloom.sources import periods as P
from barloom.sources.bars import build_bars, clean, from_epoch_millis, market_hours, read_bars, whole
from barloom.sources.candles import candles
from barloom.sources.store import model_name
from barloom.streaming.bars import land, stream_bars

from .conftest import frame


def test_periods_and_steps():
    now = datetime(2024, 5, 20, 10)
    assert P.period_start("5d", now) == datetime(2024, 5, 15, 10)
    assert P.period_start("3mo", now) == datetime(2024, 2, 20, 10)
    assert P.period_start("2y", now) == datetime(2022, 5, 21, 10)
    assert P.period_start("ytd", now) == datetime(2024, 1, 1) and P.period_start("max", now) is None
    assert P.period_start("odd", now) == P.period_start("1y", now)
    assert [P.trading_steps(i, 3) for i in P.STEPS_PER_DAY] == [1170, 234, 78, 39, 19, 3, 1, 1, 1]
    assert P.sequence_length("1d", 1, 1000) == 3 and P.sequence_length("5m", 1, 100) == 20
    assert model_name("gbt", "1h", 3) == "model_gbt_1h_3d"
    for bad in (lambda: P.interval_parts("2h"), lambda: P.trading_steps("7m", 1), lambda: P.interval_seconds("1wk")):
        with pytest.raises(ValueError):
            bad()


def test_ticks_at_the_same_time_follow_their_id(spark):
    ticks = spark.createDataFrame(
        [("a", datetime(2024, 1, 1, 9, 0), 5.0, 2), ("a", datetime(2024, 1, 1, 9, 0), 4.0, 1),
         ("a", datetime(2024, 1, 1, 9, 59), 6.0, 4), ("a", datetime(2024, 1, 1, 9, 59), 7.0, 3),
         ("a", datetime(2024, 1, 1, 10, 0), 1.0, 5)],
        "ticker string, ts timestamp, price double, id long",
    )
    first, second = build_bars(ticks, "1h").orderBy("ts").collect()
    assert (first.open, first.high, first.low, first.close, first.volume) == (4.0, 7.0, 4.0, 6.0, 4.0)
    assert second.ts == datetime(2024, 1, 1, 10) and second.close == 1.0
    plan = build_bars(ticks, "1h")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    unique = build_bars(ticks.filter("id not in (2, 4)"), "1h", id=None)
    assert unique.orderBy("ts").first().close == 7.0
    plan = unique._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_bad_numbers_become_null(to_bars):
    df = frame("a", [1.0, float("nan"), float("inf"), 4.0])
    got = clean(to_bars(df)).orderBy("ts").toPandas()
    assert got.close.isna().tolist() == [False, True, True, False]
    assert whole(clean(to_bars(df))).count() == 2


def test_reading_is_pruned_and_pushed_down(spark, to_bars):
    path = fresh_path(spark, "bars")
    to_bars(frame("a", range(10)), frame("b", range(10))).write.parquet(path)
    got = read_bars(spark, path, tickers=["a"], start=datetime(2024, 1, 1, 5)).select("ts", "close")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<ticker:string,ts:timestamp,close:double>" in plan
    assert read_bars(spark, path, start=datetime(2024, 1, 1, 5), end=datetime(2024, 1, 1, 8)).count() == 6
    for kind in ("csv", "json"):
        other = fresh_path(spark, kind)
        to_bars(frame("a", range(3))).write.format(kind).save(other)
        assert [r.close for r in read_bars(spark, other, kind).orderBy("ts").collect()] == [0.0, 1.0, 2.0]


def test_market_hours_include_both_ends(spark):
    clock = ["13:29:59", "13:30:00", "20:00:00", "20:00:01"]  # UTC; New York in July is four behind
    bars = spark.createDataFrame([(f"2024-07-01 {c}",) for c in clock], "t string").select(
        F.to_timestamp("t").alias("ts"), "t"
    )
    assert [r.t[-8:] for r in market_hours(bars).orderBy("t").collect()] == clock[1:3]
    assert market_hours(bars, "20:00", "21:00", "UTC").count() == 2


def test_candles_and_epoch(spark):
    payload = '{"t": [1704067200, 1704070800], "o": [1, 2], "h": [3, 4], "l": [0, 1], "c": [2, 3], "v": [10, 20]}'
    rows = candles(spark.createDataFrame([("a", payload)], "ticker string, payload string")).orderBy("ts").collect()
    assert [(r.ts, r.close, r.volume) for r in rows] == [
        (datetime(2024, 1, 1, 0), 2.0, 10.0), (datetime(2024, 1, 1, 1), 3.0, 20.0),
    ]
    millis = from_epoch_millis(spark.createDataFrame([(1704067200500,)], "timestamp long")).first()
    assert millis.ts == datetime(2024, 1, 1, 0, 0, 0, 500_000)


def test_stream_equals_batch_for_closed_bars(spark):
    times = pd.date_range("2024-01-01", periods=200, freq="7min")
    ticks = spark.createDataFrame(
        pd.DataFrame({"ticker": ["a", "b"] * 100, "ts": times, "price": np.arange(200.0), "id": range(200)}),
        "ticker string, ts timestamp, price double, id long",
    )
    folder, out = fresh_path(spark, "ticks"), fresh_path(spark, "out")
    ticks.write.parquet(folder)
    stream = spark.readStream.schema(ticks.schema).parquet(folder)
    bars = stream_bars(stream, "30m", late="1 hour")
    land(bars, out, fresh_path(spark, "state")).awaitTermination()
    got = {tuple(r) for r in spark.read.schema(bars.schema).parquet(out).collect()}
    closed = times[-1] - pd.Timedelta(hours=1, minutes=30)
    want = {tuple(r) for r in build_bars(ticks, "30m").collect() if r.ts <= closed}
    assert got == want and want
    with pytest.raises(ValueError):
        stream_bars(stream, "1mo")


def test_ticks_delivered_twice_count_once(spark):
    times = pd.date_range("2024-01-01", periods=300, freq="7min")
    ticks = spark.createDataFrame([("ab"[i % 2], t.to_pydatetime(), float(i % 13), i) for i, t in enumerate(times)], "ticker string, ts timestamp, price double, id long")
    folder, out = fresh_path(spark, "ticks"), fresh_path(spark, "out")
    ticks.union(ticks).write.parquet(folder)
    bars = stream_bars(spark.readStream.schema(ticks.schema).parquet(folder), "30m", late="1 hour", once=True)
    land(bars, out, fresh_path(spark, "state")).awaitTermination()
    got = {tuple(r) for r in spark.read.schema(bars.schema).parquet(out).collect()}
    closed = times[-1] - pd.Timedelta(hours=1, minutes=30)
    assert got == {tuple(r) for r in build_bars(ticks, "30m").collect() if r.ts <= closed} and got
