"""Rows in are rows out, also without a ticker, without parameters and at the end of a stream."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest

from barloom.operators import fill as FI
from barloom.operators import indicators as I
from barloom.operators.scaling import fit_scaler, scale
from barloom.operators.sequences import sequences, time_split
from barloom.plans import features as PF
from barloom.plans import forecast as FC
from barloom.session import fresh_path
from barloom.sources.bars import build_bars, read_bars
from barloom.sources.store import load_fit, save_fit
from barloom.streaming.bars import land_versions, newest_versions, stream_bars

from .conftest import frame
from .test_indicators import walk


@pytest.fixture
def bars(to_bars):
    return to_bars(walk("a", 60, 1), walk("b", 60, 2), walk(None, 30, 3), walk("one", 1, 4))


def test_indicators_keep_bars_without_ticker(bars):
    got = I.indicators(bars, block_rows=16).toPandas()
    assert len(got) == 151 and got.ticker.isna().sum() == 30
    assert got[got.ticker.isna()].sma_20.notna().sum() == 11
    assert FI.fill(I.sma(bars), ("sma_20",), block_rows=16).count() == 151


def test_a_ticker_without_parameters_keeps_its_rows(bars):
    split = time_split(bars)
    params = fit_scaler(split, ("close",), "minmax", "train")
    got = scale(split, params, ("close",), "minmax").toPandas()
    assert len(got) == 151
    assert got[got.ticker == "one"].close.isna().all() and got[got.ticker == "a"].close.notna().all()


def test_tickers_are_read_as_given(spark, to_bars):
    path = fresh_path(spark, "bars")
    to_bars(frame("click", range(3)), frame("CLICK", range(4))).write.parquet(path)
    assert read_bars(spark, path, tickers=["click"]).count() == 3
    assert read_bars(spark, path, tickers=["CLICK", "x"]).count() == 4


def test_the_last_bars_of_a_stream_are_there(spark):
    times = pd.date_range("2024-01-01", periods=200, freq="7min")
    ticks = spark.createDataFrame(
        pd.DataFrame({"ticker": ["a", "b"] * 100, "ts": times, "price": np.arange(200.0), "id": range(-100, 100)}),
        "ticker string, ts timestamp, price double, id long",
    )
    folder, out = fresh_path(spark, "ticks"), fresh_path(spark, "out")
    ticks.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    bars = stream_bars(stream, "30m", late="1 day")
    land_versions(bars, out, fresh_path(spark, "state")).awaitTermination()
    got = {tuple(r) for r in newest_versions(spark, out, bars).collect()}
    assert got == {tuple(r) for r in build_bars(ticks, "30m").collect()}


def test_related_tickers_that_are_missing_leave_a_mark(to_bars, spark):
    bars = to_bars(*[walk(t, 120, i) for i, t in enumerate("abc")])
    related = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("b", "a", 1), ("b", "gone", 2)], "ticker string, related_ticker string, rank int")
    rows, cols = PF.related_features(bars, related, 2)
    got = rows.toPandas()
    assert set(got.ticker) == {"a", "b"}
    assert got[got.ticker == "a"].has_2.all() and not got[got.ticker == "b"].has_2.any() and got.has_1.all()
    assert (got[got.ticker == "b"][[c for c in cols if c.endswith("_stock_2") or c.startswith("related_2_")]] == 0).all().all()


def test_uncovered_tickers_are_named(to_bars):
    flat = frame("flat", np.arange(80.0) + 1, high=np.arange(80.0) + 1, low=np.arange(80.0) + 1)
    got = {tuple(r) for r in PF.uncovered(PF.feature_rows(to_bars(walk("a", 80, 1), flat))).collect()}
    assert ("flat", "cmf") in got and not any(t == "a" for t, _ in got)


def test_ticks_are_pruned_for_a_period(spark):
    path = fresh_path(spark, "ticks")
    hours = pd.date_range("2024-01-01", periods=3000, freq="h")
    rows = pd.DataFrame({"ticker": "a", "ts": hours, "price": np.arange(3000.0), "id": np.arange(3000)})
    spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, price double, id long").write.parquet(path)
    ticks = spark.read.parquet(path)
    start, end = datetime(2024, 2, 10), datetime(2024, 2, 20)
    got = build_bars(ticks, "1d", start=start, end=end)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    assert got.count() == 10 and {tuple(r) for r in got.collect()} <= {tuple(r) for r in build_bars(ticks, "1d").collect()}


@pytest.mark.parametrize("length", [5, 1170])
def test_the_latest_sequence_has_one_plan(to_bars, length):
    made = sequences(to_bars(walk("a", 1500, 1), walk("b", 40, 2)), ("close",), length, "latest")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" not in plan
    got = made.toPandas().set_index("ticker")
    assert set(got.index) == ({"a", "b"} if length == 5 else {"a"})
    assert len(got.seq["a"]) == length


def test_a_forecast_uses_the_parameters_of_the_fit(to_bars, spark):
    from pyspark.ml import PipelineModel

    bars = to_bars(walk("a", 160, 1))
    rows, params = PF.tree_data(bars)
    folder = fresh_path(spark, "fits")
    save_fit(PipelineModel([]), params, folder, "gbt", "1h", 3)
    _, loaded = load_fit(spark, folder, "gbt", "1h", 3)
    assert {tuple(r) for r in loaded.collect()} == {tuple(r) for r in params.collect()}
    state = FC.latest_state(PF.scaled_rows(PF.feature_rows(bars), params=loaded), bars, PF.RETURN_FEATURES, loaded).first()
    ends = {r.feature: r for r in loaded.collect()}
    assert (state.f_min, state.f_max) == (ends["open_return"].f_min, ends["open_return"].f_max)
    raw = PF.feature_rows(bars).orderBy("ts").toPandas().iloc[-1]
    for name, value in zip(PF.RETURN_FEATURES, state.seq[-1], strict=True):
        low, high = ends[name].f_min, ends[name].f_max
        assert value == pytest.approx(np.clip((raw[name] - low) / (high - low + 1e-8), -10, 10), rel=1e-6)
    assert rows.count() > 0
