import uuid

import numpy as np
import pandas as pd
import pytest

from barloom.operators import indicators as I
from barloom.operators.layout import HELPERS, laid_with, layout
from barloom.operators.levels import level_flags
from barloom.sources.bars import build_bars
from barloom.sources.laid import append, load_laid, save_laid, stored_bars

from .conftest import frame

BLOCK = 64


def walk(name, n, seed):
    return frame(name, 100 + np.cumsum(np.random.default_rng(seed).normal(size=n)).round(2))


@pytest.fixture(scope="module")
def stored(spark, to_bars):
    bars = to_bars(walk("hot", 700, 1), walk("b", 64, 2), walk("c", 3, 3), walk("d", 129, 4))
    name = f"laid_{uuid.uuid4().hex}"
    save_laid(bars, name, buckets=8, before=60, after=20, block_rows=BLOCK)
    return bars, name


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return df.toPandas().sort_values(["ticker", "ts"]).reset_index(drop=True)


def same(a, b):
    pd.testing.assert_frame_equal(rows(a), rows(b.select(*a.columns)), rtol=1e-12, atol=1e-12)


def test_bars_come_back(spark, stored):
    bars, name = stored
    same(bars, stored_bars(spark, name))
    bounds = pd.Timestamp("2024-01-02"), pd.Timestamp("2024-01-04")
    part = stored_bars(spark, name, *bounds)
    assert rows(part).ts.between(*bounds, inclusive="left").all() and part.count() == sum(min(max(n - 24, 0), 48) for n in (700, 64, 3, 129))
    assert "GreaterThanOrEqual(ts" in plan(part)


def test_operators_plan_no_exchange(spark, stored):
    bars, name = stored
    names = ("sma", "bollinger", "rsi", "stochastic", "williams_r", "cmf", "log_returns")
    got, flags = I.indicators(load_laid(spark, name), names, block_rows=BLOCK), level_flags(load_laid(spark, name), block_rows=BLOCK)
    for df in (got, flags):
        assert "Exchange" not in plan(df) and "Bucketed: true" in plan(df) and not set(HELPERS) & set(df.columns)
    assert "Exchange" in plan(I.indicators(bars, names, block_rows=BLOCK))
    same(I.indicators(bars, names, block_rows=BLOCK), got)
    same(level_flags(bars, block_rows=BLOCK), flags)


def test_totals_run_across_stored_blocks(spark, stored):
    bars, name = stored
    for name_ in ("obv", "pvt"):
        same(I.indicators(bars, (name_,), block_rows=BLOCK), I.indicators(load_laid(spark, name), (name_,), block_rows=BLOCK))


def test_a_longer_reach_cuts_anew(spark, stored):
    bars, name = stored
    laid = load_laid(spark, name)
    for names in (("adx",), ("macd", "ema")):
        same(I.indicators(bars, names, block_rows=BLOCK), I.indicators(laid, names, block_rows=BLOCK))
    assert laid_with(layout(laid, before=61, block_rows=BLOCK)) is None and laid_with(layout(laid, before=60, block_rows=BLOCK)) is not None
    same(I.indicators(bars, ("sma",), block_rows=100), I.indicators(laid, ("sma",), block_rows=100))
    # results are bars again, not blocks
    again = I.lay_and_compute(laid, [I.RECIPES["sma"]()], BLOCK)
    assert laid_with(again) is None
    same(I.indicators(bars, ("sma", "rsi"), block_rows=BLOCK), I.compute(again, [I.RECIPES["rsi"]()], BLOCK))


def test_a_hot_ticker_fills_many_buckets(spark, stored):
    laid = load_laid(spark, stored[1])
    files = laid.filter("ticker = 'hot'").selectExpr("_metadata.file_name as f").distinct().count()
    assert files >= 5 and laid.filter("ticker = 'hot' and is_core").groupBy("block").count().toPandas()["count"].max() == BLOCK


def test_append(spark, to_bars, stored):
    bars, name = stored
    more = walk("hot", 900, 9).iloc[650:]
    new = to_bars(more, walk("e", 10, 5))
    into = f"laid_{uuid.uuid4().hex}"
    append(spark, name, new, into, buckets=4)
    keys = new.select("ticker", "ts")
    whole = bars.join(keys, ["ticker", "ts"], "left_anti").select(*bars.columns).unionByName(new)
    same(whole, stored_bars(spark, into))
    same(I.indicators(whole, ("sma",), block_rows=BLOCK), I.indicators(load_laid(spark, into), ("sma",), block_rows=BLOCK))
    with pytest.raises(ValueError):
        append(spark, name, new, name, buckets=4)


def test_empty_and_other_tables(spark, stored):
    bars, _ = stored
    name = f"laid_{uuid.uuid4().hex}"
    save_laid(bars.limit(0), name, buckets=2)
    assert stored_bars(spark, name).count() == 0 and I.sma(load_laid(spark, name)).count() == 0
    bars.createOrReplaceTempView("plain_bars")
    with pytest.raises(ValueError):
        load_laid(spark, "plain_bars")


def test_ticks_that_are_there_again(spark):
    ticks = pd.DataFrame({"ticker": ["a", "b"] * 200, "ts": pd.date_range("2024-01-01", periods=400, freq="7min"), "price": np.arange(400.0), "id": range(400)})
    ticks.loc[10, "ts"] = ticks.loc[8, "ts"]  # one time, two ids: two ticks
    once = spark.createDataFrame(ticks, "ticker string, ts timestamp, price double, id long")
    twice = once.unionByName(once).unionByName(once.filter("ticker = 'a'"))
    same(build_bars(once, "1h"), build_bars(twice, "1h", once=True))
    assert build_bars(twice, "1h").agg({"volume": "sum"}).first()[0] == 1000
    with pytest.raises(ValueError):
        build_bars(once, "1h", id=None, once=True)
