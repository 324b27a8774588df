import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import daily as D
from barloom.operators import fill as FI
from barloom.operators import indicators as I
from barloom.operators import levels as V
from barloom.operators import metrics as M
from barloom.operators import quantile as Q
from barloom.operators import relative as R
from barloom.operators import scaling as SC
from barloom.operators import sequences as SQ
from barloom.operators.layout import layout, positions
from barloom.schema import RELATED

from .conftest import frame
from .test_indicators import walk


def test_positions_and_blocks(to_bars):
    bars = to_bars(walk("a", 250, 1), walk("b", 7, 2))
    placed = positions(bars, bucket_seconds=86_400).toPandas().sort_values(["ticker", "ts"])
    assert placed[placed.ticker == "a"].pos.tolist() == list(range(250))
    assert placed[placed.ticker == "b"].pos.tolist() == list(range(7))
    assert set(placed.n_rows) == {250, 7}
    laid = layout(bars, before=25, after=5, block_rows=10).toPandas()
    assert laid.is_core.sum() == 257 and laid[laid.is_core].groupby(["ticker", "block"]).size().max() == 10
    for (t, b), g in laid.groupby(["ticker", "block"]):
        n = 250 if t == "a" else 7
        assert sorted(g.pos) == list(range(max(0, 10 * b - 25), min(n, 10 * b + 15)))


def test_levels_by_brute_force(to_bars):
    df = walk("a", 300, 3)
    flags = V.level_flags(to_bars(df), 20, block_rows=64).toPandas().sort_values("ts").reset_index(drop=True)
    for i in range(300):
        inner = 20 <= i < 280
        assert flags.is_support[i] == (inner and df.low[i] == df.low[i - 20 : i + 21].min())
        assert flags.is_resistance[i] == (inner and df.high[i] == df.high[i - 20 : i + 21].max())


def test_one_dip_and_one_peak(to_bars):
    close = np.full(41, 10.0)
    high, low = close + 1 + np.abs(np.arange(41) - 20) * -0.01, close - 1 + np.abs(np.arange(41) - 20) * 0.01
    full = V.levels(to_bars(frame("a", close, high=high, low=low))).toPandas()
    assert sorted(full.kind) == ["resistance", "support"]
    short = frame("a", close[:40], high=high[:40], low=low[:40])
    assert V.levels(to_bars(short)).count() == 0


def test_top_levels_count_upwards(spark):
    found = spark.createDataFrame(
        [("a", "support", float(x)) for x in (5, 1, 4, 2, 3)] + [("a", "resistance", 9.0)],
        "ticker string, kind string, level double",
    )
    top = V.top_levels(found).toPandas().sort_values(["kind", "number"])
    assert top.level.tolist() == [9.0, 3.0, 4.0, 5.0] and top.number.tolist() == [1, 1, 2, 3]


def test_fill_runs_forward_then_back(to_bars):
    df = walk("a", 100, 4)
    gaps = df.close.where(np.arange(100) % 17 == 5)
    none = walk("b", 20, 5)
    none["volume"] = np.nan
    df["volume"] = gaps
    got = FI.fill(to_bars(df, none), ["volume"], block_rows=8).toPandas().sort_values("ts")
    np.testing.assert_allclose(got[got.ticker == "a"].volume, gaps.ffill().bfill())
    assert got[got.ticker == "b"].volume.isna().all()


def test_quantiles_are_exact_under_skew(spark):
    rng = np.random.default_rng(6)
    hot = rng.normal(0, 1, 60_000)
    hot[:25_000] = 0.125
    groups = {"hot": hot, "small": rng.normal(0, 1, 37), "one": np.array([3.0]), "same": np.full(500, 2.0)}
    rows = pd.concat([pd.DataFrame({"ticker": t, "x": x, "y": -x}) for t, x in groups.items()])
    df = spark.createDataFrame(rows).repartition(8)
    probs = (0.01, 0.5, 0.99)
    got = Q.quantiles(df, ("x", "y"), probs).toPandas()
    assert len(got) == len(groups) * 2 * 3
    for row in got.itertuples():
        values = groups[row.ticker] * (1 if row.feature == "x" else -1)
        assert row.value == pytest.approx(np.quantile(values, row.prob), abs=1e-12)


def test_scaling_and_back(spark):
    rows = [("a", float(i), 0.0, 7.0) for i in range(200)]
    df = spark.createDataFrame(rows, "ticker string, x double, zero double, seven double")
    cols = ("x", "zero", "seven")
    params = SC.fit_scaler(df, cols, "robust").toPandas().set_index("feature")
    assert params.loc["zero", ["f_min", "f_max"]].tolist() == [-0.001, 0.001]
    assert params.loc["seven", ["f_min", "f_max"]].tolist() == [-7.0, 7.0]
    assert params.f_min["x"] == pytest.approx(np.percentile(range(200), 1))
    for kind in ("zscore", "minmax"):
        fitted = SC.fit_scaler(df, ("x",), kind)
        back = SC.unscale(SC.scale(df, fitted, ("x",), kind), fitted, ("x",), kind)
        np.testing.assert_allclose(sorted(back.toPandas().x), range(200), atol=1e-5)
    wild = df.withColumn("x", F.when(F.col("x") == 0, 1e9).otherwise(F.col("x")))
    assert SC.scale(wild, SC.fit_scaler(df, ("x",)), ("x",)).agg(F.max("x")).first()[0] == 10.0
    with pytest.raises(ValueError):
        SC.fit_scaler(df, cols, "other")


def test_split_and_sequences(to_bars):
    df = walk("a", 43, 7)
    bars = to_bars(df, walk("b", 4, 8))
    split = SQ.time_split(bars).toPandas()
    a = split[split.ticker == "a"]
    assert a.is_train.sum() == int(0.8 * 43) and a[a.is_train].ts.max() < a[~a.is_train].ts.min()
    labelled = SQ.sequences(bars, ("close",), 5, block_rows=6).toPandas().sort_values("ts")
    assert set(labelled.ticker) == {"a"} and len(labelled) == 38
    for i, seq in zip(range(5, 43), labelled.seq, strict=True):
        assert [x[0] for x in seq] == pytest.approx(df.close[i - 5 : i].tolist())
    sliding = SQ.sequences(bars, ("close",), 5, "sliding", block_rows=6).toPandas().sort_values("ts")
    assert len(sliding) == 39 and [x[0] for x in sliding.seq.iloc[-1]] == pytest.approx(df.close[-5:].tolist())
    latest = SQ.sequences(bars, ("close",), 5, "latest").toPandas()
    assert len(latest) == 1 and [x[0] for x in latest.seq[0]] == pytest.approx(df.close[-5:].tolist())
    assert SQ.drop_last_row(bars).count() == 45


def test_metrics(spark):
    ts = pd.date_range("2024-01-01", periods=5)
    rows = pd.DataFrame({"ticker": "a", "ts": ts, "y_true": [1.0, 2, 3, 2, 2], "y_pred": [1.0, 3, 2, 1, 0]})
    rows = pd.concat([rows, pd.DataFrame({"ticker": "b", "ts": ts[:1], "y_true": [1.0], "y_pred": [2.0]})])
    got = M.metrics(spark.createDataFrame(rows), block_rows=2).toPandas().set_index("ticker")
    assert got.mse["a"] == pytest.approx(7 / 5) and got.mae["a"] == pytest.approx(1.0)
    assert got.directional_accuracy["a"] == pytest.approx(3 / 4) and np.isnan(got.directional_accuracy["b"])


def test_confidence_and_loss(spark):
    rows = [(100.0, 110.0, 4.0), (100.0, 100.5, 4.0), (100.0, 90.0, 0.0), (100.0, 99.0, None)]
    df = spark.createDataFrame(rows, "now double, then double, mse double")
    got = M.confidence(df, "now", "then", "mse").collect()
    assert [(x.direction, x.score) for x in got] == [
        ("Bullish", 5.0), ("Uncertain", 0.25), ("Uncertain", 0.0), ("Bearish", 1.0),
    ]
    sample = spark.createDataFrame([("a", 1.0, 0.0, 1, 0.5)], "ticker string, y double, p double, s int, q double")
    assert M.combined_loss(sample, "y", "p", "s", "q").first().loss == pytest.approx(1 + np.log(2))


def test_next_day_labels(to_bars):
    two_a_day = frame("a", [10.0, 11.0, 12.0, 13.0, 14.0], freq="12h")
    daily = frame("d", [1.0, 2.0, 3.0], freq="D")
    got = D.next_day_label(to_bars(two_a_day, daily)).toPandas().sort_values(["ticker", "ts"])
    a = got[got.ticker == "a"].next_return.tolist()
    assert a == pytest.approx([np.log(12.5 / 11), np.log(12.5 / 11), 0, 0, 0])
    assert got[got.ticker == "d"].next_return.tolist() == [0, 0, 0]
    assert got[got.ticker == "d"].sentiment.tolist() == [1, 1, 1]
    one = D.next_day_label(to_bars(daily), min_bars=1).toPandas().sort_values("ts")
    assert one.next_return.tolist() == pytest.approx([np.log(2), np.log(1.5), 0])
    opening = D.opening_average(to_bars(frame("a", range(1, 9)), frame("b", range(1, 6)))).toPandas()
    assert opening.set_index("ticker").opening_avg["a"] == 3.5 and opening.opening_avg.isna().sum() == 1


def test_relative_measures(to_bars, spark):
    a, b = walk("a", 90, 9), walk("b", 90, 10)
    b["ts"] += pd.Timedelta(hours=10)
    flat = frame("c", [4.0] * 100)
    bars = to_bars(a, b, flat)
    related = spark.createDataFrame([("a", "b", 1), ("a", "none", 2), ("a", "c", 3)], RELATED)
    found = R.related_found(bars, related)
    assert {(x.related_ticker, x["rank"]) for x in found.collect()} == {("b", 1), ("c", 2)}
    got = R.relative(R.pairs(bars, found), block_rows=16).toPandas()
    m, o = a.iloc[10:].reset_index(drop=True), b.iloc[:80].reset_index(drop=True)
    pair = got[got.related_ticker == "b"].sort_values("ts").reset_index(drop=True)
    assert len(pair) == 80
    mr, orr = m.close.pct_change(), o.close.pct_change()
    np.testing.assert_allclose(pair.price_ratio, o.close / m.close)
    np.testing.assert_allclose(pair.return_difference, orr - mr)
    np.testing.assert_allclose(pair.volume_ratio, o.volume / m.volume)
    np.testing.assert_allclose(pair.rolling_correlation, m.close.rolling(20).corr(o.close), atol=1e-9)
    np.testing.assert_allclose(pair.beta, orr.rolling(20).cov(mr) / mr.rolling(20).var(), atol=1e-9)
    assert got[got.related_ticker == "c"].rolling_correlation.isna().all()
    wide = R.relative_wide(bars, related, 3).toPandas()
    assert len(wide) == 80 and wide.beta_stock_1.notna().any() and wide.beta_stock_3.isna().all()


def test_a_price_of_zero(to_bars):
    """Its log return is minus infinity, the next one NULL; the day after a close of 0 rises without bound."""
    low = [5.0, 0.0, 4.0, 2.0, 3.0, 1.0]
    bars = to_bars(frame("a", [6.0, 5.0, 7.0, 0.0, 6.0, 6.0], start="2024-01-01", freq="8h", low=low))
    got = I.log_returns(bars).select("ts", "low_return", "close_return").orderBy("ts").collect()
    assert [r.low_return for r in got[:3]] == [0.0, -math.inf, None] and got[3].low_return == pytest.approx(math.log(0.5))
    assert got[3].close_return == -math.inf and got[4].close_return is None
    days = to_bars(frame("a", [6.0, 5.0, 0.0, 7.0, 6.0, 6.0], start="2024-01-01", freq="8h"))
    label = D.next_day_label(days).orderBy("ts").collect()
    assert [(r.next_return, r.sentiment) for r in label] == [(math.inf, 0)] * 3 + [(0.0, 1)] * 3


def test_percentiles_of_infinite_values(spark):
    rows = [("a", -math.inf, -math.inf), ("a", 1.0, -math.inf), ("a", 2.0, 3.0)]
    got = Q.quantiles(spark.createDataFrame(rows, "ticker string, x double, y double"), ("x", "y"), (0.1, 0.5, 0.3)).collect()
    assert {(r.feature, r.prob): r.value for r in got} == {
        ("x", 0.1): -math.inf, ("x", 0.3): -math.inf, ("x", 0.5): 1.0, ("y", 0.1): -math.inf, ("y", 0.3): -math.inf, ("y", 0.5): -math.inf,
    }


def test_scales_of_infinite_values(spark):
    """Robust scaling clips them, between minimum and maximum nothing is defined."""
    rows = spark.createDataFrame([("a", i, -math.inf if i == 7 else float(i)) for i in range(1, 400)], "ticker string, ts int, x double")
    robust = SC.scale(rows, SC.fit_scaler(rows, ("x",)), ("x",)).orderBy("ts").collect()
    assert robust[6].x == -10.0 and 0 < robust[5].x < 0.01 < robust[394].x < 1.0
    between = SC.scale(rows, SC.fit_scaler(rows, ("x",), "minmax"), ("x",), "minmax").collect()
    assert all(r.x is not None and math.isnan(r.x) for r in between)
