import numpy as np
import pandas as pd
import pytest

from barloom.operators import indicators as I
from barloom.operators.latest import summary, trend
from barloom.schema import FEATURES

from .conftest import frame


def walk(ticker, n, seed):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    spread = rng.uniform(0.1, 1.0, n)
    return frame(
        ticker, close, open=close + rng.normal(0, 0.2, n), high=close + spread,
        low=close - spread * rng.uniform(0.2, 1.0, n), volume=rng.integers(1, 1000, n).astype(float),
    )


def by_hand(df):
    """The indicators of one ticker from their definitions."""
    c, h, low, v = df.close, df.high, df.low, df.volume
    prev = c.shift()
    out = pd.DataFrame(index=df.index)
    for n in (20, 50):
        out[f"sma_{n}"] = c.rolling(n).mean()
    out["ema_20"] = c.ewm(span=20, adjust=False).mean()
    step = (c - prev).fillna(0.0)
    gain, loss = step.clip(lower=0).rolling(14).mean(), (-step).clip(lower=0).rolling(14).mean()
    out["rsi"] = np.where(loss.abs() < 1e-12, np.where(gain > 1e-12, 100.0, np.nan), 100 * gain / (gain + loss))
    out["bb_middle"] = out.sma_20
    sd = c.rolling(20).std()
    out["bb_upper"], out["bb_lower"] = out.sma_20 + 2 * sd, out.sma_20 - 2 * sd
    out["bb_width"] = 4 * sd / out.sma_20
    out["macd"] = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    out["signal_line"] = out.macd.ewm(span=9, adjust=False).mean()
    tr = pd.concat([h, prev], axis=1).max(axis=1) - pd.concat([low, prev], axis=1).min(axis=1)
    out["atr"] = tr.rolling(14).mean()
    bottom, top = low.rolling(14).min(), h.rolling(14).max()
    width = (top - bottom).replace(0.0, np.nan)
    out["pct_k"] = 100 * (c - bottom) / width
    out["pct_d"] = out.pct_k.rolling(3).mean()
    out["williams_r"] = out.pct_k - 100
    out["obv"] = (np.sign(step) * v).cumsum()
    out["pvt"] = ((step / prev).fillna(0.0) * v).cumsum()
    out["cmf"] = ((2 * c - h - low) / (h - low).replace(0.0, np.nan) * v).rolling(20).sum() / v.rolling(20).sum()
    up, down = h.diff().clip(lower=0), (-low.diff()).clip(lower=0)
    weigh = {"alpha": 1 / 14, "adjust": True}
    plus, minus = (100 * m.ewm(**weigh).mean() / tr.ewm(**weigh).mean() for m in (up, down))
    total = (plus + minus).replace(0.0, np.nan)
    out["adx"] = (100 * (plus - minus).abs() / total).ewm(**weigh).mean()
    return out


SERIES = [
    walk("long", 1500, 1),
    *[walk(f"n{n}", n, n) for n in (1, 13, 14, 19, 20, 49, 50)],
    frame("rising", np.arange(1.0, 61.0)),
    frame("falling", np.arange(60.0, 0.0, -1.0)),
    frame("constant", [5.0] * 60, high=5.0, low=5.0),
]


@pytest.mark.parametrize("block_rows", [90, 16_384])
def test_all_indicators_match_their_definitions(to_bars, block_rows):
    got = I.indicators(to_bars(*SERIES), block_rows=block_rows).toPandas()
    assert len(got) == sum(map(len, SERIES))
    for df in SERIES:
        mine = got[got.ticker == df.ticker[0]].sort_values("ts").reset_index(drop=True)
        want = by_hand(df)
        for c in want:
            np.testing.assert_allclose(
                mine[c].astype(float), want[c].astype(float), rtol=1e-8, atol=1e-8, err_msg=f"{df.ticker[0]} {c}"
            )


def test_bounds_and_undefined_values(to_bars):
    got = I.indicators(to_bars(*SERIES)).toPandas()
    assert got.rsi.dropna().between(0, 100).all()
    bands = got.dropna(subset=["bb_upper"])
    assert (bands.bb_lower <= bands.bb_middle).all() and (bands.bb_middle <= bands.bb_upper).all()
    last = got.sort_values("ts").groupby("ticker").tail(1).set_index("ticker")
    assert last.rsi["rising"] == 100 and last.rsi["falling"] == 0
    assert last.loc["constant", ["rsi", "pct_k", "williams_r", "cmf", "adx"]].isna().all()
    assert not np.isinf(got[list(FEATURES)].to_numpy(dtype=float)).any()


def test_a_flat_bar_blanks_twenty_money_flows(to_bars):
    close = np.arange(1.0, 61.0)
    high, low = close + 1, close - 1
    high[30] = low[30] = close[30]
    got = I.cmf(to_bars(frame("a", close, high=high, low=low))).toPandas().sort_values("ts")
    assert got.cmf.isna().tolist() == [i < 19 or 30 <= i < 50 for i in range(60)]


def test_a_longer_span_than_a_stripe(to_bars):
    df = walk("long", 3000, 5)
    got = I.ema(to_bars(df), span=200, block_rows=700).toPandas().sort_values("ts")
    np.testing.assert_allclose(got.ema_200, df.close.ewm(span=200, adjust=False).mean(), rtol=1e-10)
    quick = I.ema(to_bars(df), span=2, block_rows=700).toPandas().sort_values("ts")
    np.testing.assert_allclose(quick.ema_2, df.close.ewm(span=2, adjust=False).mean(), rtol=1e-10)


def test_a_null_close_is_refused_by_recursive_averages(to_bars):
    with pytest.raises(Exception, match="ema_20: input has a NULL"):
        I.ema(to_bars(frame("a", [1.0, np.nan, 2.0]))).toPandas()


def test_trend_and_summary(to_bars):
    bars = to_bars(*SERIES)
    got = trend(bars).toPandas().set_index("ticker").trend
    assert got["rising"] == "Bullish" and got["falling"] == "Bearish"
    assert got["n19"] == "Insufficient data" and got["n49"] == "Neutral" and got["constant"] == "Neutral"
    card = summary(bars).toPandas().set_index("ticker")
    assert card.previous_close["n1"] == card.last_close["n1"] and card.change_pct["n1"] == 0
    assert card.change_pct["rising"] == pytest.approx(100 / 59)


def test_plans_stay_in_the_jvm_and_in_blocks(to_bars, spark):
    bars = to_bars(walk("a", 100, 1))
    plan = I.indicators(bars)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "InPandas" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    limited = trend(bars)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in limited and "Partial" in limited
