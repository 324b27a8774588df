"""Sequences of each ticker's own length, and the forecast of coupled tickers in its defined cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators.relative import pairs, relative
from barloom.plans import coupled as CF
from barloom.plans import lengths as LN
from barloom.schema import RELATED, RELATIVE

from .conftest import frame
from .test_indicators import walk


def test_a_short_ticker_shortens_no_other(to_bars):
    bars = to_bars(walk("long", 60, 1), walk("mid", 11, 2), walk("new", 4, 3))
    lengths = LN.sequence_lengths(bars, "1d", 5)
    got = {r.ticker: (r.n_bars, r.length, r.too_short) for r in lengths.collect()}
    assert got == {"long": (60, 5, False), "mid": (11, 2, False), "new": (4, 0, True)}
    assert LN.width_of(lengths) == 5 and LN.width_of(lengths.limit(0)) == 1


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_padded_sequences(to_bars, block_rows):
    bars = to_bars(walk("long", 60, 1), walk("mid", 11, 2), walk("new", 4, 3))
    lengths = LN.sequence_lengths(bars, "1d", 5)
    got = LN.padded_sequences(bars, ("close",), lengths, 5, block_rows).toPandas().sort_values(["ticker", "ts"])
    close = bars.toPandas().sort_values("ts")
    for ticker, length in (("long", 5), ("mid", 2)):
        own = close[close.ticker == ticker].close.tolist()
        rows = got[got.ticker == ticker]
        assert len(rows) == len(own) - length
        for i, r in enumerate(rows.itertuples(), length):
            assert [x[0] for x in r.seq] == [0.0] * (5 - length) + own[i - length : i]
            assert (r.pad, list(r.mask)) == (5 - length, [0.0] * (5 - length) + [1.0] * length)
    assert set(got.ticker) == {"long", "mid"}
    last = {r.ticker: r for r in LN.latest_padded(bars, ("close",), lengths, 5).collect()}
    assert set(last) == {"long", "mid"}
    assert [x[0] for x in last["mid"].seq] == [0.0] * 3 + close[close.ticker == "mid"].close.tolist()[-2:]
    flat = LN.masked_vectors(LN.latest_padded(bars, ("close",), lengths, 5)).where("ticker = 'mid'").first().features
    assert list(flat)[5:] == [0, 0, 0, 1, 1]


def test_the_measures_of_the_newest_bars(to_bars, spark):
    bars = to_bars(walk("a", 40, 1), walk("b", 40, 2), frame("flat", np.full(40, 3.0)), walk("few", 9, 4))
    related = spark.createDataFrame([("a", "b", 1), ("a", "flat", 2), ("b", "few", 1), ("flat", "a", 1)], RELATED)
    both = pairs(bars.select("ticker", "ts", "close", "volume"), related)
    got = CF.pair_state(both).select("ticker", "related_ticker", *[c.alias(n) for n, c in CF.measures().items()]).collect()
    rows = relative(both).toPandas().sort_values("ts").groupby(["ticker", "related_ticker"]).last(numeric_only=True)
    last = relative(both).toPandas().sort_values("ts").drop_duplicates(["ticker", "related_ticker"], keep="last").set_index(["ticker", "related_ticker"])
    assert len(got) == len(rows) == 4
    for r in got:
        want = last.loc[(r.ticker, r.related_ticker)]
        for c in RELATIVE:
            assert (r[c] is None) == bool(np.isnan(want[c])), (r, c)
            assert r[c] is None or r[c] == pytest.approx(want[c])


def test_coupled_tickers_without_pairs_or_features(to_bars, spark):
    bars = to_bars(walk("a", 40, 1), walk("b", 40, 2), walk("alone", 40, 3))
    state = CF.pair_state(pairs(bars.select("ticker", "ts", "close", "volume"), spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("b", "alone", 2)], RELATED)))
    close = {r.ticker: r.c for r in bars.groupBy("ticker").agg(F.max_by("close", "ts").alias("c")).collect()}
    ts = bars.agg(F.max("ts")).first()[0]
    own = spark.createDataFrame([("a", close["a"], ts, [0.5], -1.0, 1.0), ("b", close["b"], ts, None, None, None), ("alone", close["alone"], ts, [0.1], -1.0, 1.0)], "ticker string, close double, ts timestamp, x array<double>, f_min double, f_max double")
    got = CF.coupled_forecast(lambda x, seen: 0.01 * x[0] + 0.001 * seen[0]["price_ratio"], own, state, 6, "1h").toPandas().set_index(["ticker", "step"])
    assert len(got) == 6 + 1 + 1
    assert got.sentiment["b", 1] == got.sentiment["alone", 1] == "Neutral" and got.price["b", 1] == close["b"]
    price, x = close["a"], 0.5
    for step in range(1, 7):  # the price of b stays, that of a moves, and with it what a sees
        r = 0.01 * x + 0.001 * close["b"] / price
        price, x = price * np.exp(r), (r + 1) / (2 + 1e-8)
        assert got.price["a", step] == pytest.approx(price)
