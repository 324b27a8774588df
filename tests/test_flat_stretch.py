"""Directional movement around a stretch without trades, against pandas."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators import indicators as I

from .test_indicators import walk


def stuck(n, spread):
    """100 moving bars, ``n`` that stand still, 50 moving ones."""
    df = walk("a", 150 + n, 7)
    price = df.close[99]
    for c, move in (("open", 0.0), ("high", spread), ("low", -spread), ("close", 0.0)):
        df.loc[100 : 99 + n, c] = price + move
    return df


def by_definition(df):
    h, low, prev = df.high, df.low, df.close.shift()
    tr = pd.concat([h - low, (h - prev).abs(), (low - prev).abs()], axis=1).max(axis=1)
    up, down = h.diff(), low.diff()
    up[up < 0], down[down > 0] = 0, 0
    mean = lambda x: x.ewm(alpha=1 / 14).mean()
    plus, minus = 100 * mean(up) / mean(tr), (100 * mean(down) / mean(tr)).abs()
    dx = 100 * (plus - minus).abs() / (plus + minus)
    return pd.DataFrame({"plus_di": plus, "minus_di": minus, "dx": dx, "adx": mean(dx)})


@pytest.mark.parametrize("n", [1200, 2500])
@pytest.mark.parametrize("spread", [0.0, 0.25])
@pytest.mark.parametrize("block_rows", [700, 65_536])
def test_a_stretch_keeps_its_history(to_bars, n, spread, block_rows):
    df = stuck(n, spread)
    got = I.adx(to_bars(df), block_rows=block_rows).toPandas().sort_values("ts").reset_index(drop=True)
    want = by_definition(df)
    for c in want:
        assert got[c].isna().equals(want[c].isna()), c
        np.testing.assert_allclose(got[c].astype(float), want[c], rtol=1e-6, atol=1e-6, err_msg=c)
