import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session(4)
    yield spark
    spark.stop()


def frame(ticker, close, start="2024-01-01", freq="h", high=None, low=None, open=None, volume=None):
    """Bars of one ticker from its closes; the bar is one unit high unless told otherwise."""
    n = len(close)
    close = pd.Series(close, dtype="float64")
    return pd.DataFrame(
        {
            "ticker": ticker,
            "ts": pd.date_range(start, periods=n, freq=freq),
            "open": close if open is None else open,
            "high": close + 0.5 if high is None else high,
            "low": close - 0.5 if low is None else low,
            "close": close,
            "volume": [float(100 + i % 7) for i in range(n)] if volume is None else volume,
        }
    )


@pytest.fixture(scope="session")
def to_bars(spark):
    from barloom.schema import BARS
    from barloom.sources.bars import clean

    def make(*frames):
        rows = pd.concat(frames, ignore_index=True).sample(frac=1.0, random_state=1)
        return clean(spark.createDataFrame(rows, BARS))

    return make
