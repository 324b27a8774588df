"""Column names and types shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ("ticker",)
PAIR_KEYS = ("ticker", "related_ticker")

PRICES = ("open", "high", "low", "close")

BARS = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)

RELATED = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("related_ticker", T.StringType()),
        T.StructField("rank", T.IntegerType()),
    ]
)

# The model features, in model order.
FEATURES = (
    "open", "high", "low", "close", "volume",
    "sma_20", "sma_50", "ema_20", "rsi",
    "bb_middle", "bb_upper", "bb_lower",
    "macd", "signal_line",
    "atr", "bb_width",
    "pct_k", "pct_d", "williams_r",
    "obv", "cmf", "pvt", "adx",
)

# What is measured against each related ticker.
RELATIVE = (
    "price_ratio", "return_difference", "relative_strength",
    "rolling_correlation", "volume_ratio", "beta",
)


def return_features(features=FEATURES) -> list[str]:
    """The feature list with each price replaced by its log return."""
    return [f"{c}_return" if c in PRICES else c for c in features]
