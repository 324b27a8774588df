"""Answers that need only the newest bars of each ticker.

``newest`` limits rows before the shuffle (each task keeps at most ``n`` rows per ticker), so a
very large ticker sends no more than a small one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import previous
from ..schema import KEYS
from .indicators import RECIPES, apply_steps
from .layout import one_block


def newest(df: DataFrame, n: int, order: str = "ts", keys=KEYS) -> DataFrame:
    """The last ``n`` rows of each key, with ``age`` 1 for the last one."""
    backwards = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("age", F.row_number().over(backwards)).filter(F.col("age") <= n)


def last_row(df: DataFrame, cols, order: str = "ts", keys=KEYS) -> DataFrame:
    """One row per key: the given columns where ``order`` is highest."""
    row = F.max_by(F.struct(*cols), order).alias("r")
    return df.groupBy(*keys).agg(row).select(*keys, "r.*")


def trend(bars: DataFrame, window: int = 20) -> DataFrame:
    """(ticker, ts, close, trend) of each ticker's last bar.

    Both averages, the RSI and the price change of the last bar come from its last 51 bars.
    """
    tail = newest(bars.select(*KEYS, "ts", "close"), max(51, window)).drop("age")
    state = apply_steps(one_block(tail), [RECIPES["sma"](), RECIPES["rsi"]()])
    state = state.withColumn("_then", previous("close", window - 1))
    last = last_row(state, ("ts", "close", "sma_20", "sma_50", "rsi", "_then", "n_rows"))
    return last.withColumn("trend", trend_of(window)).select(*KEYS, "ts", "close", "trend")


def trend_of(window: int):
    close, fast, slow = F.col("close"), F.col("sma_20"), F.col("sma_50")
    change = F.try_divide(close - F.col("_then"), F.col("_then"))
    up = (close > fast) & (fast > slow) & (F.col("rsi") > 50) & (change > 0)
    down = (close < fast) & (fast < slow) & (F.col("rsi") < 50) & (change < 0)
    return (
        F.when(F.col("n_rows") < window, F.lit("Insufficient data"))
        .when(up, F.lit("Bullish"))
        .when(down, F.lit("Bearish"))
        .otherwise(F.lit("Neutral"))
    )


def summary(bars: DataFrame) -> DataFrame:
    """One row per ticker: last and previous close, change in percent, mean volume, high, low."""
    ends = (
        newest(bars.select(*KEYS, "ts", "close"), 2)
        .groupBy(*KEYS)
        .agg(
            F.max_by("close", "ts").alias("last_close"),
            # with a single bar the previous close is the last one
            F.min_by("close", "ts").alias("previous_close"),
        )
    )
    ranges = bars.groupBy(*KEYS).agg(
        F.avg("volume").alias("avg_volume"),
        F.max("high").alias("period_high"),
        F.min("low").alias("period_low"),
    )
    change = 100.0 * F.try_divide(
        F.col("last_close") - F.col("previous_close"), F.col("previous_close")
    )
    return ends.withColumn("change_pct", change).join(ranges, list(KEYS))


def data_summary(bars: DataFrame) -> DataFrame:
    """Row count, first and last bar time per ticker."""
    return bars.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_bars"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def enough_bars(bars: DataFrame, at_least: int) -> DataFrame:
    """Only the bars of tickers that have ``at_least`` of them."""
    big = bars.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= at_least)
    return bars.join(big.select(*KEYS), list(KEYS), "left_semi")
