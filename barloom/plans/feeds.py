"""Long tables (ticker, series, ts, value) behind the two charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.levels import top_levels
from ..schema import KEYS, PRICES

# The overlay's series and the RSI lines.
OVERLAY = ("sma_20", "ema_20", "bb_upper", "bb_lower", "rsi")
OVERBOUGHT, OVERSOLD = 70.0, 30.0


def _long(df: DataFrame, cols) -> DataFrame:
    return df.select(*KEYS, "ts", *cols).unpivot([*KEYS, "ts"], list(cols), "series", "value")


def overlay_feed(enriched: DataFrame) -> DataFrame:
    """Candles and indicator lines; ``rsi_zone`` tells where the RSI stands to its lines."""
    long = _long(enriched, (*PRICES, *OVERLAY)).filter("value is not null")
    zone = (
        F.when(F.col("series") != "rsi", F.lit(None))
        .when(F.col("value") > OVERBOUGHT, F.lit("overbought"))
        .when(F.col("value") < OVERSOLD, F.lit("oversold"))
        .otherwise(F.lit("between"))
    )
    return long.withColumn("rsi_zone", zone)


def chart_feed(bars: DataFrame, forecasts: DataFrame, found: DataFrame, k: int = 3) -> DataFrame:
    """History, forecast and the top levels; a level is a line from the last bar to the last step."""
    predicted = forecasts.select(*KEYS, F.lit("forecast").alias("series"), "ts", F.col("price").alias("value"))
    ends = (
        bars.groupBy(*KEYS)
        .agg(F.max("ts").alias("_from"))
        .join(forecasts.groupBy(*KEYS).agg(F.max("ts").alias("_to")), list(KEYS))
    )
    lines = (
        top_levels(found, k)
        .join(ends, list(KEYS))
        .select(
            *KEYS,
            F.concat_ws("_", "kind", "number").alias("series"),
            F.explode(F.array("_from", "_to")).alias("ts"),
            F.col("level").alias("value"),
        )
    )
    return _long(bars, PRICES).unionByName(predicted).unionByName(lines)
