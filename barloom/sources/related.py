"""Bars of related tickers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.relative import related_found


def related_bars(bars: DataFrame, related: DataFrame, k: int = 5) -> DataFrame:
    """(ticker, related_ticker, rank) with the bars of the related ticker; those without bars drop out."""
    theirs = bars.withColumnRenamed("ticker", "related_ticker")
    return related_found(bars, related, k).join(theirs, "related_ticker")
