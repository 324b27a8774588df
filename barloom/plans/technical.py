"""The technical-analysis page as one set of DataFrames over the same bars."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from ..operators.indicators import indicators
from ..operators.latest import last_row, summary, trend
from ..operators.levels import levels, top_levels
from ..schema import KEYS


class TechnicalReport(NamedTuple):
    bars: DataFrame
    summary: DataFrame
    trend: DataFrame
    levels: DataFrame
    latest: DataFrame


def technical_report(bars: DataFrame, window: int = 20) -> TechnicalReport:
    """Indicators per bar; summary, trend, top levels and newest indicator values per ticker.

    Nothing runs until one of the frames is used. Persist ``bars`` first when several are.
    """
    enriched = indicators(bars)
    return TechnicalReport(
        enriched,
        summary(bars),
        trend(bars, window),
        top_levels(levels(bars, window)),
        last_row(enriched, ("ts", "rsi", "sma_20", "ema_20", "bb_upper", "bb_lower")).select(
            *KEYS, "ts", "rsi", "sma_20", "ema_20", "bb_upper", "bb_lower"
        ),
    )
