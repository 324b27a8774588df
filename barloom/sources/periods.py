"""The periods and intervals a user can ask for."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What can be chosen, how many days a unit counts, how wide an interval is.
PERIOD_DAYS = {"d": 1, "mo": 30, "y": 365}
DEFAULT_PERIOD_DAYS = 365
INTERVALS = {
    "1m": (1, "minute"), "5m": (5, "minute"), "15m": (15, "minute"), "30m": (30, "minute"),
    "1h": (1, "hour"), "1d": (1, "day"), "5d": (5, "day"), "1wk": (1, "week"), "1mo": (1, "month"),
}
STEPS_PER_DAY = {
    "1m": 390, "5m": 78, "15m": 26, "30m": 13, "1h": 6.5, "1d": 1, "5d": 1 / 5, "1wk": 1 / 7, "1mo": 1 / 30,
}

LONGEST_SHARE = 0.2


def period_start(period: str, as_of: datetime) -> datetime | None:
    """Where a period begins; None for ``max``."""
    if period == "max":
        return None
    if period == "ytd":
        return datetime(as_of.year, 1, 1)
    match = re.fullmatch(r"(\d+)(d|mo|y)", period)
    days = int(match[1]) * PERIOD_DAYS[match[2]] if match else DEFAULT_PERIOD_DAYS
    return as_of - timedelta(days=days)


def period_bounds(period: str, as_of: datetime) -> tuple[datetime | None, datetime]:
    """The first moment of a period's first day (None for ``max``) and the end of the day of ``as_of``."""
    upto = datetime(as_of.year, as_of.month, as_of.day) + timedelta(days=1)
    start = period_start(period, as_of)
    return start and datetime(start.year, start.month, start.day), upto


def period_filter(bars: DataFrame, period: str, as_of: datetime) -> DataFrame:
    """Bars of a period; plain bounds, so a scan of bars skips. Give ``period_bounds`` to ``build_bars`` to prune ticks."""
    start, upto = period_bounds(period, as_of)
    kept = bars.filter(F.col("ts") < F.lit(upto))
    return kept if start is None else kept.filter(F.col("ts") >= F.lit(start))


def interval_parts(interval: str) -> tuple[int, str]:
    """(multiplier, unit) of an interval; unknown ones are refused."""
    if interval not in INTERVALS:
        raise ValueError(f"unsupported interval: {interval}")
    return INTERVALS[interval]


def bar_start(ts: Column, interval: str) -> Column:
    """The start of the bar a tick belongs to; weeks start on Monday, months on the 1st."""
    n, unit = interval_parts(interval)
    if unit in ("week", "month"):
        return F.date_trunc(unit, ts)
    return F.window(ts, f"{n} {unit}")["start"]


def interval_seconds(interval: str) -> int:
    """Length of an ``m``, ``h`` or ``d`` interval."""
    match = re.fullmatch(r"(\d+)([mhd])", interval)
    if not match:
        raise ValueError(f"unsupported interval format: {interval}")
    return int(match[1]) * {"m": 60, "h": 3600, "d": 86_400}[match[2]]


def trading_steps(interval: str, days: float) -> int:
    """Bars of ``interval`` in ``days`` trading days, at least 1."""
    if interval not in STEPS_PER_DAY:
        raise ValueError(f"unsupported interval: {interval}")
    return max(1, int(days * STEPS_PER_DAY[interval]))


def least_history(interval: str, forecast_days: int) -> int:
    """Bars of three days, or of as many as are forecast."""
    return trading_steps(interval, 1) * max(3, forecast_days)


def sequence_length(interval: str, forecast_days: int, n_rows: int) -> int:
    """History per sample: at least 3 days of bars, at most a fifth of the rows."""
    return min(least_history(interval, forecast_days), int(n_rows * LONGEST_SHARE))
