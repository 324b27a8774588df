"""Day-level aggregates and the labels taken from the following trading day.

Bars are first reduced to one row per ticker and date; only those rows meet in a window, so a
ticker costs one row per trading day there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..schema import KEYS, PRICES


def _by_date(keys=KEYS):
    return Window.partitionBy(*keys).orderBy("date")


def daily(bars: DataFrame, keys=KEYS) -> DataFrame:
    """(ticker, date, avg_price, close, n_bars): mean of the bars' mean price, last close, size."""
    return (
        bars.withColumn("date", S.day_of())
        .groupBy(*keys, "date")
        .agg(
            F.avg(S.row_mean(*PRICES)).alias("avg_price"),
            F.max_by("close", "ts").alias("close"),
            F.count(F.lit(1)).alias("n_bars"),
        )
    )


def trading_dates(bars: DataFrame, keys=KEYS) -> DataFrame:
    """Distinct dates with the next one; a ticker's last date is followed by itself."""
    dates = bars.select(*keys, S.day_of().alias("date")).distinct()
    following = F.coalesce(F.lead("date").over(_by_date(keys)), F.col("date"))
    return dates.withColumn("next_date", following)


def opening_average(bars: DataFrame, n: int = 6, keys=KEYS) -> DataFrame:
    """Mean price of a day's first ``n`` bars, NULL for a day with fewer."""
    within = Window.partitionBy(*keys, "date").orderBy("ts")
    return (
        bars.withColumn("date", S.day_of())
        .withColumn("_place", F.row_number().over(within))
        .filter(F.col("_place") <= n)
        .groupBy(*keys, "date")
        .agg(
            F.when(F.count(F.lit(1)) >= n, F.avg(S.row_mean(*PRICES))).alias("opening_avg")
        )
    )


def next_day_opening(bars: DataFrame, n: int = 6, keys=KEYS) -> DataFrame:
    """Add ``next_opening_avg``: the opening average of the ticker's next trading date.

    As the last date is followed by itself, its bars see their own day's value.
    """
    following = trading_dates(bars, keys).join(
        opening_average(bars, n, keys).withColumnsRenamed(
            {"date": "next_date", "opening_avg": "next_opening_avg"}
        ),
        [*keys, "next_date"],
        "left",
    )
    return _onto_bars(bars, following.drop("next_date"), keys)


def next_day_label(bars: DataFrame, min_bars: int = 2, keys=KEYS) -> DataFrame:
    """Add ``next_return`` and ``sentiment`` (1 = bearish).

    The return is ln(next day's average price / this day's close); it is 0 on the last day and
    when the next day has fewer than ``min_bars`` bars. It is infinite after a close of 0.
    """
    w = _by_date(keys)
    rise = F.when(F.col("_next_avg") > 0, F.lit(float("inf"))).when(F.col("_next_avg") == 0, F.lit(float("nan")))
    change = F.when(F.col("close") == 0, rise).otherwise(S.log_ratio(F.col("_next_avg"), F.col("close")))
    label = (
        daily(bars, keys)
        .withColumns({"_next_avg": F.lead("avg_price").over(w), "_next_n": F.lead("n_bars").over(w)})
        .select(
            *keys,
            "date",
            F.when(F.col("_next_n") >= min_bars, change)
            .otherwise(F.lit(0.0))
            .alias("next_return"),
        )
    )
    labelled = _onto_bars(bars, label, keys)
    return labelled.withColumn("sentiment", (F.col("next_return") <= 0).cast("int"))


def next_day_close(bars: DataFrame, keys=KEYS) -> DataFrame:
    """Add ``next_close`` and ``close_sentiment`` (1 when the next close is not above the bar's).

    Every bar sees the last close of the next trading day; the last day sees its own.
    """
    following = daily(bars, keys).select(
        *keys,
        "date",
        F.coalesce(F.lead("close").over(_by_date(keys)), F.col("close")).alias("next_close"),
    )
    labelled = _onto_bars(bars, following, keys)
    return labelled.withColumn("close_sentiment", (F.col("next_close") <= F.col("close")).cast("int"))


def _onto_bars(bars: DataFrame, by_day: DataFrame, keys) -> DataFrame:
    # (ticker, date) is far finer than ticker: no single key can dominate this join
    return bars.withColumn("date", S.day_of()).join(by_day, [*keys, "date"], "left").drop("date")
