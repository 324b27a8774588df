"""A ticker measured against its related tickers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.rolling import last_rows, previous
from ..schema import KEYS, PAIR_KEYS, RELATIVE
from .layout import BLOCK_ROWS, core, layout


def related_found(bars: DataFrame, related: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` related tickers of each ticker that has bars, without those that have none.

    The ranks of the remaining ones close up.
    """
    have = bars.select("ticker").distinct()
    found = (
        related.filter(F.col("rank") <= k)
        .join(have, "ticker", "left_semi")
        .join(have.withColumnRenamed("ticker", "related_ticker"), "related_ticker", "left_semi")
    )
    by_rank = Window.partitionBy(*KEYS).orderBy("rank")
    return found.select(*PAIR_KEYS, F.row_number().over(by_rank).alias("rank"))


def pairs(bars: DataFrame, found: DataFrame, related_cols=("close", "volume")) -> DataFrame:
    """Bars of a ticker beside the bars of each related ticker at the same time (long form)."""
    theirs = bars.select(
        F.col("ticker").alias("related_ticker"),
        "ts",
        *[F.col(c).alias(f"related_{c}") for c in related_cols],
    ).join(found, "related_ticker")
    return bars.join(theirs, ["ticker", "ts"])


def relative(paired: DataFrame, window: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the six relative columns; returns and frames run over the pair's common times.

    Correlations are covariance over deviations, NULL when one side does not move.
    """
    own = paired.columns
    w = last_rows(window, PAIR_KEYS)

    def both(x, y):
        return F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.lit(1))).over(w)

    df = layout(paired, before=window, keys=PAIR_KEYS, block_rows=block_rows)
    df = df.withColumns(
        {
            "_r": S.pct_change(F.col("close"), previous("close", keys=PAIR_KEYS)),
            "_related_r": S.pct_change(
                F.col("related_close"), previous("related_close", keys=PAIR_KEYS)
            ),
        }
    )
    df = df.withColumns(
        {
            "_n_close": both("close", "related_close"),
            "_cov_close": F.covar_samp("close", "related_close").over(w),
            "_sd_close": F.stddev_samp("close").over(w),
            "_sd_related_close": F.stddev_samp("related_close").over(w),
            "_n_r": both("_r", "_related_r"),
            "_cov_r": F.covar_samp("_r", "_related_r").over(w),
            "_sd_r": F.stddev_samp("_r").over(w),
            "_sd_related_r": F.stddev_samp("_related_r").over(w),
        }
    )

    def correlation(x):
        moves = F.col(f"_sd_{x}") * F.col(f"_sd_related_{x}")
        return F.when(F.col(f"_n_{x}") == window, F.try_divide(F.col(f"_cov_{x}"), moves))

    ratio = F.try_divide(F.col("related_close"), F.col("close"))
    df = df.withColumns(
        {
            "price_ratio": ratio,
            "return_difference": F.col("_related_r") - F.col("_r"),
            "relative_strength": ratio * 100.0,
            "rolling_correlation": correlation("close"),
            "volume_ratio": F.try_divide(F.col("related_volume"), F.col("volume")),
            "beta": correlation("r") * F.try_divide(F.col("_sd_related_r"), F.col("_sd_r")),
        }
    )
    return core(df).select(*own, *RELATIVE)


def at_common_times(paired: DataFrame, found: DataFrame) -> DataFrame:
    """Only the times at which a ticker and all of its related tickers have a bar."""
    wanted = found.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_wanted"))
    at_time = Window.partitionBy(*KEYS, "ts")
    return (
        paired.withColumn("_present", F.count(F.lit(1)).over(at_time))
        .join(wanted, list(KEYS))
        .filter(F.col("_present") == F.col("_wanted"))
        .drop("_present", "_wanted")
    )


def by_rank(df: DataFrame, cols, k: int, name) -> DataFrame:
    """One row per (ticker, ts) with ``cols`` of the related tickers 1..k side by side."""
    return df.groupBy(*KEYS, "ts").agg(
        *[
            F.max(F.when(F.col("rank") == i, F.col(c))).alias(name(i, c))
            for i in range(1, k + 1)
            for c in cols
        ]
    )


def relative_wide(bars: DataFrame, related: DataFrame, k: int = 5, window: int = 20, **kw) -> DataFrame:
    """(ticker, ts, <measure>_stock_<i> ...) at the times all related tickers share."""
    found = related_found(bars, related, k)
    measured = relative(pairs(bars.select(*KEYS, "ts", "close", "volume"), found), window, **kw)
    return by_rank(at_common_times(measured, found), RELATIVE, k, lambda i, c: f"{c}_stock_{i}")
