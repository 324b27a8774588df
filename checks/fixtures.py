"""Bars made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.schema import RELATED, RELATIVE, return_features
from barloom.sources.bars import build_bars

# each event type is compared with all the others
TYPES = ("click", "view", "purchase", "signup", "error")
RELATED_ROWS = [
    (t, other, rank) for t in TYPES for rank, other in enumerate((o for o in TYPES if o != t), start=1)
]


# of the last digit shown: a value between two results goes up, whichever way its sum was rounded
SHIFT = 0.00037


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def event_bars(spark, sf, interval="1h") -> DataFrame:
    return build_bars(
        table(spark, sf, "events"), interval, ticker="event_type", price="value", id="event_id"
    )


def order_bars(spark, sf, interval="1d", start=None, end=None) -> DataFrame:
    return build_bars(
        table(spark, sf, "orders"), interval,
        ticker="o_orderpriority", ts="o_orderdate", price="o_totalprice", id="o_orderkey", start=start, end=end,
    )


def order_weeks(spark, sf) -> DataFrame:
    """Weeks have enough orders for bars that are rarely flat, so that the money flow is defined."""
    return order_bars(spark, sf, "1wk")


def user_bars(spark, sf, interval="1d") -> DataFrame:
    """Many tickers: one per event type and user."""
    ticks = table(spark, sf, "events").withColumn("ticker", F.concat_ws(":", "event_type", "user_id"))
    return build_bars(ticks, interval, price="value", id="event_id")


def user_minutes(spark, sf) -> DataFrame:
    """A ticker per user, with enough bars for the averages of a trend."""
    ticks = table(spark, sf, "events").withColumn("ticker", F.col("user_id").cast("string"))
    return build_bars(ticks, "1m", price="value", id="event_id")


def related(spark) -> DataFrame:
    return spark.createDataFrame(RELATED_ROWS, RELATED)


def related_columns(k: int) -> list[str]:
    """The features of a ticker and of its first ``k`` related ones, in the order of their sequences."""
    relative = [f"{c}_stock_{i}" for i in range(1, k + 1) for c in RELATIVE]
    return [*return_features(), *relative, *(f"related_{i}_{c}" for i in range(1, k + 1) for c in return_features())]


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, timestamps without a zone, so that both engines print the same."""

    def cell(field):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            return F.round(c + F.lit(SHIFT * 10.0**-digits), digits).alias(field.name)
        if isinstance(field.dataType, T.TimestampType):
            return c.cast("timestamp_ntz").alias(field.name)
        return c

    return df.select(*[cell(f) for f in df.schema.fields])
