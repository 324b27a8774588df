"""Reading bars and building them from ticks."""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from ..schema import BARS, KEYS, PRICES
from .periods import bar_start, interval_parts

# The regular trading session.
SESSION = ("09:30", "16:00")
SESSION_ZONE = "America/New_York"


def clean(bars: DataFrame) -> DataFrame:
    """Bars in the library's schema; a NaN or infinite number becomes NULL."""
    return bars.select(
        F.col("ticker").cast("string"),
        F.col("ts").cast("timestamp"),
        *[S.finite(c).alias(c) for c in (*PRICES, "volume")],
    )


def whole(bars: DataFrame) -> DataFrame:
    """Only bars with a key and all prices, as the recursive indicators need them."""
    return bars.na.drop("any", subset=[*KEYS, "ts", *PRICES])


def read_bars(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    tickers=None,
    start: datetime | None = None,
    end: datetime | None = None,
    **options,
) -> DataFrame:
    """Landed bars as parquet, orc, csv or json files, or a table (``format="table"``).

    The bounds (``start`` included, ``end`` not) and tickers, as given, are plain predicates for the scan.
    """
    if format == "table":
        raw = spark.table(path)
    else:
        reader = spark.read.format(format).options(**options)
        raw = (reader if format in ("parquet", "orc") else reader.schema(BARS)).load(path)
    if tickers is not None:
        raw = raw.filter(F.col("ticker").isin(list(tickers)))
    if start is not None:
        raw = raw.filter(F.col("ts") >= F.lit(start))
    if end is not None:
        raw = raw.filter(F.col("ts") < F.lit(end))
    return clean(raw)


def from_epoch_millis(df: DataFrame, column: str = "timestamp") -> DataFrame:
    return df.withColumn("ts", F.timestamp_millis(F.col(column))).drop(column)


def ohlcv(price: Column, order: Column, volume: Column) -> list[Column]:
    """The aggregates of one bar; ``order`` must be unique within it."""
    return [
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum(volume).cast("double").alias("volume"),
    ]


def tick_order(id_type: T.DataType | None) -> Column:
    """The order of ticks by ``_at``, then ``_id``; no ``_id`` where the type is None.

    For a whole-number id it is one decimal (times 2 * 10^19, more than the ids span), which Spark aggregates by
    hash; a struct, for other ids, makes it sort all ticks first.
    """
    if id_type is None:
        return F.col("_at")
    if isinstance(id_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        micros = F.unix_micros("_at").cast("decimal(18,0)")
        return (micros * F.lit(Decimal(2 * 10**19)).cast("decimal(20,0)") + F.col("_id")).cast("decimal(38,0)")
    return F.struct("_at", "_id")


def build_bars(
    ticks: DataFrame,
    interval: str,
    ticker: str = "ticker",
    ts: str = "ts",
    price: str = "price",
    volume: str | None = None,
    id: str | None = "id",
    start: datetime | None = None,
    end: datetime | None = None,
    once: bool = False,
) -> DataFrame:
    """Bars of any width; ticks at the same time are ordered by ``id``.

    All aggregates combine before the shuffle, so a crowded bar costs one row per task. With
    ``id=None`` the caller vouches that a ticker's tick times are unique. ``start`` (included) and ``end`` (not) bound
    the bars' times; the scan gets the same bounds on the ticks, widened by an interval so that edge bars are whole.
    With ``once`` a tick that is there again, the same ticker, time and id, counts once; this costs a shuffle of the ticks.
    """
    if once and id is None:
        raise ValueError("once needs an id")
    interval_parts(interval)
    wide, kind = timedelta(days=32), ticks.schema[ts].dataType
    if start is not None:  # in the column's own type, else the scan does not take it
        ticks = ticks.filter(F.col(ts) >= F.lit(start - wide).cast(kind))
    if end is not None:
        ticks = ticks.filter(F.col(ts) < F.lit(end + wide).cast(kind))
    tie = [] if id is None else [F.col(id).alias("_id")]
    typed = ticks.select(
        F.col(ticker).cast("string").alias("ticker"),
        F.col(ts).cast("timestamp").alias("_at"),
        S.finite(price).alias("_price"),
        *tie,
        (F.lit(1.0) if volume is None else F.col(volume)).alias("_volume"),
    )
    if once:
        typed = typed.dropDuplicates(["ticker", "_at", "_id"])
    order = tick_order(ticks.schema[id].dataType if tie else None)
    placed = typed.withColumn("ts", bar_start(F.col("_at"), interval))
    if start is not None:
        placed = placed.filter(F.col("ts") >= F.lit(start))
    if end is not None:
        placed = placed.filter(F.col("ts") < F.lit(end))
    return (
        placed.groupBy(*KEYS, "ts")
        .agg(*ohlcv(F.col("_price"), order, F.col("_volume")))
    )


def roll_up(bars: DataFrame, interval: str) -> DataFrame:
    """Wider bars from narrower ones."""
    return (
        bars.withColumn("_at", F.col("ts"))
        .withColumn("ts", bar_start(F.col("_at"), interval))
        .groupBy(*KEYS, "ts")
        .agg(
            F.min_by("open", "_at").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "_at").alias("close"),
            F.sum("volume").alias("volume"),
        )
    )


def market_hours(
    bars: DataFrame, start: str = SESSION[0], end: str = SESSION[1], tz: str = SESSION_ZONE
) -> DataFrame:
    """Bars whose local time of day lies between two ``HH:MM`` bounds, both included."""
    # timestamps are instants; the session zone's wall clock is moved to the market's
    local = F.convert_timezone(None, F.lit(tz), F.col("ts").cast("timestamp_ntz"))
    clock = F.date_format(local, "HH:mm:ss.SSSSSS")
    return bars.filter(clock.between(f"{start}:00.000000", f"{end}:00.000000"))
