"""Bars from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..sources.bars import ohlcv, tick_order
from ..sources.periods import interval_parts


def stream_bars(
    ticks: DataFrame,
    interval: str,
    ticker: str = "ticker",
    ts: str = "ts",
    price: str = "price",
    volume: str | None = None,
    id: str = "id",
    late: str = "2 hours",
    once: bool = False,
) -> DataFrame:
    """Tumbling bars; a bar is emitted once the watermark has passed its end, later ticks are dropped.

    State is one aggregate per open (ticker, bar). With ``once`` a tick that is delivered again, the same ticker, time and id,
    counts once; ids must not be null. That adds the keys of the ticks not older than ``late`` to the state.
    """
    n, unit = interval_parts(interval)
    if unit in ("week", "month"):
        raise ValueError("a stream window needs a fixed length of at most days")
    order = tick_order(ticks.schema[id].dataType)
    typed = ticks.select(
        F.col(ticker).cast("string").alias("ticker"),
        F.col(ts).cast("timestamp").alias("_at"),
        S.finite(price).alias("_price"),
        F.col(id).alias("_id"),
        (F.lit(1.0) if volume is None else F.col(volume)).alias("_volume"),
    ).withWatermark("_at", late)
    if once:
        typed = typed.dropDuplicatesWithinWatermark(["ticker", "_at", "_id"])
    return (
        typed.groupBy("ticker", F.window("_at", f"{n} {unit}"))
        .agg(*ohlcv(F.col("_price"), order, F.col("_volume")))
        .select("ticker", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def tick_stream(spark: SparkSession, folder: str, like: DataFrame, glob: str = "*.parquet") -> DataFrame:
    """Files of a folder as a stream, in the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("pathGlobFilter", glob).parquet(folder)


def land(bars: DataFrame, path: str, checkpoint: str):
    """Append finished bars to parquet files; everything available now, then stop."""
    return (
        bars.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def land_versions(bars: DataFrame, path: str, checkpoint: str):
    """Write every bar as soon as it has a tick, and again when it changes; nothing waits for the watermark.

    Each batch replaces its own folder ``batch=<id>``, so a batch that is run again leaves no second copy.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")

    return (
        bars.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def newest_versions(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The last version of every bar that ``land_versions`` wrote."""
    values = [c for c in like.columns if c not in ("ticker", "ts")]
    written = spark.read.schema(like.schema.add("batch", "long")).option("basePath", path).parquet(path)
    last = F.max_by(F.struct(*values), "batch").alias("last")
    return written.groupBy("ticker", "ts").agg(last).select("ticker", "ts", "last.*")
