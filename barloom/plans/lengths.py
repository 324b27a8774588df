"""Sequences of unequal length: every ticker has the length that its own history allows.

Shorter sequences are padded in front to the longest one, so that a model of one width takes them all, and a mask tells
padding from bars. A ticker with too little history for one bar is reported, and no other ticker gets shorter for it.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import block_window
from ..operators.layout import BLOCK_ROWS, HELPERS, core, join_rows, layout, positions
from ..schema import KEYS
from ..sources.periods import LONGEST_SHARE, least_history

PADDED = ("seq", "pad", "mask")


def sequence_lengths(bars: DataFrame, interval: str, forecast_days: int) -> DataFrame:
    """(ticker, n_bars, length, too_short): bars of at least three days, of a fifth of the ticker's at most."""
    counted = bars.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_bars"))
    own = F.least(F.lit(least_history(interval, forecast_days)), F.floor(F.col("n_bars") * LONGEST_SHARE)).cast("int")
    return counted.withColumn("length", own).withColumn("too_short", F.col("length") < 1)


def width_of(lengths: DataFrame) -> int:
    """The longest length, which all sequences are padded to; one number."""
    return max(1, lengths.agg(F.max("length")).first()[0] or 0)


def _padded(rows: Column, own: Column, width: int, zero: Column) -> dict[str, Column]:
    """``rows``, the newest of them at the end, cut to ``own`` rows and padded to ``width``."""
    pad = (F.lit(width) - own).cast("int")
    kept = F.slice(rows, -own, own)
    return {
        "seq": F.concat(F.array_repeat(zero, pad), kept),
        "pad": pad,
        "mask": F.concat(F.array_repeat(F.lit(0.0), pad), F.array_repeat(F.lit(1.0), own)),
    }


def padded_sequences(df: DataFrame, cols, lengths: DataFrame, width: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``seq``, ``pad`` and ``mask``: the rows before a row, as many as its ticker's length.

    The row itself carries the label. Rows with fewer before them, and tickers that are too short, drop.
    """
    own = [c for c in df.columns if c not in HELPERS]
    joined = join_rows(df if "pos" in df.columns else positions(df), lengths.where("not too_short").select(*KEYS, F.col("length").alias("_length")), list(KEYS))
    laid = layout(joined.where("_length is not null"), before=width, block_rows=block_rows)
    frame = block_window().rowsBetween(-width, -1)
    laid = laid.withColumn("_rows", F.collect_list(F.array(*cols)).over(frame)).where(F.size("_rows") >= F.col("_length"))
    zero = F.array(*[F.lit(0.0) for _ in cols])
    return core(laid).withColumns(_padded(F.col("_rows"), F.col("_length"), width, zero)).select(*own, *PADDED)


def latest_padded(df: DataFrame, cols, lengths: DataFrame, width: int) -> DataFrame:
    """One row per ticker with its newest rows in ``seq``, ``pad`` and ``mask``; tickers that are too short drop."""
    joined = join_rows(positions(df.select(*KEYS, "ts", F.array(*cols).alias("_step"))), lengths.where("not too_short").select(*KEYS, F.col("length").alias("_length")), list(KEYS))
    tail = joined.where(F.col("pos") >= F.col("n_rows") - F.col("_length"))
    packed = F.sort_array(F.collect_list(F.struct("ts", "_step"))).alias("_rows")
    rows = tail.groupBy(*KEYS, "_length").agg(packed).where(F.size("_rows") == F.col("_length"))
    zero = F.array(*[F.lit(0.0) for _ in cols])
    return rows.withColumns(_padded(F.col("_rows")["_step"], F.col("_length"), width, zero)).select(*KEYS, *PADDED)


def masked_vectors(sequences: DataFrame) -> DataFrame:
    """Add ``features``: the sequence row after row, then the mask."""
    return sequences.withColumn("features", array_to_vector(F.concat(F.flatten("seq"), F.col("mask"))))
