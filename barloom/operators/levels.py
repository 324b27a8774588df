"""Support and resistance levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import block_window
from ..schema import KEYS
from .layout import BLOCK_ROWS, HELPERS, core, layout


def level_flags(bars: DataFrame, window: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``is_support`` and ``is_resistance``.

    A bar's low is a support when none of the ``window`` lows on either side is below it; ties
    count, and both sides must be complete. Highs give resistances the same way.
    """
    df = layout(bars, before=window, after=window, block_rows=block_rows)
    sides = (block_window().rowsBetween(-window, -1), block_window().rowsBetween(1, window))

    def extreme(c, agg):
        return [F.when(F.count(c).over(w) == window, agg(c).over(w)) for w in sides]

    df = df.withColumns(
        dict(zip(("_low_before", "_low_after"), extreme("low", F.min), strict=True))
        | dict(zip(("_high_before", "_high_after"), extreme("high", F.max), strict=True))
    )
    support = (F.col("low") <= F.col("_low_before")) & (F.col("low") <= F.col("_low_after"))
    resistance = (F.col("high") >= F.col("_high_before")) & (F.col("high") >= F.col("_high_after"))
    return core(
        df.withColumns(
            {
                "is_support": F.coalesce(support, F.lit(False)),
                "is_resistance": F.coalesce(resistance, F.lit(False)),
            }
        )
    ).select(*[c for c in bars.columns if c not in HELPERS], "is_support", "is_resistance")


def levels(bars: DataFrame, window: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Distinct (ticker, kind, level)."""
    flagged = level_flags(bars, window, block_rows)
    found = F.array(
        F.when(F.col("is_support"), F.struct(F.lit("support").alias("kind"), F.col("low").alias("level"))),
        F.when(
            F.col("is_resistance"), F.struct(F.lit("resistance").alias("kind"), F.col("high").alias("level"))
        ),
    )
    return (
        flagged.filter("is_support or is_resistance")
        .select(*KEYS, F.explode(F.array_compact(found)).alias("l"))
        .select(*KEYS, "l.*")
        .distinct()
    )


def top_levels(found: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` highest levels of each kind, numbered upwards from the lowest of them."""
    highest = Window.partitionBy(*KEYS, "kind").orderBy(F.desc("level"))
    upwards = Window.partitionBy(*KEYS, "kind").orderBy("level")
    return (
        found.withColumn("_place", F.row_number().over(highest))
        .filter(F.col("_place") <= k)
        .withColumn("number", F.row_number().over(upwards))
        .drop("_place")
    )
