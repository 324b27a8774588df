"""Bars stored as the blocks that the window operators work on.

Every operator with a frame numbers the bars and brings those of a block together: two exchanges of all bars. Stored once
in a table bucketed by (ticker, block), with their places and with the neighbours that frames reach into, they are read
back as they lie: ``indicators``, ``level_flags`` and whatever else calls ``layout`` plan no exchange at all.

A block is a bounded number of bars, so a ticker with a third of all bars fills many buckets, not one. ``before`` and
``after`` say how far frames may reach; they cost that many rows a block. An operator that reaches further cuts the
blocks anew, from the stored places.

New bars change the places of none before them, but the last block of their ticker and its number of rows: ``append``
writes a new table of the old bars and the new ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layout import BLOCK_ROWS, HELPERS, laid_with, layout
from ..schema import KEYS
from ..session import fresh_path

# the usual indicators but the directional movement reach less far
BEFORE, AFTER = 1_000, 50


def save_laid(
    bars: DataFrame, name: str, buckets: int, before: int = BEFORE, after: int = AFTER,
    block_rows: int = BLOCK_ROWS, path: str | None = None,
) -> None:
    """Write ``bars`` (one row a ticker and time) as the table ``name``; a task writes one bucket, one file.

    ``path`` is a folder that all executors reach, by default a new one in the shared folder. A table of that name is
    replaced, the files of the old one stay.
    """
    own = [c for c in bars.columns if c not in HELPERS]
    laid = layout(bars.select(*own), before, after, block_rows=block_rows).repartition(buckets, *KEYS, "block")
    how = {"before": before, "after": after, "block_rows": block_rows, "keys": list(KEYS)}
    (
        laid.withMetadata("block", {"laid": how})
        .write.format("parquet")
        .mode("overwrite")
        .option("path", path or fresh_path(bars.sparkSession, "laid"))
        .bucketBy(buckets, *KEYS, "block")
        .sortBy(*KEYS, "block", "stripe", "pos")
        .saveAsTable(name)
    )


def load_laid(spark: SparkSession, name: str) -> DataFrame:
    """The stored blocks, neighbours and helper columns included, for operators that lay out bars."""
    laid = spark.table(name)
    if laid_with(laid) is None:
        raise ValueError(f"{name} does not hold stored blocks")
    return laid


def stored_bars(spark: SparkSession, name: str, start=None, end=None) -> DataFrame:
    """The bars themselves, each once; the bounds (``start`` included, ``end`` not) are predicates of the scan."""
    bars = load_laid(spark, name).filter("is_core")
    if start is not None:
        bars = bars.filter(F.col("ts") >= F.lit(start))
    if end is not None:
        bars = bars.filter(F.col("ts") < F.lit(end))
    return bars.drop(*HELPERS)


def append(spark: SparkSession, name: str, new: DataFrame, into: str, buckets: int) -> None:
    """The bars of ``name`` and those of ``new``, cut alike, as the table ``into``.

    A bar of ``new`` replaces an old one of its ticker and time.
    """
    how = laid_with(load_laid(spark, name))
    if into == name:
        raise ValueError("a table that is read can't be replaced")
    old = stored_bars(spark, name)
    kept = old.join(new.select(*KEYS, "ts"), [*KEYS, "ts"], "left_anti")
    both = kept.select(*old.columns).unionByName(new.select(*old.columns))
    save_laid(both, into, buckets, how["before"], how["after"], how["block_rows"])
