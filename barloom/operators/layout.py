"""Lay bars out in bounded blocks so that windows never depend on the size of a ticker.

A window partitioned by ticker puts all bars of that ticker in one task. Here a ticker is cut
into blocks of ``block_rows`` consecutive bars, and each block carries the few neighbouring bars
its frames reach into. Windows partitioned by (ticker, block) then give the same answer.

Columns added: ``pos`` (0-based place within the key), ``n_rows`` (bars of the key), ``block``,
``stripe`` (see ``functions.ewm``), ``is_core`` (false for the borrowed neighbours) and
``is_block_end`` (the last core row of its block).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ewm import STRIPE_ROWS
from ..schema import KEYS

BLOCK_ROWS = 65_536
BUCKET_SECONDS = 30 * 86_400
HELPERS = ("pos", "n_rows", "block", "stripe", "is_core", "is_block_end")


def join_rows(df: DataFrame, more: DataFrame, by) -> DataFrame:
    """Every row of ``df`` beside the columns of ``more`` (at most one row for each of ``by``); a NULL equals a NULL."""
    theirs = more.select(*[F.col(c).alias(f"_by_{c}") for c in by], *[c for c in more.columns if c not in by])
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    return df.join(theirs, same, "left").drop(*[f"_by_{c}" for c in by])


def positions(df: DataFrame, keys=KEYS, order: str = "ts", bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Add ``pos`` and ``n_rows``.

    Rows are numbered inside time buckets and shifted by the row counts of the earlier buckets;
    only the counts are ever brought together per key. A bucket holds at most one row per bar
    time, so its size is set by the bar width and not by the data.
    """
    bucket = F.floor(F.unix_seconds(F.col(order)) / bucket_seconds).alias("_bucket")
    per_key = Window.partitionBy(*keys)
    earlier = per_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*keys, bucket)
        .agg(F.count(F.lit(1)).alias("_count"))
        .select(
            *keys,
            "_bucket",
            F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_start"),
            F.sum("_count").over(per_key).alias("n_rows"),
        )
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order)
    return (
        join_rows(df.withColumn("_bucket", bucket), starts, [*keys, "_bucket"])
        .withColumn("pos", F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_start")
    )


def laid_with(df: DataFrame) -> dict | None:
    """How the blocks of stored bars were cut; None for other rows."""
    return df.schema["block"].metadata.get("laid") if "block" in df.columns else None


def layout(
    df: DataFrame, before: int = 0, after: int = 0, keys=KEYS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Cut each key into blocks, each with ``before`` rows in front and ``after`` behind it.

    Stored blocks (see ``sources.laid``) that have those rows are taken as they are, without an exchange; of others
    the stored positions are.
    """
    stored = laid_with(df)
    if stored is not None:
        if stored["before"] >= before and stored["after"] >= after and stored["block_rows"] == block_rows and stored["keys"] == list(keys):
            return df
        df = core(df, keep=True)
    placed = df if "pos" in df.columns else positions(df, keys)
    first = F.greatest(F.floor((F.col("pos") - after) / block_rows), F.lit(0))
    last = F.floor(F.least(F.col("pos") + before, F.col("n_rows") - 1) / block_rows)
    is_core = F.floor(F.col("pos") / block_rows) == F.col("block")
    ends = ((F.col("pos") + 1) % block_rows == 0) | (F.col("pos") == F.col("n_rows") - 1)
    return (
        placed.withColumn("block", F.explode(F.sequence(first, last)))
        .withColumns(
            {
                "is_core": is_core,
                "is_block_end": is_core & ends,
                "stripe": F.floor(F.col("pos") / STRIPE_ROWS),
            }
        )
        .repartition(*keys, "block")
    )


def one_block(df: DataFrame, keys=KEYS, order: str = "ts") -> DataFrame:
    """The same columns for rows already limited to a few per key: one block each, no neighbours."""
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return df.withColumns(
        {
            "pos": pos.cast("long"),
            "n_rows": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
            "block": F.lit(0).cast("long"),
            "stripe": F.lit(0).cast("long"),
            "is_core": F.lit(True),
            "is_block_end": F.lit(False),
        }
    )


def core(df: DataFrame, keep: bool = False) -> DataFrame:
    """Drop the borrowed rows, and the helper columns unless ``keep``."""
    laid, df = laid_with(df), df.filter("is_core")
    if keep and laid is not None:  # without its neighbours a block is no stored one any more
        df = df.withMetadata("block", {})
    return df if keep else df.drop(*HELPERS)


def across_blocks(df: DataFrame, edges: dict, carried: dict, keys=KEYS) -> DataFrame:
    """Add to every row what the other blocks of its key contribute.

    ``edges`` are read from the last row of each block, where running expressions have seen the
    whole block; ``carried`` are windows over them (ordered by block). Only one row per block
    meets its key's others.
    """
    summary = (
        df.filter("is_block_end")
        .select(*keys, "block", *[e.alias(n) for n, e in edges.items()])
        .select(*keys, "block", *[c.alias(n) for n, c in carried.items()])
    )
    return join_rows(df, summary, [*keys, "block"])


def earlier_blocks(keys=KEYS):
    return Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def all_blocks(keys=KEYS):
    return (
        Window.partitionBy(*keys)
        .orderBy("block")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
