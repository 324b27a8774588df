"""Filling gaps along a ticker's time line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import running
from ..schema import KEYS
from .layout import BLOCK_ROWS, HELPERS, across_blocks, all_blocks, core, earlier_blocks, layout


def fill_laid_out(df: DataFrame, cols, keys=KEYS) -> DataFrame:
    """``fill`` for core rows of a laid-out frame; keeps the layout."""
    own = df.columns
    seen = running(keys)
    df = df.withColumns(
        {f"_down_{c}": F.last(c, ignorenulls=True).over(seen) for c in cols}
        | {f"_head_{c}": F.first(c, ignorenulls=True).over(seen) for c in cols}
    )
    edges = {f"_last_{c}": F.col(f"_down_{c}") for c in cols}
    edges |= {f"_first_{c}": F.col(f"_head_{c}") for c in cols}
    carried = {f"_prev_{c}": F.last(f"_last_{c}", ignorenulls=True).over(earlier_blocks(keys)) for c in cols}
    # a gap with nothing before it starts the key, so it takes the key's first value
    carried |= {f"_start_{c}": F.first(f"_first_{c}", ignorenulls=True).over(all_blocks(keys)) for c in cols}
    df = across_blocks(df, edges, carried, keys)
    filled = {c: F.coalesce(f"_down_{c}", f"_prev_{c}", f"_start_{c}") for c in cols}
    return df.withColumns(filled).select(*own)


def fill(df: DataFrame, cols, keys=KEYS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Forward-fill, then back-fill what is left at the start."""
    own = [c for c in df.columns if c not in HELPERS]
    laid = core(layout(df, keys=keys, block_rows=block_rows), keep=True)
    return fill_laid_out(laid, cols, keys).select(*own)


def fill_constant(df: DataFrame, value: float, cols) -> DataFrame:
    return df.na.fill(value, subset=list(cols))


def null_report(df: DataFrame, cols, keys=KEYS) -> DataFrame:
    """(key, feature, n_null) for the features that have NULLs."""
    counts = df.groupBy(*keys).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.unpivot(list(keys), list(cols), "feature", "n_null").filter("n_null > 0")
