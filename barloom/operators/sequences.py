"""Time-ordered splits and training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import block_window
from ..schema import KEYS
from .layout import BLOCK_ROWS, HELPERS, core, layout, positions


def time_split(df: DataFrame, ratio: float = 0.8, keys=KEYS) -> DataFrame:
    """Add ``is_train``: true for the first ``int(ratio * n)`` rows of each key."""
    placed = df if "pos" in df.columns else positions(df, keys)
    train = F.col("pos") < F.floor(F.lit(float(ratio)) * F.col("n_rows"))
    return placed.withColumn("is_train", train).select(*df.columns, "is_train")


def drop_last_row(df: DataFrame, keys=KEYS) -> DataFrame:
    placed = df if "pos" in df.columns else positions(df, keys)
    return placed.filter(F.col("pos") < F.col("n_rows") - 1).select(*df.columns)


def shifted_target(bars: DataFrame, k: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``target``: the close ``k`` rows later."""
    df = layout(bars, after=k, block_rows=block_rows)
    df = df.withColumn("target", F.lead("close", k).over(block_window()))
    return core(df, keep=True).select(*bars.columns, "target")


def sequences(
    df: DataFrame, cols, length: int, mode: str = "labelled", keys=KEYS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``seq``, an array of ``length`` rows of ``cols``.

    ``labelled``: the rows before a row, which itself carries the label. ``sliding``: a row and
    those after it. ``latest``: one row per key with its last rows. Incomplete ones are dropped.
    """
    step = F.array(*cols)
    if mode == "latest":
        # by place in the key, so that the plan is the same for any length and no key is sorted as a whole
        placed = positions(df.select(*keys, "ts", step.alias("step")), keys)
        tail = placed.filter(F.col("pos") >= F.col("n_rows") - length)
        packed = F.sort_array(F.collect_list(F.struct("ts", "step"))).alias("rows")
        out = tail.groupBy(*keys).agg(packed).filter(F.size("rows") == length)
        return out.select(*keys, F.element_at("rows", -1)["ts"].alias("ts"), F.col("rows")["step"].alias("seq"))
    own = [c for c in df.columns if c not in HELPERS]
    if mode == "labelled":
        laid = layout(df, before=length, keys=keys, block_rows=block_rows)
        frame = block_window(keys).rowsBetween(-length, -1)
    elif mode == "sliding":
        laid = layout(df, after=length - 1, keys=keys, block_rows=block_rows)
        frame = block_window(keys).rowsBetween(0, length - 1)
    else:
        raise ValueError(f"unknown mode: {mode}")
    laid = laid.withColumn("seq", F.collect_list(step).over(frame)).filter(F.size("seq") == length)
    return core(laid).select(*own, "seq")

