"""Fit scaling parameters per ticker, apply them, undo them.

Parameters are a long table ``norm_params(ticker, feature, f_min, f_max)``; for the z-score kind
the two values are ``mean`` and ``std``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..schema import KEYS
from .layout import join_rows
from .quantile import quantiles

# The scaler's constants.
EPS = 1e-8
NO_RANGE = 1e-8
ZERO_HALF_WIDTH = 0.001
CLIP = 10.0
LOW_PROB, HIGH_PROB = 0.01, 0.99

PARAMS = {"zscore": ("mean", "std"), "minmax": ("f_min", "f_max"), "robust": ("f_min", "f_max")}


def _pairs(df: DataFrame, cols, low, high, names, keys) -> DataFrame:
    """Aggregate two values per column and turn the columns into rows."""
    wide = df.groupBy(*keys).agg(
        *[F.struct(low(c).alias(names[0]), high(c).alias(names[1])).alias(c) for c in cols]
    )
    return wide.unpivot(list(keys), list(cols), "feature", "v").select(*keys, "feature", "v.*")


def fit_scaler(
    df: DataFrame, cols, kind: str = "robust", fit_on: str = "all", keys=KEYS
) -> DataFrame:
    """Parameters per key and feature. ``fit_on="train"`` uses only rows with ``is_train``."""
    if kind not in PARAMS:
        raise ValueError(f"unknown scaler: {kind}")
    if fit_on not in ("all", "train"):
        raise ValueError(f"unknown fit_on: {fit_on}")
    if fit_on == "train":
        df = df.filter("is_train")
    if kind == "zscore":
        return _pairs(df, cols, F.avg, F.stddev_pop, PARAMS[kind], keys)
    if kind == "minmax":
        return _pairs(df, cols, F.min, F.max, PARAMS[kind], keys)
    ends = (
        quantiles(df, cols, (LOW_PROB, HIGH_PROB), keys, also={"abs_max": lambda c: F.max(F.abs(c))})
        .groupBy(*keys, "feature")
        .agg(
            F.max(F.when(F.col("prob") == LOW_PROB, F.col("value"))).alias("f_min"),
            F.max(F.when(F.col("prob") == HIGH_PROB, F.col("value"))).alias("f_max"),
            F.max("abs_max").alias("abs_max"),
        )
    )
    return widen_flat(ends).drop("abs_max")


def widen_flat(params: DataFrame) -> DataFrame:
    """Give a feature without range the range of its size, or a token one around 0."""
    flat = (F.col("f_max") - F.col("f_min")) < NO_RANGE
    half = F.when(F.col("abs_max") < NO_RANGE, F.lit(ZERO_HALF_WIDTH)).otherwise(F.col("abs_max"))
    return params.withColumns(
        {
            "f_min": F.when(flat, -half).otherwise(F.col("f_min")),
            "f_max": F.when(flat, half).otherwise(F.col("f_max")),
        }
    )


def beside(df: DataFrame, params: DataFrame, cols, kind: str, keys=KEYS) -> DataFrame:
    """Add ``<col>__a`` and ``<col>__b``, the two parameters of every column; NULL for a key without parameters."""
    a, b = PARAMS[kind]
    wide = params.groupBy(*keys).agg(
        *[F.max(F.when(F.col("feature") == c, F.col(a))).alias(f"{c}__a") for c in cols],
        *[F.max(F.when(F.col("feature") == c, F.col(b))).alias(f"{c}__b") for c in cols],
    )
    return join_rows(df, wide, list(keys))


def _apply(df, params, cols, kind, keys, formula) -> DataFrame:
    own = df.columns
    joined = beside(df, params, cols, kind, keys)
    new = {c: formula(F.col(c), F.col(f"{c}__a"), F.col(f"{c}__b")) for c in cols}
    return joined.withColumns(new).select(*own)


def scaled(x, a, b, kind: str):
    if kind == "zscore":
        return (x - a) / (b + F.lit(EPS))
    ratio = (x - a) / (b - a + F.lit(EPS))
    return S.clip(ratio, -CLIP, CLIP) if kind == "robust" else ratio


def unscaled(y, a, b, kind: str, with_eps: bool = False):
    if kind == "zscore":
        return y * b + a
    return y * (b - a + F.lit(EPS if with_eps else 0.0)) + a


def scale(df: DataFrame, params: DataFrame, cols, kind: str = "robust", keys=KEYS) -> DataFrame:
    return _apply(df, params, cols, kind, keys, lambda x, a, b: scaled(x, a, b, kind))


def unscale(
    df: DataFrame, params: DataFrame, cols, kind: str = "minmax", with_eps: bool = False, keys=KEYS
) -> DataFrame:
    return _apply(df, params, cols, kind, keys, lambda y, a, b: unscaled(y, a, b, kind, with_eps))
