"""How good a forecast was."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import previous
from ..schema import KEYS
from .layout import BLOCK_ROWS, core, layout

_TINY = 1e-15


def metrics(
    df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", keys=KEYS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """mse, rmse, mae and directional accuracy per key.

    The last is the share of steps where both series rise or both do not; NULL with one row.
    """
    laid = layout(df.select(*keys, "ts", y_true, y_pred), before=1, keys=keys, block_rows=block_rows)
    rose = {
        "_true_up": F.col(y_true) > previous(y_true, keys=keys),
        "_pred_up": F.col(y_pred) > previous(y_pred, keys=keys),
    }
    error = F.col(y_true) - F.col(y_pred)
    return (
        core(laid.withColumns(rose))
        .groupBy(*keys)
        .agg(
            F.avg(error * error).alias("mse"),
            F.sqrt(F.avg(error * error)).alias("rmse"),
            F.avg(F.abs(error)).alias("mae"),
            F.avg((F.col("_true_up") == F.col("_pred_up")).cast("double")).alias("directional_accuracy"),
        )
    )


def combined_loss(
    df: DataFrame, y_true: str, y_pred: str, label: str, p_bearish: str, keys=KEYS
) -> DataFrame:
    """Squared error plus log loss of the true class (label 1 = bearish), averaged per key."""
    p = F.when(F.col(label) == 1, F.col(p_bearish)).otherwise(1.0 - F.col(p_bearish))
    error = F.col(y_true) - F.col(y_pred)
    return (
        df.groupBy(*keys)
        .agg(
            F.avg(error * error).alias("mse"),
            F.avg(-F.ln(F.greatest(p, F.lit(_TINY)))).alias("log_loss"),
        )
        .withColumn("loss", F.col("mse") + F.col("log_loss"))
    )


def confidence(df: DataFrame, current: str, predicted: str, mse: str | None = None) -> DataFrame:
    """Add ``direction`` and ``score``.

    The score is the predicted move in units of the model's rmse (0 when that is 0), or in percent
    when no mse is known; beyond +-0.5 it counts as Bullish or Bearish, between as Uncertain.
    """
    move = F.col(predicted) - F.col(current)
    percent = 100.0 * F.try_divide(move, F.col(current))
    if mse is None:
        score = percent
    else:
        in_rmse = F.coalesce(F.try_divide(move, F.sqrt(F.col(mse))), F.lit(0.0))
        score = F.when(F.col(mse).isNull(), percent).otherwise(in_rmse)
    direction = (
        F.when(F.col("_score") > 0.5, F.lit("Bullish"))
        .when(F.col("_score") < -0.5, F.lit("Bearish"))
        .otherwise(F.lit("Uncertain"))
    )
    return (
        df.withColumn("_score", score)
        .withColumns({"direction": direction, "score": F.abs("_score")})
        .drop("_score")
    )
