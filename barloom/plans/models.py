"""Fitting MLlib models on the prepared rows, pooled over all tickers."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import finite
from ..operators.sequences import time_split
from ..session import materialize
from .boosting import best_round, cut, grow, model_of
from .lengths import masked_vectors

# The boosted-tree settings.
TREES, DEPTH, RATE, SEED = 100, 5, 0.1, 42
PATIENCE_PIPELINE, PATIENCE_HELPER = 5, 10


class Fitted(NamedTuple):
    model: PipelineModel
    trees: int
    validation_mse: float


def fit_gbt(
    rows: DataFrame,
    patience: int = PATIENCE_PIPELINE,
    label: str = "label",
    trees: int = TREES,
    depth: int = DEPTH,
) -> Fitted:
    """Boosted trees on the rows with ``is_train``; the others choose how many trees to keep.

    Trees are added one by one while the held-out error still improves, and those after the best round are cut off.
    Without held-out rows the errors tell nothing, and the first tree is kept. Rows with an infinite label take no part.
    """
    used = rows.select("features", F.col(label).alias("label"), "is_train").filter(finite("label").isNotNull())
    grown = grow(used, trees, depth, RATE, SEED, patience)
    best = best_round(grown.errors, patience)[0]
    width = grown.trees[0].numFeatures
    return Fitted(PipelineModel([model_of(cut(grown, best + 1), width)]), best + 1, grown.errors[best])


def feature_importance(fitted: Fitted, names, spark: SparkSession) -> DataFrame:
    """(feature, score), one row per feature."""
    scores = fitted.model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, scores, strict=True)), "feature string, score double")


def predict_rows(fitted: Fitted, rows: DataFrame) -> DataFrame:
    return fitted.model.transform(rows)


def flat_vectors(sequences: DataFrame) -> DataFrame:
    """Add ``features``: the sequence as one vector."""
    return sequences.withColumn("features", array_to_vector(F.flatten("seq")))


class FittedDual(NamedTuple):
    model: PipelineModel
    trees: int
    validation_mse: float
    validation_log_loss: float


def fit_dual(
    sequences: DataFrame, trees: int = TREES, depth: int = DEPTH, max_iter: int = 100, patience: int = PATIENCE_HELPER
) -> FittedDual:
    """Return (``predicted_return``) and sentiment probabilities (``probability``) from sequences, padded ones with their mask.

    The last fifth of each ticker's sequences is held out; it chooses how many trees to keep and gives both errors.
    """
    flat = masked_vectors(sequences) if "mask" in sequences.columns else flat_vectors(sequences)
    used = materialize(time_split(flat.select("ticker", "ts", "features", "next_return", "sentiment")))
    fitted = fit_gbt(used, patience, "next_return", trees, depth)
    returns = fitted.model.stages[0].setPredictionCol("predicted_return")
    sentiment = LogisticRegression(
        featuresCol="features", labelCol="sentiment", predictionCol="predicted_sentiment", maxIter=max_iter
    ).fit(used.filter("is_train"))
    p = F.element_at(vector_to_array("probability"), F.col("sentiment") + 1)
    held_out = sentiment.transform(used.filter("not is_train"))
    log_loss = held_out.agg(F.avg(-F.ln(F.greatest(p, F.lit(1e-15))))).first()[0]
    return FittedDual(PipelineModel([returns, sentiment]), fitted.trees, fitted.validation_mse, log_loss)
