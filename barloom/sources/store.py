"""Saving and loading fitted models and scaling parameters."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

MANIFEST = "number long, version string"


def model_name(model_type: str, interval: str, days: int) -> str:
    return f"model_{model_type}_{interval}_{days}d"


def save_model(model: PipelineModel, folder: str, model_type: str, interval: str, days: int) -> str:
    path = f"{folder.rstrip('/')}/{model_name(model_type, interval, days)}"
    model.write().overwrite().save(path)
    return path


def load_model(folder: str, model_type: str, interval: str, days: int) -> PipelineModel:
    return PipelineModel.load(f"{folder.rstrip('/')}/{model_name(model_type, interval, days)}")


def save_params(params: DataFrame, path: str) -> None:
    params.write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_fit(model: PipelineModel, params: DataFrame, folder: str, model_type: str, interval: str, days: int) -> str:
    """A model and the scaling parameters of the rows it was fitted on, published together.

    Both go to a folder of their own; then one row is added to the manifest, and only that makes them the newest pair. A
    job that dies before leaves the pair of before in force.
    """
    spark, base = params.sparkSession, f"{folder.rstrip('/')}/{model_name(model_type, interval, days)}"
    version = uuid.uuid4().hex
    model.write().save(f"{base}/{version}/model")
    save_params(params, f"{base}/{version}/params")
    last = _newest(spark, base)
    row = spark.createDataFrame([(last.number + 1 if last else 1, version)], MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{base}/manifest")
    return f"{base}/{version}"


def _newest(spark: SparkSession, base: str) -> Row | None:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{base}/manifest").orderBy(F.desc("number"), "version").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load_fit(spark: SparkSession, folder: str, model_type: str, interval: str, days: int) -> tuple[PipelineModel, DataFrame]:
    """The newest published pair."""
    base = f"{folder.rstrip('/')}/{model_name(model_type, interval, days)}"
    newest = _newest(spark, base)
    if newest is None:
        raise FileNotFoundError(f"no model has been published in {base}")
    path = f"{base}/{newest.version}"
    return PipelineModel.load(f"{path}/model"), load_params(spark, f"{path}/params")
