"""Where reliable checkpoints go."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else one in the warehouse folder.

    What the library writes there stays until the owner of the folder removes it.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    folder = folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_kept"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read from there: columnar, pruned, no lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, "rows")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: no lineage, and rows stay partitioned and sorted as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
