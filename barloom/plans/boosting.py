"""Boosted regression trees that go on from where they are.

Each tree is fitted by MLlib on what the trees before it left over, and the sum of the trees so far is a column beside
the rows. Adding a tree therefore costs one tree, the held-out error after each is known at once, and an ensemble
that grew past its best length is cut, not fitted again. The result is MLlib's own model of boosted trees.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark import SparkContext, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.trees import Node, node_of, tree_sql
from ..session import materialize

#: The sums are written down after so many trees, so that a lost executor never costs more than those.
WRITTEN_EVERY = 10


class Grown(NamedTuple):
    """Trees in order, the same ones as nodes, how much each counts, and the mean squared held-out error after each."""

    trees: tuple[DecisionTreeRegressionModel, ...] = ()
    nodes: tuple[Node, ...] = ()
    weights: tuple[float, ...] = ()
    errors: tuple[float, ...] = ()


def best_round(errors, patience: int) -> tuple[int, bool]:
    """The best round when training stops after ``patience`` rounds without a better one.

    Also tells whether it did stop, or ran out of rounds.
    """
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            return best, True
    return best, False


def _added(rows: DataFrame, node: Node, weight: float) -> DataFrame:
    """``so_far`` moved by one tree."""
    return rows.withColumn("so_far", F.col("so_far") + F.lit(weight) * F.expr(tree_sql(node, "x[{}]")))


def grow(rows: DataFrame, trees: int, depth: int, rate: float, seed: int, patience: int, start: Grown | None = None) -> Grown:
    """Trees added to ``start`` until ``patience`` rounds bring nothing or there are ``trees`` of them.

    ``rows`` has ``features``, ``label`` and ``is_train``; rows that are not trained on give the error. The first tree
    counts in full and fits the label; every other one counts ``rate`` and fits twice the rest, the slope of the squared error.
    """
    grown = start or Grown()
    now = rows.select("features", "label", "is_train", vector_to_array("features").alias("x"), F.lit(0.0).alias("so_far"))
    for node, weight in zip(grown.nodes, grown.weights, strict=True):
        now = _added(now, node, weight)
    now, held = materialize(now), []
    while len(grown.trees) < trees and not best_round(grown.errors, patience)[1]:
        many = len(grown.trees)
        target = 2.0 * (F.col("label") - F.col("so_far")) if many else F.col("label")
        fitter = DecisionTreeRegressor(labelCol="target", maxDepth=depth, seed=seed + many)
        tree = fitter.fit(now.where("is_train").select("features", target.alias("target")))
        node, weight = node_of(tree), rate if many else 1.0
        now = _added(now, node, weight)
        if (many + 1) % WRITTEN_EVERY == 0:
            now = materialize(now)
        else:
            now = now.persist(StorageLevel.MEMORY_AND_DISK)
        error = now.where("not is_train").agg(F.avg((F.col("label") - F.col("so_far")) ** 2)).first()[0]
        for x in held:
            x.unpersist()
        held = [now]
        grown = Grown((*grown.trees, tree), (*grown.nodes, node), (*grown.weights, weight), (*grown.errors, float("inf") if error is None else error))
    for x in held:
        x.unpersist()
    return grown


def cut(grown: Grown, length: int) -> Grown:
    return Grown(grown.trees[:length], grown.nodes[:length], grown.weights[:length], grown.errors[:length])


def model_of(grown: Grown, features: int) -> GBTRegressionModel:
    """MLlib's model of these trees over so many features."""
    gateway = SparkContext._gateway
    made = gateway.jvm.org.apache.spark.ml.regression
    trees = gateway.new_array(made.DecisionTreeRegressionModel, len(grown.trees))
    weights = gateway.new_array(gateway.jvm.double, len(grown.trees))
    for i, (tree, weight) in enumerate(zip(grown.trees, grown.weights, strict=True)):
        trees[i], weights[i] = tree._java_obj, float(weight)
    return GBTRegressionModel(made.GBTRegressionModel(f"gbtr_{grown.trees[0].uid}", trees, weights, features))
