"""Fitted MLlib models as column expressions.

A fitted tree is a nest of conditions on an array of features; an ensemble is their weighted sum, a logistic model the
logistic function of a weighted sum. Such an expression takes any array column, also one that exists only inside a lambda, so a
forecast can fold over its steps without a job for each; and the same text runs in another SQL engine.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel


class Node(NamedTuple):
    """A leaf has no feature; other nodes go left where the feature is at most the threshold."""

    prediction: float
    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None


class Ensemble(NamedTuple):
    trees: tuple[Node, ...]
    weights: tuple[float, ...]


class Logistic(NamedTuple):
    coefficients: tuple[float, ...]
    intercept: float


def _node(java) -> Node:
    if java.subtreeDepth() == 0:
        return Node(java.prediction())
    split = java.split()
    return Node(java.prediction(), split.featureIndex(), split.threshold(), _node(java.leftChild()), _node(java.rightChild()))


def node_of(tree: DecisionTreeRegressionModel) -> Node:
    """A fitted tree; the number of nodes is set by its parameters, not by the data."""
    return _node(tree._call_java("rootNode"))


def ensemble(model: GBTRegressionModel) -> Ensemble:
    return Ensemble(tuple(map(node_of, model.trees)), tuple(model.treeWeights))


def logistic(model: LogisticRegressionModel) -> Logistic:
    return Logistic(tuple(model.coefficients.toArray().tolist()), float(model.intercept))


def spark_double(x: float) -> str:
    return f"{x!r}D"


def any_double(x: float) -> str:
    """A double that other engines read back as the same one."""
    return f"CAST('{x!r}' AS DOUBLE)"


def tree_sql(node: Node, at: str, number: Callable[[float], str] = spark_double) -> str:
    """``at`` names a feature by its place, for example ``x[{}]``."""
    if node.feature < 0:
        return number(node.prediction)
    test = f"{at.format(node.feature)} <= {number(node.threshold)}"
    return f"CASE WHEN {test} THEN {tree_sql(node.left, at, number)} ELSE {tree_sql(node.right, at, number)} END"


def ensemble_sql(of: Ensemble, at: str, number: Callable[[float], str] = spark_double) -> str:
    return " + ".join(f"{number(w)} * ({tree_sql(t, at, number)})" for t, w in zip(of.trees, of.weights, strict=True)) or number(0.0)


def logistic_sql(of: Logistic, at: str, number: Callable[[float], str] = spark_double) -> str:
    """The probability of the second class."""
    margin = " + ".join([number(of.intercept), *(f"{number(c)} * {at.format(i)}" for i, c in enumerate(of.coefficients) if c)])
    return f"1 / (1 + exp(-({margin})))"
