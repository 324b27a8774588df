"""Fitted models as expressions, and a forecast that folds them over its steps.

A predictor is SQL text over ``x``, the array of features of one row. Folding it over the steps of a forecast needs one
pass over one row per ticker, however many steps there are; fitting stays with MLlib.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.trees import ensemble, ensemble_sql, logistic, logistic_sql
from ..operators.scaling import CLIP, EPS
from ..schema import KEYS


class Predictor(NamedTuple):
    """The next return and, of a model of two tasks, the probability that it is not positive."""

    returns: str
    bearish: str | None = None


def compiled(model: PipelineModel) -> Predictor | None:
    """The predictor of a pipeline of boosted trees and, where there is one, a logistic model; None for other stages."""
    returns = bearish = None
    for stage in model.stages:
        if isinstance(stage, GBTRegressionModel):
            returns = ensemble_sql(ensemble(stage), "x[{}]")
        elif isinstance(stage, LogisticRegressionModel) and stage.numClasses == 2:
            bearish = logistic_sql(logistic(stage), "x[{}]")
        else:
            return None
    return None if returns is None else Predictor(returns, bearish)


def predicted(features: str, predictor: Predictor) -> Column:
    """The predicted return of the rows' own array column ``features``."""
    return F.expr(_let("x", features, predictor.returns))


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def folded(latest: DataFrame, predictor: Predictor, steps: int) -> DataFrame:
    """(ticker, step, price, sentiment, confidence) of ``steps`` steps from the rows with a sequence.

    A step predicts a return, moves the price by it and puts the scaled return into a new last row, a copy of the one
    before; the oldest row leaves. A predictor of two tasks sees the whole sequence row after row, then ``mask`` where the
    rows have one; any other sees the last row. Padding rows (``pad`` of them, in front) stay where they are.
    """
    dual, own = predictor.bearish is not None, latest.columns
    seen = "element_at(s.seq, -1)" if not dual else "concat(flatten(s.seq), mask)" if "mask" in own else "flatten(s.seq)"
    pad = "pad" if "pad" in own else "0"
    sentiment = "if(p <= 0.5D, 'Bullish', 'Bearish')" if dual else "if(r > 0, 'Bullish', 'Bearish')"
    confidence = "greatest(p, 1 - p)" if dual else "least(abs(r), 1D)"
    scaled = f"greatest(least((r - f_min) / (f_max - f_min + {EPS!r}D), {CLIP!r}D), -{CLIP!r}D)"
    newest = f"concat(array({scaled}), slice(element_at(s.seq, -1), 2, size(element_at(s.seq, -1)) - 1))"
    seq = f"concat(slice(s.seq, 1, {pad}), slice(s.seq, {pad} + 2, size(s.seq)), array({newest}))"
    row = f"named_struct('step', k, 'price', q, 'sentiment', {sentiment}, 'confidence', {confidence})"
    then = _let("q", "s.price * exp(r)", f"named_struct('price', q, 'seq', {seq}, 'out', concat(s.out, array({row})))")
    if dual:
        then = _let("p", predictor.bearish, then)
    step = _let("x", seen, _let("r", predictor.returns, then))
    none = "slice(array(named_struct('step', 0, 'price', 0D, 'sentiment', '', 'confidence', 0D)), 1, 0)"
    fold = f"aggregate(sequence(1, {steps}), named_struct('price', close, 'seq', seq, 'out', {none}), (s, k) -> {step}, s -> s.out)"
    ready = latest.where("seq is not null")
    return ready.select(*KEYS, F.explode(F.expr(fold)).alias("o")).select(*KEYS, "o.*")
