"""Boosting that goes on, models as expressions, and the forecast that folds them."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from barloom.functions.trees import any_double, ensemble, ensemble_sql
from barloom.plans import forecast as FC
from barloom.plans.boosting import best_round, cut, grow, model_of
from barloom.plans.models import fit_gbt
from barloom.plans.predictors import Predictor, compiled, folded, predicted
from barloom.session import materialize


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4))
    y = np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] * (x[:, 2] > 0) + rng.normal(0, 0.05, 400)
    made = spark.createDataFrame([(a.tolist(), float(b), i % 5 > 0) for i, (a, b) in enumerate(zip(x, y))], "v array<double>, label double, is_train boolean")
    return materialize(made.withColumn("features", array_to_vector("v")))


def predictions(model, rows, column="prediction"):
    return np.array([r[0] for r in model.transform(rows).orderBy("label").select(column).collect()])


def test_a_cut_ensemble_is_the_fit_of_that_length(rows):
    grown = grow(rows, 6, 3, 0.1, 42, 99)
    short = grow(rows, 3, 3, 0.1, 42, 99)
    assert cut(grown, 3).errors == pytest.approx(short.errors)
    np.testing.assert_allclose(predictions(model_of(cut(grown, 3), 4), rows), predictions(model_of(short, 4), rows), rtol=1e-9)
    further = grow(rows, 6, 3, 0.1, 42, 99, start=short)
    assert further.errors == pytest.approx(grown.errors)  # sums of doubles in another order
    np.testing.assert_allclose(predictions(model_of(further, 4), rows), predictions(model_of(grown, 4), rows), rtol=1e-9)


def test_the_trees_are_those_of_a_fit_in_one_go(rows):
    grown = grow(rows, 5, 3, 0.1, 42, 99)
    own = GBTRegressor(maxIter=5, maxDepth=3, stepSize=0.1, seed=42).fit(rows.where("is_train"))
    ours = model_of(grown, 4)
    np.testing.assert_allclose(predictions(ours, rows), predictions(own, rows), rtol=1e-9)
    np.testing.assert_allclose(ours.featureImportances.toArray(), own.featureImportances.toArray(), rtol=1e-6)
    assert grown.errors == pytest.approx(own.evaluateEachIteration(rows.where("not is_train"), "squared"))


def test_every_tree_is_grown_once_and_the_rest_cut(rows, monkeypatch):
    from pyspark.ml.regression import DecisionTreeRegressor

    fits, fit = [], DecisionTreeRegressor.fit
    monkeypatch.setattr(DecisionTreeRegressor, "fit", lambda self, df: fits.append(1) or fit(self, df))
    noise = rows.withColumn("label", F.when(F.col("is_train"), F.col("label")).otherwise(-F.col("label")))
    found = fit_gbt(noise, patience=2, trees=50, depth=2)
    assert found.trees + 2 == len(fits) < 50
    assert len(found.model.stages[0].trees) == found.trees
    errors = grow(noise, found.trees + 2, 2, 0.1, 42, 99).errors
    assert best_round(errors, 2) == (found.trees - 1, True) and errors[found.trees - 1] == pytest.approx(found.validation_mse)


def test_expressions_agree_with_the_models(rows, spark):
    model = model_of(grow(rows, 4, 3, 0.1, 42, 99), 4)
    up = LogisticRegression(labelCol="up", maxIter=5).fit(rows.withColumn("up", (F.col("label") > 0).cast("int")))
    both = compiled(PipelineModel([model, up]))
    got = rows.orderBy("label").select(predicted("v", both).alias("r"), predicted("v", Predictor(both.bearish)).alias("p")).collect()
    np.testing.assert_allclose([r.r for r in got], predictions(model, rows), rtol=1e-12)
    np.testing.assert_allclose([r.p for r in got], [p[1] for p in predictions(up, rows.withColumn("label", F.col("label")), "probability")], rtol=1e-9)
    assert compiled(PipelineModel([up])) is None


def test_the_same_text_in_another_engine(rows):
    import duckdb

    grown = grow(rows, 3, 3, 0.1, 42, 99)
    assert ensemble(model_of(grown, 4)).trees == grown.nodes
    frame = rows.select("label", *[F.col("v")[i].alias(f"c{i}") for i in range(4)]).orderBy("label").toPandas()  # noqa: F841
    text = ensemble_sql(ensemble(model_of(grown, 4)), "c{}", any_double)
    want = duckdb.sql(f"SELECT {text} AS p FROM frame ORDER BY label").df().p
    np.testing.assert_allclose(want, predictions(model_of(grown, 4), rows), rtol=1e-12)


def states(spark, length, width=4, tickers=3):
    rng = np.random.default_rng(1)
    rows = [(f"t{i}", 100.0 + i, rng.normal(size=(length, width)).tolist(), -0.5, 0.75) for i in range(tickers)]
    return spark.createDataFrame([*rows, ("short", 7.0, None, None, None)], "ticker string, close double, seq array<array<double>>, f_min double, f_max double").withColumn(
        "ts", F.timestamp_seconds(F.lit(1704448800))
    )


def same(a, b):
    a, b = ([r.asDict() for r in x.orderBy("ticker", "step").collect()] for x in (a, b))
    assert [(r["ticker"], r["step"], r["sentiment"]) for r in a] == [(r["ticker"], r["step"], r["sentiment"]) for r in b]
    np.testing.assert_allclose([(r["price"], r["confidence"]) for r in a], [(r["price"], r["confidence"]) for r in b], rtol=1e-9)


def test_the_fold_agrees_with_one_transform_a_step(rows, spark):
    state = states(spark, 1)
    model = PipelineModel([model_of(grow(rows, 4, 3, 0.1, 42, 99), 4)])
    same(folded(state, compiled(model), 5), FC.forecast_by_steps(model, state, 5))


def test_the_fold_of_two_tasks(rows, spark):
    state = states(spark, 2, 2)
    flat = rows.withColumn("next_return", F.col("label") / 10).withColumn("up", (F.col("label") > 0).cast("int"))
    trees = model_of(grow(flat.withColumn("label", F.col("next_return")), 4, 3, 0.1, 42, 99), 4).setPredictionCol("predicted_return")
    up = LogisticRegression(labelCol="up", maxIter=5, predictionCol="other").fit(flat)
    model = PipelineModel([trees, up])
    same(folded(state, compiled(model), 4), FC.forecast_by_steps(model, state, 4, dual=True))


def test_many_steps_are_one_pass(spark):
    state = states(spark, 1)
    tracker, group = spark.sparkContext.statusTracker(), "one-forecast"
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = folded(state, Predictor("0.001 * x[0] - 0.0005 * x[3]"), 500).collect()
    finally:
        jobs = tracker.getJobIdsForGroup(group)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 1500 and len(jobs) == 1


def test_padding_stays_and_the_mask_is_seen(spark):
    rows = [("a", 10.0, [[0.0], [0.0], [1.0], [2.0]], 2, [0.0, 0.0, 1.0, 1.0], 0.0, 1.0)]
    state = spark.createDataFrame(rows, "ticker string, close double, seq array<array<double>>, pad int, mask array<double>, f_min double, f_max double")
    # the third value and the mask of the fourth: 1 + 1, then 2 + 1, then what the first step put in
    got = folded(state, Predictor("0.1 * (x[2] + x[7] + 100 * x[0] + 100 * x[1])", "0.25D"), 3).orderBy("step").collect()
    first = 0.2 / (1 + 1e-8)
    assert [r.price for r in got] == pytest.approx([10 * np.exp(0.2), 10 * np.exp(0.5), 10 * np.exp(0.5 + 0.1 * (first + 1))])
    assert {(r.sentiment, r.confidence) for r in got} == {("Bullish", 0.75)}
