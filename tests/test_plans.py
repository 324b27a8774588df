from datetime import datetime

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from barloom.operators.daily import next_day_label
from barloom.operators.scaling import fit_scaler
from barloom.plans import features as PF
from barloom.plans import forecast as FC
from barloom.plans import models as MO
from barloom.session import materialize

from .conftest import frame
from .test_indicators import walk


def test_weekends_are_skipped(spark):
    friday = spark.createDataFrame([("a", datetime(2024, 1, 5, 15))], "ticker string, ts timestamp")
    hourly = [r.ts for r in FC.future_times(friday, 10, "1h").orderBy("step").collect()]
    assert hourly[8] == datetime(2024, 1, 8, 0) and hourly[0] == datetime(2024, 1, 5, 16)
    daily = [r.ts for r in FC.future_times(friday, 2, "1d").orderBy("step").collect()]
    assert daily == [datetime(2024, 1, 8, 15), datetime(2024, 1, 9, 15)]
    with pytest.raises(ValueError):
        FC.future_times(friday, 1, "7d")


def test_patience_picks_the_best_round():
    assert MO.best_round([5, 4, 3, 4, 4, 4, 1], 3) == (2, True)
    assert MO.best_round([5, 4, 3, 4, 4, 1], 3) == (5, False)


@pytest.fixture(scope="module")
def fitted(to_bars):
    bars = to_bars(walk("a", 160, 1), walk("b", 160, 2), walk("short", 30, 3))
    features = materialize(PF.feature_rows(bars, block_rows=64))
    params = materialize(fit_scaler(features, PF.RETURN_FEATURES))
    return bars, features, params, PF.scaled_rows(features, params=params)


def test_feature_rows_are_whole(fitted):
    bars, features, _, scaled = fitted
    got = features.toPandas()
    assert len(got) == 350 and got[got.ticker != "short"][list(PF.RETURN_FEATURES)].notna().all().all()
    assert got[got.ticker == "short"].sma_50.isna().all()
    shown = scaled.toPandas()[list(PF.RETURN_FEATURES)].to_numpy(dtype=float)
    assert np.nanmax(np.abs(shown)) <= 10


def test_training_sequences(fitted):
    bars = fitted[0]
    made = PF.training_sequences(bars, 4, block_rows=64).toPandas()
    want = next_day_label(bars).toPandas()
    assert made.groupby("ticker").size()["a"] == 160 - 4 - 1
    merged = made.merge(want, on=["ticker", "ts"])
    np.testing.assert_allclose(merged.next_return_x, merged.next_return_y)
    assert {len(s) for s in made.seq} == {4} and len(made.seq[0][0]) == 23


def test_tree_forecast(fitted, spark):
    bars, _, params, scaled = fitted
    rows = materialize(PF.tree_rows(bars))
    assert {r.ticker for r in rows.select("ticker").distinct().collect()} == {"a", "b"}
    fit = MO.fit_gbt(rows, trees=3, depth=2)
    again = MO.fit_gbt(rows, trees=3, depth=2)
    assert fit.validation_mse == again.validation_mse and 1 <= fit.trees <= 3
    assert MO.feature_importance(fit, PF.RETURN_FEATURES, spark).count() == 23
    state = FC.latest_state(scaled, bars, PF.RETURN_FEATURES, params)
    got = FC.forecast(fit.model, state, 3, "1h").toPandas().set_index(["ticker", "step"])
    assert len(got) == 7
    alone = got.loc[("short", 1)]
    last = bars.filter("ticker = 'short'").agg(F.max_by("close", "ts")).first()[0]
    assert (alone.price, alone.sentiment, alone.confidence) == (last, "Neutral", 0.5)
    # the first step by hand
    start = state.filter("ticker = 'a'").first()
    vector = spark.createDataFrame([(start.seq[-1],)], "v array<double>").select(
        PF.array_to_vector("v").alias("features")
    )
    r = fit.model.transform(vector).first().prediction
    assert got.price["a", 1] == pytest.approx(start.close * np.exp(r))
    assert got.sentiment["a", 1] == ("Bullish" if r > 0 else "Bearish")
    change = FC.final_change(got.reset_index().pipe(spark.createDataFrame), bars).toPandas()
    assert set(change.step) == {1, 3}


def test_dual_forecast(fitted):
    bars, _, params, scaled = fitted
    fit = MO.fit_dual(PF.training_sequences(bars, 2), trees=2, depth=2, max_iter=5)
    assert 1 <= fit.trees <= 2 and fit.validation_mse > 0 and fit.validation_log_loss > 0
    state = FC.latest_state(scaled, bars, PF.RETURN_FEATURES, params, 2)
    got = FC.forecast(fit.model, state, 2, "1h", dual=True).toPandas()
    assert len(got) == 5 and got.confidence.between(0.5, 1).all()
    assert set(got[got.ticker == "short"].sentiment) == {"Neutral"}


def test_the_newest_row_moves_on(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],)], "seq array<array<double>>")
    assert df.select(FC._advance(F.col("seq"), F.lit(9.0)).alias("s")).first().s == [[3.0, 4.0], [9.0, 4.0]]


def test_tree_rows_of_the_close(to_bars):
    rows = PF.tree_rows(to_bars(walk("a", 120, 4)), target="close", k=2)
    got = rows.withColumn("v", vector_to_array("features")).toPandas().sort_values("ts")
    assert len(got) == 120 - 49 - 2 and got.is_train.sum() == int(0.8 * len(got))
    assert got.label.tolist()[:-2] == pytest.approx(got.close.tolist()[2:])


def test_technical_report_and_feeds(to_bars):
    from barloom.operators.levels import levels
    from barloom.plans.feeds import chart_feed, overlay_feed
    from barloom.plans.technical import technical_report

    bars = to_bars(frame("up", np.arange(1.0, 61.0)))
    report = technical_report(bars)
    assert report.trend.first().trend == "Bullish" and report.latest.first().rsi == 100
    zones = overlay_feed(report.bars).filter("series = 'rsi'").select("rsi_zone").distinct().collect()
    assert [z[0] for z in zones] == ["overbought"]
    ahead = FC.future_times(bars.groupBy("ticker").agg(F.max("ts").alias("ts")), 1, "1h")
    feed = chart_feed(bars, ahead.withColumn("price", F.lit(61.0)), levels(bars))
    assert feed.filter("series = 'forecast'").count() == 1 and feed.count() == 241
