"""Multi-step forecasts for every ticker at once."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators.latest import last_row
from ..operators.scaling import scaled
from ..operators.sequences import sequences
from ..schema import KEYS
from ..session import checkpointed
from ..sources.periods import interval_seconds
from .lengths import latest_padded
from .predictors import Predictor, compiled, folded

_DAY = 86_400
FORECAST = ("ticker", "step", "ts", "price", "sentiment", "confidence")


def next_time(ts: Column, seconds: int) -> Column:
    """One interval later, and on by whole intervals while that is a Saturday or Sunday."""
    if seconds > 5 * _DAY:
        raise ValueError("an interval longer than a trading week may never leave the weekend")
    after = F.timestamp_seconds(F.unix_micros(ts) / 1e6 + seconds)
    monday = F.timestamp_add("DAY", 7 - F.weekday(after), F.date_trunc("day", after))
    missing = F.ceil((F.unix_micros(monday) - F.unix_micros(after)) / (seconds * 1e6))
    moved = F.timestamp_micros(F.unix_micros(after) + missing * F.lit(seconds * 1_000_000))
    return F.when(S.is_weekday(after), after).otherwise(moved)


def future_times(latest: DataFrame, steps: int, interval: str) -> DataFrame:
    """(ticker, step, ts): the next ``steps`` bar times after each ticker's last bar."""
    seconds = interval_seconds(interval)
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.array(F.col("ts")),
        lambda times, _: F.concat(times, F.array(next_time(F.element_at(times, -1), seconds))),
    )
    ahead = F.slice(grown, 2, steps)
    return latest.select(*KEYS, F.posexplode(ahead).alias("step", "ts")).withColumn("step", F.col("step") + 1)


def return_sentiment(r: Column) -> tuple[Column, Column]:
    """Sentiment and confidence from a predicted return."""
    return F.when(r > 0, F.lit("Bullish")).otherwise(F.lit("Bearish")), F.least(F.abs(r), F.lit(1.0))


def class_sentiment(p_bullish: Column, p_bearish: Column) -> tuple[Column, Column]:
    """Sentiment and confidence from the two class probabilities; a tie is bullish."""
    label = F.when(p_bullish >= p_bearish, F.lit("Bullish")).otherwise(F.lit("Bearish"))
    return label, F.greatest(p_bullish, p_bearish)


def latest_state(
    scaled_features: DataFrame, closes: DataFrame, cols, params: DataFrame, length: int = 1, lengths: DataFrame | None = None
) -> DataFrame:
    """Where a forecast starts: per ticker the last scaled rows, close, time and first-column range.

    A ticker too short for some feature has no rows to start from. With ``lengths`` every ticker has its own number of
    rows, padded to ``length``.
    """
    ends = params.filter(F.col("feature") == cols[0]).select(*KEYS, "f_min", "f_max")
    newest = last_row(closes, ("close", "ts"))
    if lengths is None:
        seqs = sequences(scaled_features, cols, length, "latest").drop("ts")
    else:
        seqs = latest_padded(scaled_features, cols, lengths, length)
    seqs = seqs.filter(~F.exists(F.flatten("seq"), lambda x: x.isNull()))
    return newest.join(seqs, list(KEYS), "left").join(ends, list(KEYS), "left")


def _advance(seq: Column, value: Column) -> Column:
    """Drop the oldest row; the new row is the newest one with its first column replaced."""
    newest = F.element_at(seq, -1)
    row = F.concat(F.array(value), F.slice(newest, 2, F.size(newest) - 1))
    return F.concat(F.slice(seq, 2, F.size(seq) - 1), F.array(row))


def forecast(
    model: PipelineModel | Predictor, latest: DataFrame, steps: int, interval: str, dual: bool = False
) -> DataFrame:
    """(ticker, step, ts, price, sentiment, confidence).

    Each step predicts a return from the last rows, moves the price by it and feeds the scaled
    return back. A ticker without a full sequence gets one neutral row at its last close. Trees, logistic models and
    formulas are folded over the steps in one pass; any other model needs a job for each step.
    """
    times = future_times(latest, steps, interval)
    predictor = model if isinstance(model, Predictor) else compiled(model)
    done = forecast_by_steps(model, latest, steps, dual) if predictor is None else folded(latest, predictor, steps)
    return with_fallback(times.join(done, [*KEYS, "step"], "left"), latest).select(*FORECAST)


def forecast_by_steps(model: PipelineModel, latest: DataFrame, steps: int, dual: bool = False) -> DataFrame:
    """What ``folded`` gives, by any model's ``transform``; the state is kept between steps so that the plan does not grow."""
    state = checkpointed(latest.filter("seq is not null").withColumn("price", F.col("close")))
    done = None
    for step in range(1, steps + 1):
        shown = F.flatten("seq") if dual else F.element_at("seq", -1)
        scored = model.transform(state.withColumn("features", array_to_vector(shown)))
        if dual:
            p = vector_to_array("probability")
            sentiment, confidence = class_sentiment(p[0], p[1])
            predicted = F.col("predicted_return")
        else:
            predicted = F.col("prediction")
            sentiment, confidence = return_sentiment(predicted)
        moved = checkpointed(
            scored.withColumns({"step": F.lit(step), "sentiment": sentiment, "confidence": confidence})
            .withColumns(
                {
                    "price": F.col("price") * F.exp(predicted),
                    "seq": _advance(
                        F.col("seq"), scaled(predicted, F.col("f_min"), F.col("f_max"), "robust")
                    ),
                }
            )
            .select(*state.columns, "step", "sentiment", "confidence")
        )
        result = moved.select(*KEYS, "step", "price", "sentiment", "confidence")
        done = result if done is None else done.unionByName(result)
        state = moved.select(*state.columns)
    return done


def with_fallback(rows: DataFrame, latest: DataFrame) -> DataFrame:
    """First step of a ticker without any forecast: last close, Neutral, 0.5; other gaps drop."""
    last = latest.select(*KEYS, F.col("close").alias("_last"))
    return (
        rows.join(last, list(KEYS))
        .filter("price is not null or step = 1")
        .withColumns(
            {
                "sentiment": F.when(F.col("price").isNull(), "Neutral").otherwise(F.col("sentiment")),
                "confidence": F.when(F.col("price").isNull(), 0.5).otherwise(F.col("confidence")),
                "price": F.coalesce("price", "_last"),
            }
        )
        .drop("_last")
    )


def final_change(forecasts: DataFrame, closes: DataFrame) -> DataFrame:
    """Last step per ticker with its predicted change in percent of the current price."""
    last = last_row(forecasts, ("step", "ts", "price", "sentiment", "confidence"), "step")
    now = last_row(closes, ("close",)).withColumnRenamed("close", "current_price")
    change = 100.0 * F.try_divide(F.col("price") - F.col("current_price"), F.col("current_price"))
    return last.join(now, list(KEYS)).withColumn("change_pct", change)
