"""A forecast of tickers that are measured against each other.

What a ticker sees of its related ones, their price against its own and the like, moves with every step of all of them. So the
state is the newest closes of each pair of tickers, and a step moves all tickers at once: every ticker predicts its return
from its own newest features and from its pairs, then every pair takes the two new prices. The state has one row a pair
and is bounded by the window, not by the history; a step is one aggregate by ticker and one join of the pairs with the new
prices, and the state is written down every few steps so that the plan stays short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.latest import last_row, newest
from ..operators.scaling import scaled
from ..schema import KEYS, PAIR_KEYS, RELATIVE
from ..session import checkpointed
from .forecast import FORECAST, future_times, return_sentiment, with_fallback

WRITTEN_EVERY = 4


def pair_state(pairs: DataFrame, window: int = 20) -> DataFrame:
    """(ticker, related_ticker, rank, closes, related_closes, volume_ratio): the newest ``window`` + 1 common bars of each pair.

    ``pairs`` has a row for each time that both have a bar. Pairs with fewer common bars have shorter arrays.
    """
    keys = (*PAIR_KEYS, "rank")
    rows = newest(pairs, window + 1, keys=keys)
    packed = F.sort_array(F.collect_list(F.struct("ts", "close", "related_close", "volume", "related_volume")))
    state = rows.groupBy(*keys).agg(packed.alias("_b"))
    last = F.element_at("_b", -1)
    ratio = F.try_divide(last["related_volume"], last["volume"]).alias("volume_ratio")
    return state.select(*keys, F.col("_b.close").alias("closes"), F.col("_b.related_close").alias("related_closes"), ratio)


def _mean(x: Column) -> Column:
    return F.try_divide(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), F.size(x).cast("double"))


def _products(x: Column, y: Column) -> Column:
    """The sum of products of the two deviations from the mean."""
    mx, my = _mean(x), _mean(y)
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - mx) * (b - my)), F.lit(0.0), lambda s, v: s + v)


def _returns(x: Column) -> Column:
    return F.zip_with(F.slice(x, 2, F.size(x) - 1), F.slice(x, 1, F.size(x) - 1), lambda now, before: F.try_divide(now, before) - 1.0)


def measures(window: int = 20) -> dict[str, Column]:
    """The relative features of the last bar of a pair's state; NULL where there are too few bars."""
    own, other = F.col("closes"), F.col("related_closes")
    ratio = F.try_divide(F.element_at(other, -1), F.element_at(own, -1))
    moves, other_moves = _returns(own), _returns(other)
    tail, other_tail = (F.slice(x, F.greatest(F.size(x) - window + 1, F.lit(1)), window) for x in (own, other))
    full = F.size(own) >= window
    correlation = F.try_divide(_products(tail, other_tail), F.sqrt(_products(tail, tail)) * F.sqrt(_products(other_tail, other_tail)))
    enough = (F.size(own) > window) & ~F.exists(moves, lambda x: x.isNull()) & ~F.exists(other_moves, lambda x: x.isNull())
    # the correlation of the returns by the ratio of their deviations
    beta = F.try_divide(_products(moves, other_moves), _products(moves, moves))
    defined = _products(other_moves, other_moves) > 0
    return {
        "price_ratio": ratio,
        "return_difference": F.when(F.size(own) > 1, F.element_at(other_moves, -1) - F.element_at(moves, -1)),
        "relative_strength": 100.0 * ratio,
        "rolling_correlation": F.when(full, correlation),
        "volume_ratio": F.col("volume_ratio"),
        "beta": F.when(enough & defined, beta),
    }


def _moved(closes: Column, price: Column) -> Column:
    return F.concat(F.slice(closes, 2, F.size(closes)), F.array(price))


def coupled_forecast(
    predict: Callable[[Column, Column], Column], own: DataFrame, pairs: DataFrame, steps: int, interval: str, window: int = 20, written_every: int = WRITTEN_EVERY
) -> DataFrame:
    """(ticker, step, ts, price, sentiment, confidence).

    ``own`` has a row per ticker: close, ts, ``x`` (its newest scaled features, the first one its scaled return) and the
    range f_min, f_max of that one. ``pairs`` is a ``pair_state``. ``predict`` gives the return from ``x`` and from the list of a
    ticker's related ones in the order of their rank, structs of rank and the relative features. A ticker without
    features, without pairs or whose prediction is NULL gets one neutral row; its price stays for those it is related to.
    """
    latest = own
    state = checkpointed(own.select(*KEYS, F.col("close").alias("price"), "x", "f_min", "f_max"))
    pairs, done = checkpointed(pairs), None
    for step in range(1, steps + 1):
        measured = pairs.select(*KEYS, F.struct("rank", *[c.alias(n) for n, c in measures(window).items()]).alias("m"))
        seen = measured.groupBy(*KEYS).agg(F.sort_array(F.collect_list("m")).alias("seen"))  # as many as a ticker has related ones
        judged = state.join(seen, list(KEYS), "left").withColumn("r", predict(F.col("x"), F.col("seen")))
        value = scaled(F.col("r"), F.col("f_min"), F.col("f_max"), "robust")
        sentiment, confidence = return_sentiment(F.col("r"))
        moved = judged.select(
            *KEYS, F.when(F.col("r").isNull(), F.col("price")).otherwise(F.col("price") * F.exp("r")).alias("price"),
            F.when(F.col("r").isNull(), F.col("x")).otherwise(F.concat(F.array(value), F.slice("x", 2, F.size("x")))).alias("x"), "f_min", "f_max",
            F.col("r").isNotNull().alias("known"), sentiment.alias("sentiment"), confidence.alias("confidence"),
        )
        moved = checkpointed(moved)
        result = moved.where("known").select(*KEYS, F.lit(step).alias("step"), "price", "sentiment", "confidence")
        done = result if done is None else done.unionByName(result)
        state = moved.select(*KEYS, "price", "x", "f_min", "f_max")
        price = state.select(*KEYS, F.col("price").alias("_p"))
        theirs = state.select(F.col("ticker").alias("related_ticker"), F.col("price").alias("_q"))
        pairs = pairs.join(price, list(KEYS)).join(theirs, "related_ticker").select(
            *PAIR_KEYS, "rank", _moved(F.col("closes"), F.col("_p")).alias("closes"), _moved(F.col("related_closes"), F.col("_q")).alias("related_closes"), "volume_ratio"
        )
        if step % written_every == 0:
            pairs = checkpointed(pairs)
    times = future_times(latest, steps, interval)
    return with_fallback(times.join(done, [*KEYS, "step"], "left"), latest).select(*FORECAST)


def coupled_start(scaled_features: DataFrame, bars: DataFrame, params: DataFrame, cols) -> DataFrame:
    """The newest close, time and scaled features of every ticker, NULL where a feature is missing, and the range of the first."""
    ends = params.where(F.col("feature") == cols[0]).select(*KEYS, "f_min", "f_max")
    x = last_row(scaled_features.select(*KEYS, "ts", F.array(*cols).alias("x")), ("x",))
    x = x.where(~F.exists("x", lambda v: v.isNull()))
    return last_row(bars, ("close", "ts")).join(x, list(KEYS), "left").join(ends, list(KEYS), "left")


def relative_names(k: int) -> list[str]:
    return [f"{c}_stock_{i}" for i in range(1, k + 1) for c in RELATIVE]
