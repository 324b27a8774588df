"""The registered queries: each operator over the whole given tables."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from barloom.functions import scalar as S
from barloom.operators import daily as D
from barloom.operators import fill as FI
from barloom.operators import indicators as I
from barloom.operators import latest as L
from barloom.operators import levels as V
from barloom.operators import metrics as M
from barloom.operators import quantile as Q
from barloom.operators import relative as R
from barloom.operators import scaling as SC
from barloom.operators import sequences as SQ
from barloom.plans import features as PF
from barloom.plans import coupled as CF
from barloom.plans import feeds as FE
from barloom.plans import forecast as FC
from barloom.plans import lengths as LN
from barloom.plans import models as MO
from barloom.plans.predictors import Predictor
from barloom.plans.technical import technical_report
from barloom.schema import FEATURES, KEYS, PRICES
from barloom.session import fresh_path, materialize
from barloom.sources import periods as P
from barloom.operators.layout import positions
from barloom.sources.bars import build_bars, market_hours, read_bars, roll_up
from barloom.sources.candles import candles
from barloom.sources.laid import load_laid, save_laid, stored_bars
from barloom.sources.related import related_bars
from barloom.sources.store import load_fit, load_params, save_fit, save_params
from barloom.streaming.bars import land_versions, newest_versions, stream_bars, tick_stream

from .fixtures import event_bars, order_bars, order_weeks, related, related_columns, shown, table, user_bars, user_minutes

AS_OF = datetime(2000, 3, 15, 12, 0)
SEQ, LONG = 5, 1200


def _on(make, operate, digits=6):
    return lambda spark, sf: shown(operate(make(spark, sf)), digits)


def _enriched(bars, *names):
    return I.indicators(bars, names or I.ALL).drop(*PRICES, "volume")


def _naive(bars):
    """Previous close as the forecast of a close: a forecast that needs no model."""
    paired = SQ.sequences(bars, ("close",), 1, "labelled")
    return paired.select(*KEYS, "ts", F.col("close").alias("y_true"), F.col("seq")[0][0].alias("y_pred"))


def _steps(df):
    """One row per step of a sequence."""
    return df.select(*KEYS, "ts", F.posexplode("seq").alias("step", "row")).select(
        *KEYS, "ts", F.col("step").cast("int").alias("step"), F.col("row")[0].alias("x"), F.col("row")[1].alias("y")
    )


def _payloads(bars):
    times = F.transform("rows", lambda row: F.unix_seconds(row["ts"])).alias("t")
    day = F.struct(times, *[F.col("rows")[c].alias(c[0]) for c in (*PRICES, "volume")])
    rows = F.sort_array(F.collect_list(F.struct("ts", *PRICES, "volume"))).alias("rows")
    by_day = bars.groupBy(*KEYS, S.day_of().alias("date")).agg(rows)
    return by_day.select("ticker", F.to_json(day).alias("payload"))


def _last_close_forecast(bars, steps=3, interval="1h"):
    last = L.last_row(bars, ("ts", "close"))
    return FC.future_times(last, steps, interval).join(
        last.select(*KEYS, F.col("close").alias("price")), list(KEYS)
    )


def _saved_params(spark, sf):
    path = fresh_path(spark, "norm_params")
    save_params(SC.fit_scaler(order_bars(spark, sf), FEATURES[:5], "minmax"), path)
    return shown(load_params(spark, path))


def _stream(spark, sf):
    ticks = tick_stream(spark, sf, table(spark, sf, "events"), "events.parquet")
    bars = stream_bars(ticks, "1h", ticker="event_type", price="value", id="event_id")
    out = fresh_path(spark, "stream_bars")
    land_versions(bars, out, fresh_path(spark, "stream_state")).awaitTermination()
    return shown(newest_versions(spark, out, bars))


def _read(tickers=None, start=None, end=None):
    """Bars written once and read back, of all tickers or some, between two dates."""
    def run(spark, sf):
        path = fresh_path(spark, "bars")
        event_bars(spark, sf).write.parquet(path)
        return shown(read_bars(spark, path, tickers=tickers, start=start, end=end))

    return run


def _stored(operate, buckets=8):
    """The same from bars that were stored as blocks and read back as they lie."""
    def run(spark, sf):
        name = f"laid_{uuid.uuid4().hex}"
        save_laid(event_bars(spark, sf), name, buckets)
        return shown(operate(spark, name))

    return run


def _bars_once(spark, sf):
    """Bars of ticks that were all delivered twice."""
    ticks = table(spark, sf, "events")
    return shown(build_bars(ticks.unionByName(ticks), "1h", ticker="event_type", price="value", id="event_id", once=True))


def _flat_stretch(bars, first=400, last=1700):
    """One-minute bars that do not move between two places; all rows stay."""
    placed = positions(bars)
    stuck = placed.filter(F.col("pos") == first - 1).select(F.col("ticker").alias("_t"), F.col("close").alias("_stuck"))
    inside = F.col("_stuck").isNotNull() & F.col("pos").between(first, last)
    out = placed.join(stuck, F.col("ticker") == F.col("_t"), "left")
    return out.withColumns({c: F.when(inside, F.col("_stuck")).otherwise(F.col(c)) for c in PRICES}).select(*bars.columns)


def _in_period(period):
    def run(spark, sf):
        start, end = P.period_bounds(period, AS_OF)
        return shown(P.period_filter(order_bars(spark, sf, "1d", start, end), period, AS_OF))

    return run


def _scaled(kind, cols=("close", "volume")):
    def run(bars):
        return SC.scale(bars, SC.fit_scaler(bars, cols, kind), cols, kind).select(*KEYS, "ts", *cols)

    return run


def _restored(bars):
    cols = ("close", "volume")
    params = SC.fit_scaler(bars, cols, "zscore")
    there = SC.scale(bars, params, cols, "zscore")
    return SC.unscale(there, params, cols, "zscore").select(*KEYS, "ts", F.round("close", 2).alias("close"))


def _cut(bars):
    split = SQ.time_split(bars)
    params = SC.fit_scaler(split, ("close", "volume"), "minmax", "train")
    return params


def _indicator_gaps(bars):
    return FI.fill(I.cmf(I.sma(bars)), ("sma_50", "cmf")).select(*KEYS, "ts", "sma_50", "cmf")


def _null_report(bars):
    return FI.null_report(I.indicators(bars), FEATURES)


def _loss(bars):
    rows = D.next_day_label(bars)
    proba = 1.0 / (1.0 + F.exp((F.col("close") - F.col("open")) / F.col("close")))
    rows = rows.withColumns({"p_bearish": proba, "guess": F.lit(0.01)})
    return M.combined_loss(rows, "next_return", "guess", "sentiment", "p_bearish")


def _confidence(bars):
    naive = _naive(bars)
    scored = naive.join(M.metrics(naive).select(*KEYS, "mse"), list(KEYS))
    return M.confidence(scored, "y_pred", "y_true", "mse").select(*KEYS, "ts", "direction", "score")


def _technical(bars):
    report = technical_report(bars)
    return report.summary.join(report.trend, list(KEYS)).join(report.latest.drop("ts"), list(KEYS))


def _features(bars):
    return PF.feature_rows(bars).select(*KEYS, "ts", *PF.RETURN_FEATURES)


def _scaled_features(bars):
    rows = materialize(PF.feature_rows(bars))
    return PF.scaled_rows(rows).select(*KEYS, "ts", *PF.RETURN_FEATURES)


def _all_steps(made, cols, *labels):
    """One row per step of a sequence, with every feature."""
    return made.select(*KEYS, "ts", *labels, F.posexplode("seq").alias("step", "row")).select(
        *KEYS, "ts", *labels, F.col("step").cast("int").alias("step"), *[F.col("row")[i].alias(c) for i, c in enumerate(cols)]
    )


def _training_sequences(bars):
    return _all_steps(PF.training_sequences(bars, SEQ), PF.RETURN_FEATURES, "next_return", "sentiment")


def _related_sequences(spark, sf, k=2):
    bars = event_bars(spark, sf)
    made = PF.related_sequences(bars, related(spark), SEQ, k=k)
    return shown(_all_steps(made, related_columns(k), "next_return", "sentiment", "next_opening_avg"))


def _tree_close_rows(bars):
    rows = PF.tree_rows(bars, target="close", k=1)
    v = vector_to_array("features")
    return rows.select(
        *KEYS, "ts", "label", "is_train", F.size(v).alias("width"), v[3].alias("close"), v[8].alias("rsi")
    )


# bars of five days have several orders each, so that the money flow is defined; labels and forecasts share that step
STEP = "5d"


def _tree_return_rows(bars):
    v = vector_to_array("features")
    rows = PF.tree_rows(bars, target="next_return", min_bars=1)
    return rows.select(*KEYS, "ts", "label", "is_train", *[v[i].alias(c) for i, c in enumerate(PF.RETURN_FEATURES)])


def _fixed_forecast(spark, sf, steps=3):
    """A forecast whose model is a formula of the newest scaled row; scaled by the parameters of the training rows."""
    bars = order_weeks(spark, sf)
    features = materialize(PF.feature_rows(bars))
    _, params = PF.tree_data(bars, min_bars=1, features=features)
    formula = f"0.02D * x[0] - 0.01D * x[{PF.RETURN_FEATURES.index('rsi')}]"
    return shown(FC.forecast(Predictor(formula), _forecast_state(bars, params, features=features), steps, "1d"))


def _trained_scale(bars, cols=("close", "volume")):
    split = SQ.time_split(bars)
    return SC.scale(split, SC.fit_scaler(split, cols, "robust", "train"), cols, "robust").select(*KEYS, "ts", *cols)


def _restored_range(bars, cols=("close", "volume")):
    """Scaled and restored with the same eps, to six digits."""
    params = SC.fit_scaler(bars, cols, "minmax")
    return SC.unscale(SC.scale(bars, params, cols, "minmax"), params, cols, "minmax", with_eps=True).select(*KEYS, "ts", *cols)


def _confidence_percent(bars):
    return M.confidence(_naive(bars), "y_pred", "y_true").select(*KEYS, "ts", "direction", "score")


def _gbt(bars, features=None):
    rows, params = PF.tree_data(bars, min_bars=1, features=features)
    rows = materialize(rows)
    return MO.fit_gbt(rows), rows, params


def _forecast_state(bars, params, length=1, features=None, lengths=None):
    """The newest scaled rows, by the parameters of the fit."""
    features = materialize(PF.feature_rows(bars)) if features is None else features
    scaled = PF.scaled_rows(features, params=params)
    return FC.latest_state(scaled, bars, PF.RETURN_FEATURES, params, length, lengths)


def _gbt_forecast(spark, sf, steps=3):
    bars = order_bars(spark, sf, STEP)
    features = materialize(PF.feature_rows(bars))
    fitted, _, params = _gbt(bars, features)
    folder = fresh_path(spark, "models")
    save_fit(fitted.model, params, folder, "gbt", STEP, steps)
    model, params = load_fit(spark, folder, "gbt", STEP, steps)
    return shown(FC.forecast(model, _forecast_state(bars, params, features=features), steps, STEP))


def _gbt_importance(spark, sf):
    fitted, _, _ = _gbt(order_bars(spark, sf, STEP))
    return shown(MO.feature_importance(fitted, PF.RETURN_FEATURES, spark))


def _gbt_validation(spark, sf):
    """Error per ticker on the rows held out."""
    fitted, rows, _ = _gbt(order_bars(spark, sf, STEP))
    scored = MO.predict_rows(fitted, rows.filter("not is_train"))
    return shown(M.metrics(scored, "label", "prediction"))


def _dual_forecast(spark, sf, steps=3):
    bars = order_bars(spark, sf, STEP)
    lengths = LN.sequence_lengths(bars, STEP, steps)
    width = LN.width_of(lengths)
    features = materialize(PF.feature_rows(bars))
    made, params = PF.training_data(bars, width, fit_on="train", min_bars=1, lengths=lengths, features=features)
    fitted = MO.fit_dual(made)
    return shown(FC.forecast(fitted.model, _forecast_state(bars, params, width, features, lengths), steps, STEP, dual=True))


def _lengths(bars):
    return LN.sequence_lengths(bars, "1d", 1)


def _padded(spark, sf):
    """The bars, not the padding, of sequences whose length is that of their ticker."""
    bars = user_minutes(spark, sf)
    lengths = LN.sequence_lengths(bars, "5m", 1)
    made = LN.padded_sequences(bars, ("close", "volume"), lengths, LN.width_of(lengths))
    steps = made.select(*KEYS, "ts", "pad", F.posexplode(F.arrays_zip("seq", "mask")).alias("step", "s")).where("s.mask = 1")
    return shown(steps.select(*KEYS, "ts", "pad", F.col("step").cast("int").alias("step"), F.col("s.seq")[0].alias("x"), F.col("s.seq")[1].alias("y")))


def _trading_steps(spark, sf):
    """Bars per horizon beside the tickers' own bars, for every interval."""
    counts = order_bars(spark, sf).groupBy(*KEYS).agg(F.count("*").alias("n_bars"))
    steps = [F.struct(F.lit(i).alias("interval"), F.lit(d).alias("days"), F.lit(P.trading_steps(i, d)).alias("steps")) for i in P.STEPS_PER_DAY for d in (1, 3, 10)]
    return counts.select(*KEYS, "n_bars", F.explode(F.array(*steps)).alias("s")).select(*KEYS, "n_bars", "s.*")


def _related_forecast(spark, sf, steps=3, k=2):
    """Every ticker's return by a formula of its own features and of its two first related tickers."""
    bars, cols = event_bars(spark, sf), ("open_return", "rsi")
    features = materialize(PF.feature_rows(bars))
    params = materialize(SC.fit_scaler(features, cols))
    own = CF.coupled_start(PF.scaled_rows(features, cols, params=params), bars, params, cols)
    state = CF.pair_state(R.pairs(bars.select(*KEYS, "ts", "close", "volume"), R.related_found(bars, related(spark), k)))

    def formula(x, seen):
        first, second = seen[0], seen[1]
        return 0.01 * x[0] - 0.002 * x[1] + 0.001 * (first["price_ratio"] + first["volume_ratio"]) - 0.003 * second["rolling_correlation"] + 0.004 * (first["beta"] - second["return_difference"])

    return shown(CF.coupled_forecast(formula, own, state, steps, "1h"))


def _uncovered(bars):
    return PF.uncovered(PF.feature_rows(bars))


def _chart(bars):
    return FE.chart_feed(bars, _last_close_forecast(bars), V.levels(bars))


def _final_change(bars):
    moved = _last_close_forecast(bars).withColumns(
        {"price": F.col("price") * (1.0 + F.col("step") / 100.0), "sentiment": F.lit("Bullish"), "confidence": F.lit(0.5)}
    )
    return FC.final_change(moved, bars)


QUERIES = {
    # bars
    "bars_1m": lambda s, d: shown(event_bars(s, d, "1m")),
    "bars_5m": lambda s, d: shown(event_bars(s, d, "5m")),
    "bars_15m": lambda s, d: shown(event_bars(s, d, "15m")),
    "bars_30m": lambda s, d: shown(event_bars(s, d, "30m")),
    "bars_1h": lambda s, d: shown(event_bars(s, d, "1h")),
    "bars_once": _bars_once,
    "bars_stored": _stored(stored_bars),
    "bars_1d": lambda s, d: shown(order_bars(s, d, "1d")),
    "bars_5d": lambda s, d: shown(order_bars(s, d, "5d")),
    "bars_1wk": lambda s, d: shown(order_bars(s, d, "1wk")),
    "bars_1mo": lambda s, d: shown(order_bars(s, d, "1mo")),
    "bars_by_user": lambda s, d: shown(user_bars(s, d, "1d")),
    "roll_up_1d": _on(event_bars, lambda b: roll_up(b, "1d")),
    "stream_bars": _stream,
    "candles": _on(event_bars, lambda b: candles(_payloads(b))),
    "period_6mo": _in_period("6mo"),
    "period_ytd": _in_period("ytd"),
    "read_bars": _read(),
    "read_bars_range": _read(("click", "view", "error"), datetime(2024, 1, 10), datetime(2024, 1, 20)),
    "market_hours": _on(lambda s, d: event_bars(s, d, "5m"), market_hours),
    "weekdays": _on(order_bars, lambda b: b.filter(S.is_weekday(F.col("ts")))),
    "enough_bars": _on(user_bars, lambda b: L.enough_bars(b, 5)),
    "drop_last_row": _on(event_bars, SQ.drop_last_row),
    "related_bars": lambda s, d: shown(related_bars(event_bars(s, d), related(s), 3)),
    "norm_params_saved": _saved_params,
    # indicators
    "sma": _on(event_bars, lambda b: _enriched(b, "sma")),
    "ema": _on(event_bars, lambda b: _enriched(b, "ema")),
    "delta": _on(event_bars, lambda b: _enriched(b, "delta")),
    "rsi": _on(event_bars, lambda b: _enriched(b, "rsi")),
    "bollinger": _on(event_bars, lambda b: _enriched(b, "bollinger")),
    "bollinger_stored": _stored(lambda s, n: _enriched(load_laid(s, n), "bollinger")),
    "macd": _on(event_bars, lambda b: _enriched(b, "macd")),
    "true_range": _on(event_bars, lambda b: _enriched(b, "true_range")),
    "atr": _on(event_bars, lambda b: _enriched(b, "atr")),
    "stochastic": _on(event_bars, lambda b: _enriched(b, "stochastic")),
    "williams_r": _on(event_bars, lambda b: _enriched(b, "williams_r")),
    "obv": _on(event_bars, lambda b: _enriched(b, "obv")),
    "cmf": _on(order_weeks, lambda b: _enriched(b, "cmf")),
    # sums and squares of large numbers carry fewer decimals than a double's 16 digits allow
    "pvt": _on(event_bars, lambda b: _enriched(b, "pvt"), digits=3),
    "adx": _on(event_bars, lambda b: _enriched(b, "adx")),
    "adx_flat_stretch": _on(lambda s, d: event_bars(s, d, "1m"), lambda b: _enriched(_flat_stretch(b), "adx")),
    "log_returns": _on(event_bars, lambda b: _enriched(b, "log_returns")),
    "pct_change": _on(event_bars, lambda b: _enriched(b, "pct_change")),
    "indicators": _on(order_weeks, _enriched),
    # trend, levels, summaries
    "trend": _on(event_bars, L.trend),
    "trend_by_user": _on(user_minutes, L.trend),
    "level_flags": _on(event_bars, V.level_flags),
    "levels": _on(event_bars, V.levels),
    "levels_stored": _stored(lambda s, n: V.levels(load_laid(s, n))),
    "levels_top3": _on(event_bars, lambda b: V.top_levels(V.levels(b))),
    "summary": _on(event_bars, L.summary),
    "summary_by_user": _on(user_bars, L.summary),
    "data_summary": _on(event_bars, L.data_summary),
    "last_row": _on(event_bars, lambda b: L.last_row(b, ("ts", "close", "volume"))),
    "technical_report": _on(order_bars, _technical),
    # related tickers
    "relative": lambda s, d: shown(
        R.relative(R.pairs(event_bars(s, d), R.related_found(event_bars(s, d), related(s))))
    ),
    "relative_wide": lambda s, d: shown(R.relative_wide(event_bars(s, d), related(s), 3)),
    # days and labels
    "daily": _on(event_bars, D.daily),
    "trading_dates": _on(event_bars, D.trading_dates),
    "opening_average": _on(event_bars, D.opening_average),
    "next_day_opening": _on(event_bars, D.next_day_opening),
    "next_day_label": _on(event_bars, D.next_day_label),
    "next_day_label_daily": _on(order_bars, lambda b: D.next_day_label(b, min_bars=1)),
    "next_day_close": _on(event_bars, D.next_day_close),
    "shifted_target": _on(event_bars, lambda b: SQ.shifted_target(b, 3)),
    # scaling and gaps
    "percentiles": _on(order_bars, lambda b: Q.quantiles(b, ("close", "volume"), (0.01, 0.99))),
    "minmax_params": _on(event_bars, lambda b: SC.fit_scaler(b, FEATURES[:5], "minmax")),
    "minmax_params_train": _on(event_bars, _cut),
    "zscore_params": _on(event_bars, lambda b: SC.fit_scaler(b, FEATURES[:5], "zscore")),
    "robust_params": _on(order_bars, lambda b: SC.fit_scaler(b, FEATURES[:5], "robust")),
    "zscore": _on(event_bars, _scaled("zscore")),
    "minmax": _on(event_bars, _scaled("minmax")),
    "robust_scale": _on(order_bars, _scaled("robust")),
    "robust_scale_train": _on(order_bars, _trained_scale),
    "unscale": _on(event_bars, _restored),
    "unscale_minmax": _on(event_bars, _restored_range),
    "ffill_bfill": _on(order_weeks, _indicator_gaps),
    "fill_constant": _on(event_bars, lambda b: FI.fill_constant(_enriched(b, "rsi"), 0.0, ("rsi",))),
    "null_report": _on(order_weeks, _null_report),
    # sequences
    "split": _on(event_bars, SQ.time_split),
    "sequences_labelled": _on(event_bars, lambda b: _steps(SQ.sequences(b, ("close", "volume"), SEQ))),
    "sequences_sliding": _on(event_bars, lambda b: _steps(SQ.sequences(b, ("close", "volume"), SEQ, "sliding"))),
    "sequences_latest": _on(event_bars, lambda b: _steps(SQ.sequences(b, ("close", "volume"), SEQ, "latest"))),
    "sequences_latest_long": _on(
        lambda s, d: event_bars(s, d, "1m"), lambda b: _steps(SQ.sequences(b, ("close", "volume"), LONG, "latest"))
    ),
    "sequence_length": _on(user_bars, _lengths),
    "sequences_padded": _padded,
    "trading_steps": _trading_steps,
    # metrics
    "metrics": _on(order_bars, lambda b: M.metrics(_naive(b)), digits=2),
    "combined_loss": _on(event_bars, _loss),
    "confidence": _on(order_bars, _confidence),
    "confidence_percent": _on(order_bars, _confidence_percent),
    # features and forecasts
    "features": _on(order_weeks, _features),
    "scaled_features": _on(order_weeks, _scaled_features),
    "training_sequences": _on(event_bars, _training_sequences),
    "related_sequences": _related_sequences,
    "uncovered": _on(order_bars, _uncovered),
    "tree_rows_return": _on(order_weeks, _tree_return_rows),
    "forecast_fixed": _fixed_forecast,
    "related_forecast": _related_forecast,
    "tree_rows_close": _on(order_weeks, _tree_close_rows),
    "future_times": _on(order_bars, lambda b: FC.future_times(L.last_row(b, ("ts",)), 7, "1d")),
    "chart_feed": _on(event_bars, _chart),
    "overlay_feed": _on(event_bars, lambda b: FE.overlay_feed(I.indicators(b, ("sma", "ema", "bollinger", "rsi")))),
    "final_change": _on(event_bars, _final_change),
    "gbt_validation": _gbt_validation,
    "feature_importance": _gbt_importance,
    "gbt_forecast": _gbt_forecast,
    "dual_forecast": _dual_forecast,
}
