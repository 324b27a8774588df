"""From bars to model-ready rows and sequences."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.daily import next_day_label, next_day_opening
from ..operators.fill import fill, fill_laid_out
from ..operators.indicators import ALL, RECIPES, lay_and_compute
from ..operators.layout import BLOCK_ROWS, HELPERS
from ..operators.relative import at_common_times, by_rank, pairs, related_found, relative
from ..operators.scaling import fit_scaler, scale
from ..operators.sequences import drop_last_row, sequences, shifted_target, time_split
from ..schema import FEATURES, KEYS, RELATIVE, return_features
from ..session import checkpointed, materialize
from .lengths import PADDED, padded_sequences

RETURN_FEATURES = tuple(return_features())


def feature_rows(bars: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Bars with the 23 features (prices as log returns), gaps filled; ``pos``/``n_rows`` are kept.

    The indicators are checkpointed: totals and gaps look at the blocks again, where they lie.
    """
    recipes = [RECIPES[n]() for n in (*ALL, "log_returns")]
    laid = lay_and_compute(bars, recipes, block_rows, checkpointed)
    extra = [c for c in RETURN_FEATURES if c not in bars.columns]
    laid = laid.select(*[c for c in bars.columns if c not in HELPERS], *extra, *HELPERS)
    return fill_laid_out(laid, RETURN_FEATURES).drop("block", "stripe", "is_core", "is_block_end")


def scaled_rows(
    features: DataFrame, cols=RETURN_FEATURES, fit_on: str = "all", params: DataFrame | None = None
) -> DataFrame:
    """Features scaled per ticker between their 1st and 99th percentile, clipped to +-10."""
    if params is None:
        params = fit_scaler(features, cols, "robust", fit_on)
    return scale(features, params, cols, "robust")


def labelled_rows(features: DataFrame, min_bars: int = 2) -> DataFrame:
    """Next-day return and sentiment added; the last row and rows without a label leave."""
    return drop_last_row(next_day_label(features, min_bars)).filter("next_return is not null")


def uncovered(features: DataFrame, cols=RETURN_FEATURES) -> DataFrame:
    """(ticker, feature): features that a ticker has no value of at all, so that no row of it can be used."""
    counts = features.groupBy(*KEYS).agg(*[F.count(c).alias(c) for c in cols])
    return counts.unpivot(list(KEYS), list(cols), "feature", "n").filter("n = 0").drop("n")


def training_data(
    bars: DataFrame,
    length: int,
    cols=RETURN_FEATURES,
    fit_on: str = "all",
    min_bars: int = 2,
    block_rows: int = BLOCK_ROWS,
    lengths: DataFrame | None = None,
    features: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``training_sequences`` and the scaling parameters they were made with.

    With ``lengths`` (``lengths.sequence_lengths``) every ticker has its own, and sequences are padded to ``length``.
    ``features``, where given, are the kept ``feature_rows`` of the bars.

    The features are written to the shared checkpoint folder once, as fitting reads them thrice. A ticker that lacks a
    feature has no rows; ``uncovered`` names it.
    """
    given = features is not None
    features = features if given else feature_rows(bars, block_rows)
    if fit_on == "train":
        features = time_split(features)  # by place: nothing to compute again
    features = features if given else materialize(features)
    # after filling, a feature is NULL either never or for all rows of a ticker too short for it
    whole = features.na.drop("any", subset=list(cols))
    # the label needs the unscaled prices; only the features named in ``cols`` are replaced
    rows = next_day_label(whole, min_bars)
    params = materialize(fit_scaler(features, cols, "robust", fit_on))
    rows = scaled_rows(rows, cols, params=params)
    kept = rows.select(
        *KEYS, "ts", "close", "next_return", "sentiment", *cols, "pos", "n_rows",
        (F.col("pos") == F.col("n_rows") - 1).alias("_is_last"),
    )
    if lengths is None:
        made, more = sequences(kept, cols, length, "labelled", block_rows=block_rows), ("seq",)
    else:
        made, more = padded_sequences(kept, cols, lengths, length, block_rows), PADDED
    made = made.filter("not _is_last and next_return is not null").select(*KEYS, "ts", "close", "next_return", "sentiment", *more)
    return made, params


def training_sequences(bars: DataFrame, length: int, **options) -> DataFrame:
    """(ticker, ts, close, next_return, sentiment, seq): indicators, fill, scale, label, window."""
    return training_data(bars, length, **options)[0]


def tree_data(
    bars: DataFrame, fit_on: str = "train", min_bars: int = 2, features: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows for boosted trees on the next day's return, and the scaling parameters of their features.

    ``features``, where given, are the kept ``feature_rows`` of the bars.
    """
    features = materialize(feature_rows(bars)) if features is None else features
    rows = labelled_rows(features, min_bars).withColumnRenamed("next_return", "label")
    rows = materialize(_split_whole(rows, RETURN_FEATURES))
    params = materialize(fit_scaler(rows if fit_on == "train" else features, RETURN_FEATURES, "robust", fit_on))
    return _vectors(scaled_rows(rows, params=params), RETURN_FEATURES), params


def tree_rows(
    bars: DataFrame, target: str = "next_return", k: int = 1, fit_on: str = "train", min_bars: int = 2
) -> DataFrame:
    """Flat rows for boosted trees: ``features`` vector, ``label`` and ``is_train``.

    ``target`` is the next-day return on scaled features, or ``close``: the close ``k`` rows ahead
    on the plain features, without filling.
    """
    if target == "close":
        recipes = [RECIPES[n]() for n in ALL]
        raw = checkpointed(lay_and_compute(bars, recipes).drop("block", "stripe", "is_core", "is_block_end"))
        rows = shifted_target(raw, k).withColumnRenamed("target", "label")
        return _vectors(_split_whole(rows, FEATURES), FEATURES)
    return tree_data(bars, fit_on, min_bars)[0]


def _split_whole(rows: DataFrame, cols) -> DataFrame:
    kept = rows.select(*KEYS, "ts", "close", "label", *[c for c in cols if c != "close"])
    return time_split(kept.na.drop("any"))


def _vectors(rows: DataFrame, cols) -> DataFrame:
    return rows.select(
        *KEYS, "ts", "close", "label", "is_train", array_to_vector(F.array(*cols)).alias("features")
    )


def related_features(
    bars: DataFrame, related: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS
) -> tuple[DataFrame, list[str]]:
    """Main features, 6 relative columns and 23 features per related ticker, joined on time.

    Returns the frame and its feature columns (23 + 6k + 23k). Gaps are filled per ticker before
    the join, the relative columns after it. A ticker with fewer than ``k`` related ones keeps its rows.
    """
    found = related_found(bars, related, k)
    own = materialize(feature_rows(bars, block_rows).drop("pos", "n_rows"))
    relative_cols = [f"{c}_stock_{i}" for i in range(1, k + 1) for c in RELATIVE]
    their_cols = [f"related_{i}_{c}" for i in range(1, k + 1) for c in RETURN_FEATURES]

    prices = bars.select(*KEYS, "ts", "close", "volume")
    measured = at_common_times(
        checkpointed(relative(pairs(prices, found), block_rows=block_rows)), found
    )
    beside_main = by_rank(measured, RELATIVE, k, lambda i, c: f"{c}_stock_{i}")

    theirs = own.select(F.col("ticker").alias("related_ticker"), "ts", *RETURN_FEATURES).join(
        found, "related_ticker"
    )
    beside_related = by_rank(theirs, RETURN_FEATURES, k, lambda i, c: f"related_{i}_{c}")

    joined = materialize(own.join(beside_main, [*KEYS, "ts"]).join(beside_related, [*KEYS, "ts"]))
    # a rank that a ticker has no related ticker for is 0 everywhere; has_<rank> tells it from a value
    had = found.groupBy(*KEYS).agg(F.collect_set("rank").alias("_ranks"))
    filled = fill(joined, relative_cols, block_rows=block_rows).join(had, list(KEYS))
    absent = {
        c: F.when(F.array_contains("_ranks", i), F.col(c)).otherwise(F.lit(0.0))
        for i in range(1, k + 1)
        for c in [*(f"{c}_stock_{i}" for c in RELATIVE), *(f"related_{i}_{c}" for c in RETURN_FEATURES)]
    }
    marks = {f"has_{i}": F.array_contains("_ranks", i) for i in range(1, k + 1)}
    return filled.withColumns(absent).withColumns(marks).drop("_ranks"), [
        *RETURN_FEATURES,
        *relative_cols,
        *their_cols,
    ]


def related_sequences(
    bars: DataFrame,
    related: DataFrame,
    length: int,
    k: int = 5,
    opening_bars: int = 6,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Sequences over the features of a ticker and its related tickers.

    Scaled by min and max per ticker; labels are the next day's return, sentiment and opening
    average. Features of related tickers that a ticker does not have are 0.
    """
    rows, cols = related_features(bars, related, k, block_rows)
    rows = materialize(rows.na.drop("any", subset=cols))
    params = materialize(fit_scaler(rows, cols, "minmax"))
    labelled = next_day_opening(next_day_label(rows), opening_bars)
    labelled = materialize(scale(labelled, params, cols, "minmax"))
    kept = labelled.select(
        *KEYS, "ts", "close", "next_return", "sentiment", "next_opening_avg", *cols
    )
    return (
        sequences(kept, cols, length, "labelled", block_rows=block_rows)
        .na.drop("any", subset=["next_opening_avg", "sentiment"])
        .select(*KEYS, "ts", "close", "next_return", "sentiment", "next_opening_avg", "seq")
    )
