"""Technical indicators as recipes.

A recipe names the rows of history it reaches into and lists its columns level by level; each
level only uses columns of earlier levels. Recipes that run together share one layout, one sort
and their common columns.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.ewm import Steps, burn_in, memory, recursive_mean, side_by_side, span_alpha, weighted_mean
from ..functions.rolling import full, previous, running
from ..schema import KEYS, PRICES
from .layout import BLOCK_ROWS, HELPERS, across_blocks, core, earlier_blocks, layout


class Recipe(NamedTuple):
    outputs: tuple[str, ...]
    reach: int
    steps: Steps
    totals: tuple[str, ...] = ()  # outputs that keep running across blocks


# Levels are numbered so that recipes meet: 0 looks back at the bars, 1 combines, 2 averages the
# combinations and starts exponential sums, 3 and 4 carry those over, 8 and on do so once more.


def _change() -> Column:
    return F.col("close") - F.col("_prev_close")


def _prev_close() -> dict[str, Column]:
    return {"_prev_close": previous("close")}


def _tr() -> dict[str, Column]:
    # greatest() skips NULLs, so the first bar's range is high - low
    return {
        "_tr": F.greatest(
            F.col("high") - F.col("low"),
            F.abs(F.col("high") - F.col("_prev_close")),
            F.abs(F.col("low") - F.col("_prev_close")),
        )
    }


def _at(level: int, steps: Steps) -> Steps:
    return [{} for _ in range(level)] + steps


def _sma(windows=(20, 50)) -> Recipe:
    cols = {f"sma_{n}": full(F.avg, "close", n) for n in windows}
    return Recipe(tuple(cols), max(windows) - 1, [cols])


def _ema(span=20) -> Recipe:
    name, alpha = f"ema_{span}", span_alpha(span)
    return Recipe((name,), burn_in(alpha), _at(2, recursive_mean(name, F.col("close"), alpha)))


def _delta() -> Recipe:
    return Recipe(("delta",), 1, [_prev_close(), {"delta": _change()}])


def _rsi(n=14) -> Recipe:
    gain, loss = F.col("_gain"), F.col("_loss")
    rsi = (
        F.when(loss == 0, F.when(gain > 0, F.lit(100.0)))
        .otherwise(100.0 - F.try_divide(F.lit(100.0), 1.0 + F.try_divide(gain, loss)))
    )
    return Recipe(
        ("rsi",),
        n,
        [
            _prev_close(),
            {"_up": S.zeroed(_change(), _change() > 0), "_down": S.zeroed(-_change(), _change() < 0)},
            {"_gain": full(F.avg, "_up", n), "_loss": full(F.avg, "_down", n)},
            {"rsi": rsi},
        ],
    )


def _bollinger(n=20, width=2.0) -> Recipe:
    middle, sd = F.col("bb_middle"), F.col("_bb_std")
    return Recipe(
        ("bb_middle", "bb_upper", "bb_lower", "bb_width"),
        n - 1,
        [
            {"bb_middle": full(F.avg, "close", n), "_bb_std": full(F.stddev_samp, "close", n)},
            {
                "bb_upper": middle + sd * width,
                "bb_lower": middle - sd * width,
                "bb_width": F.try_divide((middle + sd * width) - (middle - sd * width), middle),
            },
        ],
    )


def _macd(fast=12, slow=26, signal=9) -> Recipe:
    quick = recursive_mean("_ema_fast", F.col("close"), span_alpha(fast))
    steady = recursive_mean("_ema_slow", F.col("close"), span_alpha(slow))
    averages = _at(2, side_by_side(quick, steady))
    line = {"macd": F.col("_ema_fast") - F.col("_ema_slow")}
    return Recipe(
        ("macd", "signal_line"),
        burn_in(span_alpha(max(fast, slow))) + burn_in(span_alpha(signal)),
        side_by_side(
            averages,
            _at(len(averages), [line]),
            _at(8, recursive_mean("signal_line", F.col("macd"), span_alpha(signal))),
        ),
    )


def _true_range() -> Recipe:
    return Recipe(("true_range",), 1, [_prev_close(), _tr(), {"true_range": F.col("_tr")}])


def _atr(n=14) -> Recipe:
    return Recipe(("atr",), n, [_prev_close(), _tr(), {"atr": full(F.avg, "_tr", n)}])


def _hilo(n: int) -> dict[str, Column]:
    return {f"_low_{n}": full(F.min, "low", n), f"_high_{n}": full(F.max, "high", n)}


def _stochastic(n=14, smooth=3) -> Recipe:
    low, high = F.col(f"_low_{n}"), F.col(f"_high_{n}")
    k = 100.0 * F.try_divide(F.col("close") - low, high - low)
    return Recipe(
        ("pct_k", "pct_d"),
        n + smooth - 2,
        [_hilo(n), {"pct_k": k}, {"pct_d": full(F.avg, "pct_k", smooth)}],
    )


def _williams_r(n=14) -> Recipe:
    low, high = F.col(f"_low_{n}"), F.col(f"_high_{n}")
    r = -100.0 * F.try_divide(high - F.col("close"), high - low)
    return Recipe(("williams_r",), n - 1, [_hilo(n), {"williams_r": r}])


def _running_total(name: str, change: Column) -> Recipe:
    own = F.when(F.col("is_core"), F.col(f"{name}__change")).otherwise(F.lit(0.0))
    steps = [
        _prev_close(),
        {f"{name}__change": F.coalesce(change, F.lit(0.0))},
        {name: F.sum(own).over(running())},
    ]
    return Recipe((name,), 1, steps, (name,))


def _obv() -> Recipe:
    return _running_total("obv", F.signum(_change()) * F.col("volume"))


def _pvt() -> Recipe:
    change = S.pct_change(F.col("close"), F.col("_prev_close")) * F.col("volume")
    return _running_total("pvt", change)


def _cmf(n=20) -> Recipe:
    above, below = F.col("close") - F.col("low"), F.col("high") - F.col("close")
    flow = F.try_divide(above - below, F.col("high") - F.col("low")) * F.col("volume")
    return Recipe(
        ("cmf",),
        n - 1,
        [
            {},
            {"_flow": flow},
            {"_flow_sum": full(F.sum, "_flow", n), "_volume_sum": full(F.sum, "volume", n)},
            {"cmf": F.try_divide(F.col("_flow_sum"), F.col("_volume_sum"))},
        ],
    )


def _adx(n=14) -> Recipe:
    alpha = 1.0 / n
    up, down, ranges = F.col("_ew_up"), F.col("_ew_down"), F.col("_ew_tr")
    plus, minus = F.col("plus_di"), F.col("minus_di")
    before = {"_prev_high": previous("high"), "_prev_low": previous("low")}
    moves = {
        "plus_dm": S.floored(F.col("high") - F.col("_prev_high")),
        "minus_dm": S.capped(F.col("low") - F.col("_prev_low")),
    }
    smoothed = side_by_side(
        weighted_mean("_ew_up", F.col("plus_dm"), alpha),
        weighted_mean("_ew_down", F.col("minus_dm"), alpha),
        weighted_mean("_ew_tr", F.col("_tr"), alpha),
    )
    return Recipe(
        ("plus_dm", "minus_dm", "plus_di", "minus_di", "dx", "adx"),
        1 + 2 * memory(alpha),
        [
            _prev_close() | before,
            _tr() | moves,
            *smoothed,
            {
                "plus_di": 100.0 * F.try_divide(up, ranges),
                "minus_di": F.abs(100.0 * F.try_divide(down, ranges)),
            },
            {"dx": 100.0 * F.try_divide(F.abs(plus - minus), plus + minus)},
            *weighted_mean("adx", F.col("dx"), alpha),
        ],
    )


def _log_returns() -> Recipe:
    # the first bar has no predecessor; its return counts as 0
    returns = {
        f"{c}_return": F.when(F.col("pos") == 0, F.lit(0.0)).otherwise(
            S.log_ratio(F.col(c), F.col(f"_prev_{c}"))
        )
        for c in PRICES
    }
    before = {f"_prev_{c}": previous(c) for c in PRICES}
    return Recipe(tuple(returns), 1, [before, returns])


def _pct_change() -> Recipe:
    change = S.pct_change(F.col("close"), F.col("_prev_close"))
    return Recipe(("pct_change",), 1, [_prev_close(), {"pct_change": change}])


RECIPES = {
    "sma": _sma,
    "ema": _ema,
    "delta": _delta,
    "rsi": _rsi,
    "bollinger": _bollinger,
    "macd": _macd,
    "true_range": _true_range,
    "atr": _atr,
    "stochastic": _stochastic,
    "williams_r": _williams_r,
    "obv": _obv,
    "cmf": _cmf,
    "pvt": _pvt,
    "adx": _adx,
    "log_returns": _log_returns,
    "pct_change": _pct_change,
}

# What the full indicator set contains.
ALL = (
    "sma", "ema", "rsi", "bollinger", "macd", "atr", "stochastic", "williams_r",
    "obv", "cmf", "pvt", "adx",
)


def apply_steps(laid: DataFrame, recipes: list[Recipe]) -> DataFrame:
    for level in side_by_side(*[r.steps for r in recipes]):
        if level:
            laid = laid.withColumns(level)
    return laid


def lay_and_compute(
    bars: DataFrame, recipes: list[Recipe], block_rows: int = BLOCK_ROWS, settle=None
) -> DataFrame:
    """The bars' own columns, the recipes' outputs and the layout helpers; core rows only.

    Running totals need a second look at the blocks; ``settle`` (for example
    ``session.checkpointed``) may keep the first result for it.
    """
    own = [c for c in bars.columns if c not in HELPERS]
    outputs = [c for r in recipes for c in r.outputs]
    totals = [c for r in recipes for c in r.totals]
    df = layout(bars, before=max(r.reach for r in recipes), block_rows=block_rows)
    df = core(apply_steps(df, recipes), keep=True)
    df = df.select(*own, *outputs, *HELPERS)
    if settle is not None:
        df = settle(df)
    if totals:
        df = across_blocks(
            df,
            {f"_sum_{c}": F.col(c) for c in totals},
            {
                f"_before_{c}": F.coalesce(F.sum(f"_sum_{c}").over(earlier_blocks()), F.lit(0.0))
                for c in totals
            },
        ).withColumns({c: F.col(c) + F.col(f"_before_{c}") for c in totals})
    return df.select(*own, *outputs, *HELPERS)


def compute(bars: DataFrame, recipes: list[Recipe], block_rows: int = BLOCK_ROWS) -> DataFrame:
    return lay_and_compute(bars, recipes, block_rows).drop(*HELPERS)


def indicators(bars: DataFrame, names=ALL, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the named indicators with their usual windows, in one pass over one layout."""
    return compute(bars, [RECIPES[n]() for n in names], block_rows)


def sma(bars, windows=(20, 50), **kw) -> DataFrame:
    return compute(bars, [_sma(windows)], **kw)


def ema(bars, span=20, **kw) -> DataFrame:
    return compute(bars, [_ema(span)], **kw)


def delta(bars, **kw) -> DataFrame:
    return compute(bars, [_delta()], **kw)


def rsi(bars, n=14, **kw) -> DataFrame:
    return compute(bars, [_rsi(n)], **kw)


def bollinger(bars, n=20, width=2.0, **kw) -> DataFrame:
    return compute(bars, [_bollinger(n, width)], **kw)


def macd(bars, fast=12, slow=26, signal=9, **kw) -> DataFrame:
    return compute(bars, [_macd(fast, slow, signal)], **kw)


def true_range(bars, **kw) -> DataFrame:
    return compute(bars, [_true_range()], **kw)


def atr(bars, n=14, **kw) -> DataFrame:
    return compute(bars, [_atr(n)], **kw)


def stochastic(bars, n=14, smooth=3, **kw) -> DataFrame:
    return compute(bars, [_stochastic(n, smooth)], **kw)


def williams_r(bars, n=14, **kw) -> DataFrame:
    return compute(bars, [_williams_r(n)], **kw)


def obv(bars, **kw) -> DataFrame:
    return compute(bars, [_obv()], **kw)


def cmf(bars, n=20, **kw) -> DataFrame:
    return compute(bars, [_cmf(n)], **kw)


def pvt(bars, **kw) -> DataFrame:
    return compute(bars, [_pvt()], **kw)


def adx(bars, n=14, **kw) -> DataFrame:
    return compute(bars, [_adx(n)], **kw)


def log_returns(bars, **kw) -> DataFrame:
    return compute(bars, [_log_returns()], **kw)


def pct_change(bars, **kw) -> DataFrame:
    return compute(bars, [_pct_change()], **kw)
