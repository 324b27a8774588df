"""Exponential weighting as plain window sums.

``S_t = sum(beta^(t-i) * v_i)`` is split into stripes of positions. Inside a stripe it is
``beta^j * sum(beta^-j * v)``; what all earlier stripes of the block contribute is their last values, each
damped by ``beta^length`` once more per stripe. A mean needs ``burn_in`` rows of history in front of a block,
after which older values are below double precision. A ratio of two such sums can stay defined on values that have
all but vanished; it needs ``memory`` rows, after which they are no double at all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..schema import KEYS

_TINY = 1e-17
_MAX_EXPONENT = 600.0

Steps = list[dict[str, Column]]


def span_alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def burn_in(alpha: float) -> int:
    """Rows after which an older value no longer shows in a double."""
    return math.ceil(math.log(_TINY) / math.log(1.0 - alpha))


def memory(alpha: float) -> int:
    """Rows after which an older value has left even a sum of zeros: beta^n is below the smallest double."""
    return math.ceil(math.log(5e-324) / math.log(1.0 - alpha))


# one stripe length suits all usual weights, so that their windows share a sort
STRIPE_ROWS = burn_in(1.0 / 14.0)


def _stripe_rows(alpha: float) -> int:
    own = burn_in(alpha)
    shared = own <= STRIPE_ROWS and -STRIPE_ROWS * math.log(1.0 - alpha) < _MAX_EXPONENT
    return STRIPE_ROWS if shared else own


def decayed_sum(name: str, value: Column, alpha: float, keys=KEYS) -> Steps:
    """Steps that end with column ``name`` = ``sum(beta^(t-i) * value_i)``."""
    beta, rows = 1.0 - alpha, _stripe_rows(alpha)
    stripe = F.col("stripe") if rows == STRIPE_ROWS else F.floor(F.col("pos") / rows)
    j = (F.col("pos") % rows).cast("double")
    inside = (
        Window.partitionBy(*keys, "block", stripe)
        .orderBy("pos")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    earlier = (
        Window.partitionBy(*keys, "block")
        .orderBy(stripe, "pos")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    part, ends, carried = f"{name}__part", f"{name}__ends", f"{name}__carried"
    stripe_end = F.when(F.col("pos") % rows == rows - 1, F.col(part))
    # at the first row of a stripe: the sum at the end of the stripe before, from the ends of all earlier ones
    before = F.aggregate(ends, F.lit(0.0), lambda acc, end: acc * beta**rows + end)
    return [
        {part: F.pow(F.lit(beta), j) * F.sum(F.pow(F.lit(beta), -j) * value).over(inside)},
        {ends: F.collect_list(stripe_end).over(earlier)},
        {carried: F.first(F.when(j == 0, before), ignorenulls=True).over(inside)},
        {name: F.col(part) + F.pow(F.lit(beta), j + 1) * F.coalesce(F.col(carried), F.lit(0.0))},
    ]


def recursive_mean(name: str, x: Column, alpha: float, keys=KEYS) -> Steps:
    """``y_0 = x_0``, ``y_t = alpha * x_t + (1 - alpha) * y_(t-1)``; ``x`` must not be NULL."""
    known = F.when(x.isNull(), F.raise_error(F.lit(f"{name}: input has a NULL"))).otherwise(x)
    value = F.when(F.col("pos") == 0, known).otherwise(F.lit(alpha) * known)
    return decayed_sum(name, value, alpha, keys)


def weighted_mean(name: str, x: Column, alpha: float, keys=KEYS) -> Steps:
    """Mean weighted by ``(1 - alpha)^age`` over the non-null values; a NULL repeats the last mean."""
    num, den = f"{name}__num", f"{name}__den"
    seen = F.when(x.isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))
    top = decayed_sum(num, F.coalesce(x, F.lit(0.0)), alpha, keys)
    bottom = decayed_sum(den, seen, alpha, keys)
    return side_by_side(top, bottom) + [{name: F.try_divide(F.col(num), F.col(den))}]


def side_by_side(*chains: Steps) -> Steps:
    """Run several chains of steps level by level."""
    depth = max((len(c) for c in chains), default=0)
    return [{k: v for c in chains if i < len(c) for k, v in c[i].items()} for i in range(depth)]
