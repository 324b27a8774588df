"""Window frames over laid-out bars (see ``operators.layout``).

Every frame stays inside one block of a ticker, so a task never holds more than one block
however many bars the ticker has.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from ..schema import KEYS


def block_window(keys=KEYS) -> WindowSpec:
    # "stripe" grows with "pos"; naming it first lets stripe windows share this sort
    return Window.partitionBy(*keys, "block").orderBy("stripe", "pos")


def last_rows(n: int, keys=KEYS) -> WindowSpec:
    return block_window(keys).rowsBetween(-(n - 1), 0)


def running(keys=KEYS) -> WindowSpec:
    return block_window(keys).rowsBetween(Window.unboundedPreceding, 0)


def full(agg, c: Column | str, n: int, keys=KEYS) -> Column:
    """``agg`` over the last ``n`` rows, NULL until there are ``n`` non-null values."""
    w = last_rows(n, keys)
    return F.when(F.count(c).over(w) == n, agg(c).over(w))


def previous(c: str, k: int = 1, keys=KEYS) -> Column:
    return F.lag(c, k).over(block_window(keys))
