"""Exact quantiles per key without gathering a key's values.

A sketch brackets each wanted rank, one counting pass checks the brackets, and only the values inside a bracket (a few
in ten thousand) are ordered, after equal values have been counted. The columns travel as one array and are taken apart
only where they are counted, so the plan is the same for any number of columns. Brackets are one row per key, repeated for
``SALTS`` buckets of its rows, so that the rows of a large key meet them in as many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEYS
from .layout import join_rows

_ACCURACY = 10_000
_MARGIN = 3.0 / _ACCURACY
SALTS = 32


def quantiles(df: DataFrame, cols, probs, keys=KEYS, also=None) -> DataFrame:
    """(key, feature, prob, value), linear between neighbouring ranks; reads ``df`` three times.

    ``also`` names further aggregates of a column (functions of its name) to return beside it.
    """
    cols, probs, also, keys = list(cols), [float(p) for p in probs], dict(also or {}), list(keys)
    ends = [e for p in probs for e in (max(p - _MARGIN, 0.0), min(p + _MARGIN, 1.0))]
    values = df.select(*keys, F.array(*[F.col(c).cast("double") for c in cols]).alias("_values"))
    each = values.select(*keys, F.posexplode("_values").alias("_i", "_x"))
    sketches = each.groupBy(*keys, "_i").agg(
        F.percentile_approx("_x", ends, _ACCURACY).alias("_ends"), F.count("_x").alias("_n"), *[f("_x").alias(name) for name, f in also.items()]
    )

    # every value beside the brackets of its column: below the lower end, up to the upper one
    met = _meet(values, sketches, "_ends", keys)
    class_of = F.transform(F.sequence(F.lit(0), F.lit(len(probs) - 1)), lambda j: F.struct((F.col("_x") < F.get("_b", 2 * j)).alias("below"), (F.col("_x") <= F.get("_b", 2 * j + 1)).alias("upto")))
    judged = met.where("_x is not null").select(*keys, "_i", class_of.alias("_c"))
    counted = judged.groupBy(*keys, "_i").agg(*[F.count_if(F.col("_c")[j][side]).alias(f"_{side}_{j}") for j in range(len(probs)) for side in ("below", "upto")])

    def bracket(j: int) -> Column:
        n, below = F.col("_n"), F.coalesce(F.col(f"_below_{j}"), F.lit(0))
        rank = F.lit(probs[j]) * (n - 1)
        low, high = F.floor(rank), F.least(F.floor(rank) + 1, n - 1)
        # the sketch errs by n / 10,000 ranks and the margin is three times that, so only a key of a few
        # thousand values, where a margin is less than a rank, can miss; then all of its values take part
        held = (below <= low) & (F.col(f"_upto_{j}") > high)
        return F.struct(
            F.lit(probs[j]).alias("prob"),
            F.when(held, F.col("_ends")[2 * j]).otherwise(F.lit(float("-inf"))).alias("lo"),
            F.when(held, F.col("_ends")[2 * j + 1]).otherwise(F.lit(float("inf"))).alias("hi"),
            F.when(held, below).otherwise(F.lit(0)).alias("below"),
            low.alias("low"),
            high.alias("high"),
            (rank - low).alias("part"),
        )

    brackets = join_rows(sketches, counted, [*keys, "_i"]).select(*keys, "_i", *also, F.array(*[bracket(j) for j in range(len(probs))]).alias("_ranges"))
    inside = F.filter(F.transform("_b", lambda b: F.when((F.col("_x") >= b["lo"]) & (F.col("_x") <= b["hi"]), b["prob"])), lambda p: p.isNotNull())
    by = [*keys, "_i", "prob"]
    found = _meet(values, brackets, "_ranges", keys).select(*keys, "_i", "_x", F.explode(inside).alias("prob")).groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("times"))
    upwards = Window.partitionBy(*by).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    rows = brackets.select(*keys, "_i", *also, F.explode("_ranges").alias("b")).select(*keys, "_i", *also, "b.*")
    placed = join_rows(found.withColumn("_upto", F.sum("times").over(upwards)), rows.select(*by, "below", "low", "high"), by)
    placed = placed.withColumn("after", F.col("below") + F.col("_upto"))
    first = F.col("after") - F.col("times")

    def at(rank):
        return F.max(F.when((first <= rank) & (rank < F.col("after")), F.col("_x")))

    ordered = placed.groupBy(*by).agg(at(F.col("low")).alias("_low"), at(F.col("high")).alias("_high"))
    # weights, not a step from the lower to the upper value: infinite values, which logarithms of 0 are, have no difference
    between = F.col("_low") * (F.lit(1.0) - F.col("part")) + F.col("_high") * F.col("part")
    value = F.when(F.col("part") == 0, F.col("_low")).otherwise(between)
    feature = F.array(*[F.lit(c) for c in cols])[F.col("_i")].alias("feature")
    return join_rows(rows.select(*by, "part", *also), ordered, by).select(*keys, feature, "prob", *also, value.alias("value"))


def _meet(values: DataFrame, per_column: DataFrame, what: str, keys) -> DataFrame:
    """(key, _i, _x, _b): every value beside what its key has for its column; rows meet by (key, salt)."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("_i", what))), lambda x: x[what]).alias("_all")
    salted = per_column.groupBy(*keys).agg(in_order).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = join_rows(values.withColumn("_salt", F.pmod(F.xxhash64("_values"), F.lit(SALTS)).cast("int")), salted, [*keys, "_salt"])
    pairs = F.arrays_zip(F.col("_values").alias("x"), F.col("_all").alias("b"))
    return met.select(*keys, F.posexplode(pairs).alias("_i", "_p")).select(*keys, "_i", F.col("_p.x").alias("_x"), F.col("_p.b").alias("_b"))
