"""Exact top-k by inner product with multi-resolution segment statistics.

The squared distance of two vectors is the sum of their squared lengths less twice their inner product, so a lower
bound of the distance is an upper bound of the product. Cut into segments of l components with means m and deviations
s, the product is at most the sum of l * (m * m' + s * s'). The bound is taken with 1, 4 and then 16 segments; a pair whose bound
is below the query's k-th best product so far goes; survivors are multiplied in full.

Queries and candidates are dealt by a hash into blocks of bounded size, every pair of blocks meets in one task (a
stated query set against all rows), which returns k rows a query at most; the best k of those are the result.

Defined cases: vectors that are null or hold a null or a component that is not finite take no part, nor do rows with a
null id; a query and candidates of another length, or an empty vector, do not meet; equal scores go to the smaller id;
a repeated id is a candidate as often as it is there, never for a query of its own id, and a repeated query is answered
once (by its smallest vector); empty tables give an empty result; other columns are not read. Products are exact while
they fit a long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_ROWS, ROWS = 2048, 4096
LEVELS = (1, 4, 16)
FOUND = "query_id long, vec_id long, score long"


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means, then deviations, of the segments of each row, scaled so that a product of two rows is the bound."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    sizes = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / sizes
    deviation = np.sqrt(np.add.reduceat((x - np.repeat(mean, sizes, axis=1)) ** 2, edges[:-1], axis=1) / sizes)
    return np.concatenate([mean, deviation], axis=1) * np.sqrt(np.concatenate([sizes, sizes]))


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The k best (query id, id, product) of each query among ``rows``; ints of 64 bits."""
    big = max(np.abs(queries).max(initial=0), np.abs(rows).max(initial=0))
    exact = float(big) ** 2 * rows.shape[1] < 2**53
    q, x = queries.astype(np.float64), rows.astype(np.float64)
    levels = [(statistics(q, n), statistics(x, n)) for n in LEVELS]
    coarse = levels[0][0] @ levels[0][1].T
    slack = 1 + 1e-9 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max(initial=0)  # more than rounding can take from a bound
    found = []
    for i in range(len(q)):
        def products(pick: np.ndarray, i: int = i) -> np.ndarray:
            return (x[pick] @ q[i]).astype(np.int64) if exact else (rows[pick] * queries[i]).sum(axis=1)

        live = np.flatnonzero(ids != query_ids[i])
        if len(live) > 4 * k:
            bound = coarse[i, live]
            lead = live[np.argpartition(-bound, 4 * k - 1)[: 4 * k]]
            least = np.partition(products(lead), -k)[-k]
            for level, (own, other) in enumerate(levels):
                bound = coarse[i, live] if level == 0 else other[live] @ own[i]
                live = live[bound + slack[i] >= least]
        score = products(live)
        order = np.lexsort((ids[live], -score))[:k]
        found += [(int(query_ids[i]), int(ids[live[j]]), int(score[j])) for j in order]
    return found


def whole_numbers(embedding: str, scale: int) -> Column:
    """floor(scale * x) of every component, null for a vector that takes no part."""
    v = F.col(embedding).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine, F.transform(v, lambda x: F.floor(x * scale)))


def search(
    vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding",
    query_rows: int = QUERY_ROWS, rows: int = ROWS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of every row that ``queries`` holds for."""
    whole = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), whole_numbers(embedding, scale).alias("v"), queries.alias("q"))
    whole = whole.where("v is not null and vec_id is not null").withColumn("hash", F.xxhash64("vec_id", "v"))
    asked = whole.where("q").groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("hash", F.xxhash64("vec_id", "v"))
    counted = whole.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    across, down = max(1, -(-counted[0] // rows)), max(1, -(-counted[1] // query_rows))
    candidates = whole.select("vec_id", "v", F.pmod("hash", F.lit(across)).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("d"))
    wanted = asked.select("vec_id", "v", F.pmod("hash", F.lit(down)).cast("int").alias("d"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("c"))

    def meet(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        found = []
        for n in set(asked["v"].map(len)) & set(there["v"].map(len)):
            own, other = asked[asked["v"].map(len) == n], there[there["v"].map(len) == n]
            found += best(np.stack(own["v"]).astype(np.int64), own["vec_id"].to_numpy(), np.stack(other["v"]).astype(np.int64), other["vec_id"].to_numpy(), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    near = wanted.groupBy("c", "d").cogroup(candidates.groupBy("c", "d")).applyInPandas(meet, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
