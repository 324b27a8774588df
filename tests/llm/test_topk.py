import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm.topk import best, search, statistics


def brute(rows, k):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in fine:
        if q % 5 == 0:
            found = [(-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in fine if c != q and len(a) == len(b)]
            out[q] = [(c, -s) for s, c in sorted(found)[:k]]
    return out


@pytest.mark.parametrize("blocks", [(2048, 4096), (3, 20)])
def test_against_brute_force(spark, blocks):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 20)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 340)]  # ties
    rows += [(400, None), (405, [1.0, None]), (410, [float("nan")] * 20), (415, [float("inf")] * 20), (420, []), (425, [1.0, 2.0]), (426, [3.0, -2.0]), (None, rows[0][1]), (430, [0.0] * 20)]
    rows += [(435, [1e6 * x for x in rows[3][1]])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")
    as_float = [(i, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None) for i, v in rows]
    want = brute(as_float, 10)
    got = search(df, F.col("vec_id") % 5 == 0, 10, query_rows=blocks[0], rows=blocks[1]).toPandas()
    found = {q: [(int(r.vec_id), int(r.score)) for r in own.sort_values("rank").itertuples()] for q, own in got.groupby("query_id")}
    assert found == {q: v for q, v in want.items() if v}


def test_fewer_than_k_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in search(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 512 * 1024)]
    assert search(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert search(df, F.col("vec_id") == 5).count() == 0


@pytest.mark.parametrize("segments", [1, 4, 16])
def test_bounds_hold(segments):
    rng = np.random.default_rng(2)
    q, x = rng.normal(0, 1000, (20, 64)), rng.normal(100, 500, (50, 64))
    assert (statistics(q, segments) @ statistics(x, segments).T + 1e-6 >= q @ x.T).all()


def test_large_numbers_are_exact():
    big = 2**28
    q, x = np.array([[big + 1, 3]]), np.array([[big + 1, 1], [big + 1, 2], [big, 5]])
    assert best(q, np.array([9]), x, np.array([1, 2, 3]), 2) == [(9, 2, (big + 1) ** 2 + 6), (9, 1, (big + 1) ** 2 + 3)]
