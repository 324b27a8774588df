"""Centroid clustering against a plain loop, and its defined cases."""

import hashlib
import math
import random

from barloom.llm import clusters

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k, rounds, seed, width, scale=1024):
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in whole if i is not None)[:k]
    centroids = [v for _, v in starts]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in whole:
            groups.setdefault(near(v)[1], []).append(v)
        for j, own in groups.items():
            centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted((i is None, i, near(v)[1], near(v)[0]) for i, v in whole), centroids


def rows_of(found):
    return sorted((r.vec_id is None, r.vec_id, r.cluster, r.distance) for r in found.rows.collect())


def test_against_a_plain_loop(spark):
    draw = random.Random(4)
    rows = [(i, [draw.uniform(-2, 2) + 3 * (i % 5) for _ in range(6)]) for i in range(300)]
    rows = [(i, list(map(float, spark.createDataFrame([(v,)], "v array<float>").first().v))) if i < 3 else (i, [round(x * 64) / 64 for x in v]) for i, v in rows]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = clusters.fit(docs, k=8, rounds=10, width=6)
    want, centroids = plain(rows, 8, 10, 3, 6)
    assert rows_of(found) == want
    assert found.centroids == centroids
    described = clusters.described(found).collect()
    assert {r.inertia for r in described} == {sum(x[3] for x in want)}
    for r in described:
        assert r.cluster_inertia == sum(x[3] for x in want if x[2] == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0]), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1e30, 1.0]), (8, [-0.5, 0.25]), (None, [0.5, 0.5])]
    found = clusters.fit(spark.createDataFrame(rows, SCHEMA), k=3, width=2)
    assert found.centroids == [[0, 384]]  # the row without an id is no start
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in found.rows.collect()), key=str) == [(8, 0, 512**2 + 128**2), (None, 0, 512**2 + 128**2)]


def test_ties_repeated_rows_and_empty_clusters(spark):
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [4.0, 0.0]), (3, [2.0, 0.0])]
    found = clusters.fit(spark.createDataFrame(rows, SCHEMA), k=4, rounds=10, width=2)
    want, centroids = plain(rows, 4, 10, 3, 2)
    assert rows_of(found) == want and found.centroids == centroids
    assert len({tuple(c) for c in found.centroids}) < 4  # equal starts: the later one stays empty


def test_empty_tables_and_clashing_names(spark):
    assert clusters.described(clusters.fit(spark.createDataFrame([], SCHEMA))).count() == 0
    rows = spark.createDataFrame([(1, [1.0, 2.0], 9, 9, "x")], SCHEMA + ", cluster int, distance int, v string")
    assert [r.asDict() for r in clusters.fit(rows, width=2).rows.collect()] == [{"vec_id": 1, "cluster": 0, "distance": 0}]
