"""Centroid clustering of whole-number vectors, with expressions of the JVM alone.

The vectors are written once as arrays of longs. A round is one pass over them: ``zip_with`` and ``aggregate`` give the
squared distance to each centroid, a literal array in the plan; ``array_min`` of structs (distance, number) chooses the
nearest, the smaller number where distances are equal; and one hash aggregate sums every component by cluster, a
row a cluster and task before the exchange. Only the centroids and those sums, ``k`` rows, meet the driver, which divides
them exactly. A round that moves no centroid is the last one that needs work: all later ones would repeat it.

Defined cases: a vector that is null, has another length than ``width``, or holds a null or a component that is not
finite takes no part; nor does one with a scaled component beyond ``LARGEST``, as its distance is no long. Rows without an id are
clustered and never start a centroid. A repeated id keeps its rows; as a start the smaller vector goes first, and equal
rows start as many centroids as they are (of which the later ones then stay where they began). With fewer starts than ``k`` there
are as many centroids; a table without any gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import kept

#: The squared distance of two vectors of 64 components within this bound is a long.
LARGEST = 1 << 27


class Clusters(NamedTuple):
    rows: DataFrame  # vec_id, cluster, distance
    centroids: list[list[int]]
    inertia: list[int]  # by cluster


def whole_vectors(vectors: DataFrame, width: int, scale: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v, floor(scale * x) of every component, of the vectors that take part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & (F.abs(c * scale) <= float(LARGEST)))  # a NaN is larger than any number
    return rows.where((F.size("x") == width) & fine).select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors whose ids have the ``k`` smallest hashes, in the order of those."""
    hashed = vectors.where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    return [list(r.v) for r in hashed.orderBy("h", "v").limit(k).select("v").collect()]


def _array(numbers: list[int]) -> str:
    return "array(" + ", ".join(f"{x}L" for x in numbers) + ")"


def nearest(centroids: list[list[int]], v: str = "v") -> Column:
    """A struct of ``distance`` and ``cluster`` of the nearest centroid."""
    each = ", ".join(
        f"named_struct('distance', aggregate(zip_with({v}, {_array(c)}, (x, y) -> (x - y) * (x - y)), 0L, (s, d) -> s + d), 'cluster', {number})"
        for number, c in enumerate(centroids)
    )
    return F.expr(f"array_min(array({each}))")


def fit(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, width: int = 64, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> Clusters:
    """``rounds`` rounds of assigning and moving, then every vector's cluster and distance."""
    whole = kept(whole_vectors(vectors, width, scale, vec_id, embedding), "vectors")
    centroids = first_centroids(whole, k, seed)
    if not centroids:
        return Clusters(whole.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), [], [])
    parts = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(width)]
    for _ in range(rounds):
        near = whole.select("v", nearest(centroids)["cluster"].alias("cluster"))
        sums = near.groupBy("cluster").agg(F.count("*").alias("n"), *parts).collect()  # a row a cluster
        moved = list(centroids)
        for r in sums:
            moved[r.cluster] = [r[f"s{i}"] // r.n for i in range(width)]
        if moved == centroids:
            break
        centroids = moved
    rows = whole.select("vec_id", nearest(centroids).alias("near")).select("vec_id", "near.cluster", "near.distance")
    rows = kept(rows, "clusters")
    inertia = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    return Clusters(rows, centroids, [inertia.get(c, 0) for c in range(len(centroids))])


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def described(found: Clusters) -> DataFrame:
    """The rows with ``cluster_inertia``, ``inertia`` (null beyond a long) and ``centroid_sha256``."""
    long = lambda x: F.lit(x if x < 1 << 63 else None).cast("long")
    own = F.get(F.array(*[long(x) for x in found.inertia]), F.col("cluster")) if found.inertia else long(0)
    hashed = F.get(F.array(*[F.lit(digest(c)) for c in found.centroids]), F.col("cluster")) if found.centroids else F.lit("")
    return found.rows.select("*", own.alias("cluster_inertia"), long(sum(found.inertia)).alias("inertia"), hashed.alias("centroid_sha256"))
