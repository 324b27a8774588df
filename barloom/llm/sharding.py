"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A key takes the shard of the next virtual node clockwise; a full shard passes it on to the next node, and so on. With
``slack`` 0 the bounds are the exact shares, so the counts of any two shards differ by one at most; with more slack
fewer keys move when a shard is added.

Which key overflows whereto depends on counts only: the keys of an arc (the stretch of the ring before one node) are
counted, the counts of the ``shards * nodes`` arcs (a number fixed by the parameters, not by the data) are moved
round the ring on the driver, and each key finds its shard from its rank in its arc. Ranks come from counts of small
buckets and a window inside each, so no arc is sorted as a whole and no text is shuffled.

Defined cases: a null text has no bytes and the checksum of an empty one; null and repeated ids are keys like any
other, spread by size and checksum; rows equal in all of these are interchangeable; an empty table gives no rows;
columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import text_of

NODES = 64
#: The ring has 2**32 places; a cell of it is looked up at once.
PLACES, CELLS = 1 << 32, 1 << 12
BUCKET_ROWS = 4096


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, clockwise."""
    def place(shard: int, node: int) -> int:
        return int.from_bytes(hashlib.md5(f"{shard}/{node}".encode()).digest()[:4], "big")

    return sorted((place(s, n), s) for s in range(shards) for n in range(nodes))


def bounds(total: int, shards: int, slack: float) -> list[int]:
    """The most keys that each shard takes: exact shares without slack, else (1 + slack) times the mean."""
    if slack <= 0:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [int(-(-total * (1 + slack) // shards))] * shards


def overflow(counts: Sequence[int], owners: Sequence[int], limits: Sequence[int]) -> dict[int, list[tuple[int, int, int]]]:
    """Where the keys of each arc go: for every arc (end of rank, shard, slot of the first minus its rank).

    All arcs offer to their own node first, then what was refused to the next node clockwise, until all is placed.
    """
    left, done, fill = list(counts), [0] * len(counts), [0] * len(limits)
    parts: dict[int, list[tuple[int, int, int]]] = {}
    hop, waiting = 0, [i for i, n in enumerate(counts) if n]
    while waiting:
        for i in waiting:
            shard = owners[(i + hop) % len(owners)]
            taken = min(left[i], limits[shard] - fill[shard])
            if taken:
                parts.setdefault(i, []).append((done[i] + taken, shard, fill[shard] - done[i]))
                fill[shard] += taken
                done[i] += taken
                left[i] -= taken
        waiting, hop = [i for i in waiting if left[i]], hop + 1
    return parts


def assign(docs: DataFrame, shards: int = 24, nodes: int = NODES, slack: float = 0.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8), text_crc32, shard and slot (gapless from 0 in each shard) of every row."""
    spark = docs.sparkSession
    points = ring(shards, nodes)
    places = [p for p, _ in points]
    width = PLACES // CELLS
    # a place beyond the last node belongs to the first one, as the ring closes
    cells = [(c, bisect_right(places, c * width - 1), [p for p in places[bisect_right(places, c * width - 1) : bisect_right(places, (c + 1) * width - 1)]]) for c in range(CELLS)]
    cells = spark.createDataFrame(cells, "__cell int, __before int, __in array<long>")

    def keyed(rows: DataFrame, spread: int) -> DataFrame:
        rows = rows.withColumn("__place", F.shiftrightunsigned(F.xxhash64("doc_id"), 32)).withColumn("__cell", F.floor(F.col("__place") / width).cast("int"))
        rows = rows.join(F.broadcast(cells), "__cell")  # CELLS rows, whatever the data
        arc = F.col("__before") + F.size(F.filter("__in", lambda p: p < F.col("__place")))
        bucket: Column = F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit(1)), F.lit(spread)).cast("int")
        return rows.withColumn("__arc", (arc % len(points)).cast("int")).withColumn("__bucket", bucket).drop("__cell", "__before", "__in")

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(text_of(text)) + 8).cast("long").alias("size"),
        F.crc32(text_of(text)).alias("text_crc32"),
    )
    total = docs.count()
    spread = max(1, total // (len(points) * BUCKET_ROWS))
    rows = keyed(rows, spread)
    counted = rows.groupBy("__arc", "__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__arc").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counted.select("__arc", "__bucket", F.coalesce(before, F.lit(0)).alias("__start"))
    per_arc = {r[0]: r[1] for r in counted.groupBy("__arc").agg(F.sum("__n")).collect()}  # one number per virtual node
    parts = overflow([per_arc.get(i, 0) for i in range(len(points))], [s for _, s in points], bounds(total, shards, slack))
    parts = spark.createDataFrame(list(parts.items()), "__arc int, __parts array<struct<upto: long, shard: int, shift: long>>")
    order = Window.partitionBy("__arc", "__bucket").orderBy("__place", "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("__in_bucket", F.row_number().over(order) - 1)
    if spread > 1:
        ranked = ranked.join(starts, ["__arc", "__bucket"]).withColumn("__rank", F.col("__start") + F.col("__in_bucket"))
    else:
        ranked = ranked.withColumn("__rank", F.col("__in_bucket"))
    part = F.filter("__parts", lambda p: p["upto"] > F.col("__rank"))[0]
    return ranked.join(F.broadcast(parts), "__arc").withColumn("__part", part).select(  # one row per virtual node
        "doc_id", "size", "text_crc32", F.col("__part.shard").alias("shard"), (F.col("__rank") + F.col("__part.shift")).cast("long").alias("slot")
    )
