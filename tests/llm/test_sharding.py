import zlib

import pytest

from barloom.llm import sharding
from barloom.llm.sharding import assign, bounds, overflow, ring


def rows_of(n):
    return [(i, None if i % 17 == 0 else f"text é {i % 50}" * (i % 5), "s") for i in range(n)]


@pytest.mark.parametrize("n", [0, 5, 24, 1000])
def test_law_of_rows(spark, n):
    docs = spark.createDataFrame(rows_of(n), "doc_id long, text string, shard string")
    got = assign(docs, 24, nodes=8).toPandas()
    assert len(got) == n
    if not n:
        return
    counts = got.groupby("shard").size().reindex(range(24), fill_value=0)
    assert counts.max() - counts.min() <= 1
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    texts = {i: (t or "").encode() for i, t, _ in rows_of(n)}
    for r in got.itertuples():
        assert r.size == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id])


def test_ranks_in_buckets_are_those_of_one_sort(spark, monkeypatch):
    docs = spark.createDataFrame(rows_of(3000), "doc_id long, text string, x string")
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 8)
    got = assign(docs, 5, nodes=4).toPandas()
    assert got.groupby("shard").size().tolist() == [600] * 5
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(600))


def test_overflow_is_that_of_keys_moved_one_by_one():
    owners, counts = [0, 1, 2, 0, 1, 2], [7, 0, 1, 5, 2, 0]
    limits = bounds(15, 3, 0)
    parts = overflow(counts, owners, limits)
    free, waiting, placed, hop = list(limits), [(i, k) for i, n in enumerate(counts) for k in range(n)], {}, 0
    while waiting:
        left = []
        for i, k in waiting:
            s = owners[(i + hop) % 6]
            if free[s]:
                free[s] -= 1
                placed[i, k] = s
            else:
                left.append((i, k))
        waiting, hop = left, hop + 1
    for (i, k), s in placed.items():
        assert next(shard for upto, shard, _ in parts[i] if k < upto) == s


def test_few_keys_move_when_a_shard_comes(spark):
    docs = spark.createDataFrame(rows_of(4000), "doc_id long, text string, x string")
    before = assign(docs, 8, slack=0.25).toPandas().set_index("doc_id").shard
    after = assign(docs, 9, slack=0.25).toPandas().set_index("doc_id").shard
    assert (before != after).mean() < 0.4
    assert before.value_counts().max() <= 4000 / 8 * 1.25 + 1


def test_ids_null_and_repeated(spark):
    docs = spark.createDataFrame([(None, "a")] * 30 + [(7, "b")] * 30 + [(7, None)] * 3, "doc_id long, text string")
    got = assign(docs, 4).toPandas()
    assert len(got) == 63
    assert sorted(got.groupby("shard").size()) == [15, 16, 16, 16]
    assert all(sorted(own.slot) == list(range(len(own))) for _, own in got.groupby("shard"))


def test_ring_has_every_node():
    points = ring(24, 64)
    assert len(points) == 24 * 64 and points == sorted(points)
