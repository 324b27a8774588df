"""Line dedup against a dictionary of lines, the perfect hash by itself, and the defined cases."""

import random

import numpy as np
import pytest

from barloom.llm import lines

SCHEMA = "doc_id long, text string"


def plain(rows, enough, points=1):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    seen = {}
    for _, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    out = []
    for i, text in rows:
        split = (text or "").split("\n")
        left = [x for x in split if len(key(x)) < points or seen[key(x)] < enough]
        out.append((i, len(split), len(split) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


def rows_of(found):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found.collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"shard_keys": 16, "hot_above": 12}, {"shard_keys": 5, "hot_above": 10_000}])
def test_against_a_dictionary(spark, options):
    draw = random.Random(3)
    pool = [f"line {i} of the pool" for i in range(60)] + ["", "  ", "É é", "ÀB", "àb", "x" * 70_000]
    rows = []
    for i in range(150):
        own = [draw.choice(["", " ", "\t", "\r"]) + draw.choice([str.upper, str.lower, str])(draw.choice(pool[: 5 + i % 62])) for _ in range(draw.randint(0, 9))]
        rows.append((i, "\n".join([*own, "The common line", f"line of {i} alone"])))
    rows += [(150, None), (151, ""), (None, "The common line"), (7, "the COMMON line\nother"), (7, "the COMMON line\nother")]
    got = lines.split_texts(spark.createDataFrame(rows, SCHEMA).repartition(9), enough=10, **options)
    assert rows_of(got) == plain(rows, 10)


def test_short_keys_stay_and_numbers_above_a_byte(spark):
    rows = [(i, "é\nab\nabc") for i in range(300)]
    assert rows_of(lines.split_texts(spark.createDataFrame(rows, SCHEMA), enough=300, points=2)) == plain(rows, 300, 2)
    assert rows_of(lines.split_texts(spark.createDataFrame(rows, SCHEMA), enough=301, points=2, hot_above=5)) == plain(rows, 301, 2)


def test_empty_table_and_clashing_names(spark):
    assert lines.split_texts(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a\nb", "x", 3, 4)] * 2
    got = lines.split_texts(spark.createDataFrame(rows, SCHEMA + ", address string, found int, n_lines int"), enough=2)
    assert rows_of(got) == [(1, 2, 2, "")] * 2


def test_the_hash_is_minimal_and_perfect():
    h = np.random.default_rng(1).integers(0, 2**64, (9000, 2), dtype=np.uint64)
    n = np.arange(9000) % 300
    shard = lines.unpack(lines.build(h, n, 10).pack())
    assert len(shard.counts) == sum(int(x.sum()) for x in shard.levels) == 9000
    assert (lines.probe(shard, h) == np.minimum(n, 255)).all()
    assert len(lines.build(h, n, 10).pack()) < 9000 * 4.5
    strangers = np.random.default_rng(2).integers(0, 2**64, (9000, 2), dtype=np.uint64)
    assert (lines.probe(shard, strangers) > 0).sum() < 5
    assert not lines.probe(lines.unpack(lines.build(h, n, 10, np.uint64).pack()), strangers).any()
    assert lines.probe(lines.unpack(lines.build(h[:0], n[:0], 10).pack()), strangers).sum() == 0
