import zlib
from dataclasses import fields

import numpy as np
import pytest

from barloom.llm import quality
from barloom.llm.queries import QUERIES
from barloom.llm.quality import FEATURES, Weights, encode, fit, forward, gradient, pooled, score

FOLDER = "/root/testdata/sf0.01"


def test_gradient():
    rng = np.random.default_rng(0)
    w = Weights(rng.normal(0, 0.3, (FEATURES, 4)), rng.normal(0, 0.1, 4), rng.normal(0, 1, (4, 3)), rng.normal(0, 1, (4, 3)), rng.normal(0, 1, 3), rng.normal(0, 1, 4), np.zeros(1))
    x, first, y, importance = rng.random((7, FEATURES)), np.array([0, 3, 4]), np.array([1.0, 0, 1]), np.array([1.0, 2, 1])

    def loss():
        p = forward(w, x, first)["score"]
        return -(importance * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / importance.sum()

    g = gradient(w, x, first, y, importance)
    for f in fields(Weights):
        a = getattr(w, f.name)
        at = tuple(0 for _ in a.shape)
        old = a[at]
        a[at] = old + 1e-5
        up = loss()
        a[at] = old - 1e-5
        down = loss()
        a[at] = old
        assert getattr(g, f.name)[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


def test_every_passage_is_encoded():
    x = encode("good words here. " * 500 + "### *** " * 200)
    assert len(x) == -(-1900 // 160)
    assert not np.allclose(x[0], x[-1])
    assert encode("").shape == (1, FEATURES) and encode(" \n ").shape == (1, FEATURES)
    assert encode("é" * 5000).shape == (1, FEATURES)


def test_no_passage_is_left_out_of_learning(spark, monkeypatch):
    x = encode("good words here. " * 500 + "### *** " * 200)
    assert pooled(x, 128) is x
    for most in (1, 2, 5, 11, 12):
        runs = np.array_split(np.arange(len(x)), most)
        got = pooled(x, most)
        assert len(got) == most
        # runs are as even as can be, and all passages have a part in them
        sizes = np.diff(np.append(np.arange(most) * len(x) // most, len(x)))
        assert max(sizes) - min(sizes) <= 1 and sorted(sizes) == sorted(map(len, runs))
        np.testing.assert_allclose((got * sizes[:, None]).sum(0), x.sum(0), rtol=1e-4, atol=1e-4)
    texts = ["fine words. " * n for n in (5, 900, 30000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda bags, y, epochs: seen.extend(map(len, bags)) or 0.5)
    fit(docs, labels)
    assert set(seen) == {1, 12, 128}  # 375 passages in 128 runs


def test_texts_of_one_id(spark, monkeypatch):
    rows = [(1, "b ### b"), (1, "a words."), (1, None), (3, "x"), (2, "y")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    for order in (rows, rows[::-1]):
        seen = []
        monkeypatch.setattr(quality, "train", lambda bags, y, epochs, s=seen: s.extend(b.tobytes() for b in bags) or 0.5)
        fit(spark.createDataFrame(order, "doc_id long, text string"), labels)
        assert len(seen) == 3 - sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in (1, 2, 3))
        assert encode("").astype(np.float16).tobytes() in seen  # the null text is the empty one, first in order


def test_held_out_accuracy(spark):
    got = QUERIES["op1_attention_quality"](spark, FOLDER).toPandas()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    both = got[got.held_out].merge(labels, on="doc_id")
    assert len(both) > 50
    assert ((both.score >= 0.5) == (both.quality == 1)).mean() > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "text", "y"), (1, "", "z"), (2, "word " * 5000, "w")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert fit(docs, none) == 0.5
    assert [r.score for r in score(docs, 0.5).collect()] == [0.5] * 4
    assert fit(docs, spark.createDataFrame([(2, 1), (1, None), (None, 0)], "doc_id long, quality int")) in (1.0, 0.5)
    assert score(docs.limit(0), 0.5).count() == 0
    kept = score(docs, 0.25, keep=("doc_id", "text", "score"), name="p")
    assert kept.columns == ["doc_id", "text", "score", "p"] and kept.count() == 4


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    labels = spark.createDataFrame([(i, int(i % 2)) for i in out], "doc_id long, quality int")
    assert fit(docs, labels) == 0.5


def test_the_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "fine words. " * 40 if i % 2 else "### ### ***" * 40) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda bags, y, epochs: seen.append((len(bags), max(map(len, bags)))) or 0.5)
    fit(docs, labels, max_docs=50, max_passages=2)
    assert seen[0][0] == 50 and seen[0][1] <= 2


def test_a_kept_text_is_sent_once(spark):
    docs = spark.createDataFrame([(1, "some words", "en"), (2, None, "en"), (3, "", "de")], "doc_id long, text string, lang string")
    weights = quality.train([quality.encode("some words"), quality.encode("")], np.array([1.0, 0.0]), epochs=2)
    scored = quality.score(docs, weights, keep=tuple(docs.columns), name="s")
    assert "coalesce" not in scored._jdf.queryExecution().analyzed().toString().lower()
    plain = {r.doc_id: r.score for r in quality.score(docs, weights).collect()}
    assert sorted(map(tuple, scored.collect())) == [(1, "some words", "en", plain[1]), (2, None, "en", plain[2]), (3, "", "de", plain[3])]
    # a text of another kind is still cast
    odd = spark.createDataFrame([(1, 5)], "doc_id long, text int")
    assert quality.score(odd, weights, keep=("text",), name="s").first().text == 5
