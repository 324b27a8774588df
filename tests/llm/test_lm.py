import zlib
from collections import Counter

import numpy as np
import pytest

from barloom.llm import lm

TEXTS = ["the cat sat on the mat " * 30, "a dog ran in the park " * 30, None, "", "the cat", "x" * 100 + " the", "the cat sat on the mat " * 30]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "the cat", 1)], "doc_id long, text string, n_tokens int").repartition(3)


def test_counts(docs):
    want = Counter(w for t in [*TEXTS, "the cat"] for w in (t or "").encode().split() if len(w) <= lm.LONGEST)
    assert {bytes(r.word): r.n for r in lm.count_words(docs).collect()} == want


def test_gradient():
    w = {k: v.astype(np.float64) for k, v in lm.first_weights(64, 4).items()}
    flat, _ = lm.lay_out([np.array([1, 40, 3, 3, 63], dtype=np.int32), np.array([5, 6], dtype=np.int32)], 64)
    at = np.flatnonzero(flat != 64)
    g = lm.gradient(w, flat, at)
    for name, a in w.items():
        for index in (0, a.size // 2, a.size - 1):
            i = np.unravel_index(index, a.shape)
            old = a[i]
            a[i] = old + 1e-5
            up = -lm.log_probabilities(w, flat, at).mean()
            a[i] = old - 1e-5
            down = -lm.log_probabilities(w, flat, at).mean()
            a[i] = old
            assert g[name][i] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


def test_probabilities_sum_to_one():
    w = lm.first_weights(64, 4)
    total = 0
    for token in range(64):
        flat, _ = lm.lay_out([np.array([1, token, 3], dtype=np.int32)], 64)
        total += np.exp(lm.log_probabilities(w, flat, np.array([3]))[0])
    assert total == pytest.approx(1, abs=1e-5)


def test_scores(docs):
    vocabulary, w = lm.train(docs, words=20, others=4, rounds=3, mask=2)
    assert vocabulary.size == 32
    got = {r.doc_id: r for r in lm.score(docs, vocabulary, w, slice_tokens=50).collect()}
    whole = {r.doc_id: r for r in lm.score(docs, vocabulary, w).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i].n_tokens == len((text or "").split())
        assert got[i].log_likelihood == pytest.approx(whole[i].log_likelihood, rel=1e-5)
    assert got[2].log_likelihood == 0 and got[2].mean_log_likelihood is None
    assert got[0].log_likelihood == pytest.approx(got[6].log_likelihood)
    assert got[4].log_likelihood == pytest.approx(got[None].log_likelihood)
    shuffled = docs.sparkSession.createDataFrame([(0, " ".join(np.random.default_rng(1).permutation(TEXTS[0].split())))], "doc_id long, text string")
    assert lm.score(shuffled, vocabulary, w).first().mean_log_likelihood < got[0].mean_log_likelihood - 0.1


def test_training_lowers_the_loss():
    rng = np.random.default_rng(0)
    texts = [np.repeat(rng.integers(0, 32, 50), 3).astype(np.int32) for _ in range(40)]
    w = lm.first_weights(64, 8)
    flat, _ = lm.lay_out(texts, 64)
    at = np.flatnonzero(flat != 64)
    after, n = lm.learn(w, iter(texts), 0, 2, batch=256)
    assert n == pytest.approx(len(at) / 2, rel=0.2)
    assert lm.log_probabilities(after, flat, at).mean() > lm.log_probabilities(w, flat, at).mean() + 0.3


def test_no_corpus(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    vocabulary, w = lm.train(none)
    assert lm.score(none, vocabulary, w).count() == 0
    assert lm.pack_weights(lm.unpack_weights(lm.pack_weights(w), w)) == lm.pack_weights(w)


def test_weights_of_parts_are_averaged_by_tokens(spark):
    rows = [(i, n, np.full(3, v, dtype=np.float32).tobytes()) for i, n, v in [(0, 1, 1.0), (70, 3, 5.0), (5000, 4, 2.0)]]
    data, n = lm._mean(spark.createDataFrame(rows, "part long, n long, weights binary"))
    assert n == 8 and np.frombuffer(data, dtype=np.float32) == pytest.approx([3.0, 3.0, 3.0])


def test_every_position_is_learned_from_once(monkeypatch):
    """Also those of a text shorter than the mask."""
    texts = [np.arange(n, dtype=np.int32) % 60 for n in (1, 3, 2, 40, 1000, 5)]
    seen = Counter()
    whole = lm.gradient
    monkeypatch.setattr(lm, "gradient", lambda w, flat, at: (seen.update(at.tolist()), whole(w, flat, at))[1])
    for turn in range(2):
        lm.learn(lm.first_weights(64, 4), iter(texts), lm.residues(turn, 2, 8), 8)
    flat, _ = lm.lay_out(texts, 64)
    assert seen == Counter(np.flatnonzero(flat != 64).tolist())
    assert [lm.residues(t, 3, 2) for t in range(3)] == [[0], [1], [0]]


def test_training_covers_the_corpus(docs, monkeypatch):
    """By the defaults, over all rounds."""
    total, whole = [], lm._mean
    monkeypatch.setattr(lm, "_mean", lambda rows, many: (total.append((found := whole(rows, many))[1]), found)[1])
    lm.train(docs)
    assert sum(total) == sum(len((t or "").split()) for t in [*TEXTS, "the cat"])


def test_the_vocabulary_grows_with_the_corpus(docs):
    seen = {b"the", b"cat", b"sat", b"on", b"mat", b"a", b"dog", b"ran", b"in", b"park"}
    assert set(lm.count(docs, 2, 4, 30)) == seen
    vocabulary = lm.count(docs, 2, 4, 100)
    assert set(list(vocabulary)[: vocabulary.first]) == {b"the", b"cat"}
    assert vocabulary.sent == {w: 60 if w in (b"sat", b"on", b"mat") else 30 for w in seen - {b"the", b"cat"}}
    assert sum(n for n, _ in vocabulary.totals) == 3 * 60 + 5 * 30 and sum(t for _, t in vocabulary.totals) == 8


@pytest.mark.parametrize("often", [100, 10_000])
def test_words_of_a_bucket_by_their_counts(spark, docs, often):
    """Of the same bucket, whether counts are sent along or joined; words never counted are spelled, long ones too."""
    vocabulary, w = lm.train(docs, words=2, others=1, often=often)
    texts = ["cat mat", "cat dog", "cat zebra", "cat " + "y" * 80, "cat mat mat"]
    got = [r.log_likelihood for r in lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), vocabulary, w).orderBy("doc_id").collect()]
    n, t = 3 * 60 + 5 * 30, 8
    assert vocabulary.totals == [(n, t)]
    assert got[0] - got[1] == pytest.approx(np.log(60 / 30), abs=1e-5)
    assert got[1] - got[2] == pytest.approx(np.log(30 / (t + 1)) + 6 * np.log(257), abs=1e-4)
    assert got[2] - got[3] == pytest.approx(75 * np.log(257), abs=1e-3)
    flat, _ = lm.lay_out([vocabulary.tokens(texts[4])], vocabulary.size)
    assert got[4] == pytest.approx(lm.log_probabilities(w, flat, np.arange(2, 5)).sum() + 2 * np.log(60 / (n + t + 1)), abs=1e-4)


def test_garbage_is_less_likely_than_text(spark, docs):
    vocabulary, w = lm.train(docs)
    rows = [(0, TEXTS[0]), (1, " ".join(f"q{i}zx" for i in range(180)))]
    got = [r.mean_log_likelihood for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary, w).orderBy("doc_id").collect()]
    assert got[1] < got[0] - 5


def _plain(words, w, vocabulary, counts, end, size):
    """The log-likelihood of a text, word by word."""
    own = list(vocabulary)[: vocabulary.first]
    token = lambda x: own.index(x) if x in own else vocabulary.first + zlib.crc32(x) % vocabulary.others
    log_softmax = lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
    total = 0.0
    for i, x in enumerate(words):
        near = [w["embedding"][token(words[i + s]) if 0 <= i + s < len(words) else end] for s in lm.SIDES]
        h = np.tanh(sum(e.astype(float) * w["side"][j] for j, e in enumerate(near)) + w["bias"])
        c, p = divmod(token(x), lm.wide_of(size))
        total += log_softmax(h @ w["cls"] + w["cls_bias"])[c] + log_softmax(h @ w["place"][c] + w["place_bias"][c])[p]
        if x not in own:
            same = [n for y, n in counts.items() if y not in own and zlib.crc32(y) % vocabulary.others == zlib.crc32(x) % vocabulary.others]
            n, t = sum(same), len(same)
            total += np.log(counts[x] / (n + t + 1)) if counts[x] else np.log((t + 1) / (n + t + 1)) - (len(x) + 1) * np.log(257)
    return total


@pytest.mark.parametrize("positions", [1, 100, 1 << 20])
def test_scores_are_those_of_a_plain_computation(docs, monkeypatch, positions):
    """However many documents share a chunk, and with words that are sent, looked up, own or too long."""
    monkeypatch.setattr(lm, "POSITIONS", positions)
    vocabulary, w = lm.train(docs, words=2, others=2, often=400)
    assert set(vocabulary.sent) == {b"sat", b"on", b"mat"} | {b"cat"} - set(list(vocabulary)[: vocabulary.first])
    counts = Counter(x for t in [*TEXTS, "the cat"] for x in (t or "").encode().split() if len(x) <= lm.LONGEST)
    got = {r.doc_id: r.log_likelihood for r in lm.score(docs, vocabulary, w).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == pytest.approx(_plain((text or "").encode().split(), w, vocabulary, counts, vocabulary.size, vocabulary.size), rel=1e-4, abs=1e-4)


def test_large_weights_do_not_overflow():
    w = {k: v * 1000 for k, v in lm.first_weights(64, 4).items()}
    flat, _ = lm.lay_out([np.arange(64, dtype=np.int32)], 64)
    at = np.flatnonzero(flat != 64)
    assert np.isfinite(lm.log_probabilities(w, flat, at)).all()
    assert all(np.isfinite(g).all() for g in lm.gradient(w, flat, at).values())


def test_one_pass_over_the_texts_gives_the_same(spark):
    """One share to learn from, in one order."""
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    vocabulary, w = lm.train(docs)
    want = {r.doc_id: r for r in lm.score(docs, vocabulary, w).collect()}
    got = {r.doc_id: r for r in lm.train_and_score(docs).collect()}
    assert got.keys() == want.keys()
    assert all(got[k].n_tokens == want[k].n_tokens and got[k].log_likelihood == pytest.approx(want[k].log_likelihood, rel=1e-5) for k in want)
