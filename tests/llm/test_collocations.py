"""Collocations against a dictionary of all phrases, divided prefixes, and the defined cases."""

import random
import re
from collections import Counter

import pytest

from barloom.llm import collocations

SCHEMA = "doc_id long, lang string, text string"


def plain(rows, least, top, share=100, longest=5):
    n, f = Counter(), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + m])) for i in range(len(words)) for m in range(1, longest + 1) if i + m <= len(words))
    candidates = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    inside = {}
    for (lang, w), a in candidates.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inside[lang, w[i : i + m]] = max(a, inside.get((lang, w[i : i + m]), 0))
    out = []
    for (lang, w), a in candidates.items():
        if 100 * inside.get((lang, w), -1) >= share * a:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    out.sort()
    ranked, last, rank = [], None, 0
    for lang, score, a, phrase, left, right, total in out:
        rank = rank + 1 if lang == last else 1
        last = lang
        if rank <= top:
            ranked.append((lang, rank, phrase.decode(), -a, left, right, total, -score))
    return sorted(ranked)


def rows_of(found):
    return sorted(tuple(r) for r in found.collect())


def corpus(many=120, seed=5):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["New", "york", "É", "a\x01b", "\x02", "l'été", "x" * 300]
    rows = []
    for i in range(many):
        text = "".join(draw.choice(words if draw.random() < 0.9 else [f"rare{i}"]) + draw.choice([" "] * 8 + [". ", "\t", "\r", ",", "\x0b", "  "]) for _ in range(draw.randint(0, 60)))
        rows.append((i, draw.choice(["en", "fr", None, "en", "en", ""]), text + draw.choice(["", " New York city hall steps", "! new york City hall"])))
    return [*rows, (None, "en", None), (3, "en", ""), (3, "en", ". , ;"), (3, "de", " new york " * 40), (3, "de", " new york " * 40)]


@pytest.mark.parametrize(("least", "share", "budget"), [(8, 100, 1 << 16), (8, 60, 40), (3, 100, 7), (30, 100, 1)])
def test_against_a_dictionary(spark, least, share, budget):
    rows = corpus()
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), least=least, top=25, share=share, budget=budget)
    want = plain(rows, least, 25, share)
    assert want and rows_of(got) == want


def test_texts_longer_than_what_a_task_gathers(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 50)  # seen by the function that is sent to the workers
    rows = [(1, "en", "a b c d e f " * 400), (2, "en", "a b, " * 100), (3, "fr", "a b c " * 50)]
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA), least=40, top=100)
    assert rows_of(got) == plain(rows, 40, 100)


def test_products_beyond_64_bits(spark):
    found = spark.createDataFrame([("en", "a b", 2, 10**12), ("en", "a", 1, 3 * 10**12), ("en", "b", 1, 10**12 + 7)], "lang string, phrase string, words int, a long")
    totals = spark.createDataFrame([("en", 10**13)], "lang string, n long")
    row = collocations.scored(found, totals).first()
    assert row.score == 1000 * 10**12 * 10**13 // (3 * 10**12 * (10**12 + 7)) and (row.l, row.r) == (3 * 10**12, 10**12 + 7)


def test_empty_table_and_clashing_names(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, "en", "one two")], SCHEMA)).count() == 0
    rows = [(i, "en", "one two", "x", 1, 2) for i in range(5)]
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA + ", phrase string, n int, a int"), least=5)
    assert rows_of(got) == [("en", 1, "one two", 5, 5, 5, 10, 2000)]


def test_words_alone_are_no_leaves(spark, monkeypatch):
    sent, divided = [], collocations.divided
    monkeypatch.setattr(collocations, "divided", lambda leaves, *args: sent.extend(r.suffix for r in leaves.collect()) or divided(leaves, *args))
    rows = [(i, lang, f"apple. pear, fig {i} fig; New york {i}") for i in range(30) for lang in ("en", None)]
    found, _ = collocations.phrases(spark.createDataFrame(rows, SCHEMA).repartition(3), least=30)
    got = {(r.lang, r.phrase, r.words): r.a for r in found.collect()}
    words = {"apple": 30, "pear": 30, "fig": 60, "new": 30, "york": 30}
    assert got == {(lang, w, 1): n for lang in ("en", "und") for w, n in words.items()} | {(lang, "new york", 2): 30 for lang in ("en", "und")}
    assert set(sent) == {"new york"}


def test_few_others_are_told_to_be_frequent(spark):
    """A table that 100,000 hashes are set in holds few others: with one bit each it would be 300 in 100,000."""
    import numpy as np

    draw = np.random.default_rng(4).integers(-(2**63), 2**63, (2, 100_000), dtype=np.int64)
    table = np.frombuffer(collocations.bit_table(spark.createDataFrame([(int(h),) for h in draw[0]], "h long")), dtype=np.uint8)
    assert collocations._told(table, draw[0].view(np.uint64)).all()
    assert collocations._told(table, draw[1].view(np.uint64)).sum() < 30
    words = collocations.Words("en", table)
    told = collocations._told(table, np.array([collocations._hash("en", b"%d" % i) for i in range(3000)], dtype=np.uint64))
    assert [words[b"%d" % i] > 0 for i in range(3000)] == told.tolist()


def test_no_task_sends_pairs(spark, monkeypatch):
    """Each of many tasks has the same frequent pairs: their leaves would be pairs times tasks."""
    sent, leaves = [], collocations.leaves
    monkeypatch.setattr(collocations, "leaves", lambda *args: sent.append(leaves(*args)) or sent[0])
    rows = [(i, "en", f"new york {i}. old town {i}, big city hall {i}. big city {i}") for i in range(60)]
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(6), least=60, top=50)
    assert rows_of(got) == plain(rows, 60, 50) != []
    assert [(r.suffix, r.n) for r in sent[0].collect()] == [("big city hall", 60)]


@pytest.mark.parametrize("codes", [1, 5, 200])
@pytest.mark.parametrize("longest", [2, 5])
def test_words_that_share_a_code(spark, codes, longest):
    rows = corpus()
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), least=3, top=200, longest=longest, codes=codes)
    want = plain(rows, 3, 200, longest=longest)
    assert want and rows_of(got) == want
