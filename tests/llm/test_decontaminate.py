import random

import pytest

from barloom.llm.common import few
from barloom.llm.decontaminate import BLOCK, RADIUS, _errors, clean, contaminated


def words(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)}).split()


def shingles(w, size=5):
    return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def brute(docs, items, least=0.8):
    """Every window of an item's length, clipped to the document, that has one of its shingles, or its few words, where an item of that length has it."""
    weight = lambda s: sum(map(len, s))
    out, stand = {}, {}
    for _, item in items:
        v = words(item)
        for q in range(max(1, len(v) - 4) if v else 0):
            stand.setdefault(len(v), set()).add((q, tuple(v[q : q + 5])))
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            best = None
            for at in range(1 - len(v), len(w) if v else 0):
                if not any(at + q >= 0 and tuple(w[at + q : at + q + len(s)]) == s for q, s in stand[len(v)]):
                    continue
                held = w[max(0, at) : at + len(v)]
                a, b = shingles(held), shingles(v)
                s = round(weight(a & b) / weight(a | b), 6)
                if s >= least and (best is None or s > best[0]):
                    best = (s, max(0, at), len(held))
            if best:
                out[d, i] = best
    return out


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 60)))) for i in range(25)] + [(90, "two words"), (91, ""), (92, None), (93, "one"), (94, "a b c d e"), (2, items_two := "the same item again with other words in it")]
    docs = [(0, None), (1, ""), (2, "two words"), (3, "one TWO  Words three"), (4, "xx one yy"), (5, "zz a b\nc d E ff")]
    for k in range(40):
        item = words(items[k % 25][1])
        if k % 4 == 1:  # an edit at the edge
            item = item[1:] + [word()]
        if k % 4 == 2:  # an edit in the middle
            item[len(item) // 2] = word()
        if k % 4 == 3:  # half of it only
            item = item[: len(item) // 2]
        docs.append((10 + k, " ".join([word() for _ in range(rng.randint(0, 80))] + item + [word() for _ in range(rng.randint(0, 80))])))
    return docs + [(60, docs[6][1]), (61, items_two.upper())], items


def test_against_brute_force(spark):
    docs, items = corpus()
    want = brute(docs, items)
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, similarity int")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in contaminated(frame, bench).collect()}
    assert got == want and len(want) > 15
    left = clean(frame, bench)
    assert left.columns == frame.columns
    assert {r.doc_id for r in left.collect()} == {i for i, _ in docs} - {d for d, _ in want}


@pytest.mark.parametrize("empty", ["docs", "items"])
def test_empty(spark, empty):
    docs = spark.createDataFrame([(1, "some text is here to stay")], "doc_id long, text string").limit(int(empty != "docs"))
    items = spark.createDataFrame([(1, "some text is here to stay")], "item_id long, text string").limit(int(empty != "items"))
    assert contaminated(docs, items).count() == 0
    assert clean(docs, items).count() == docs.count()


def test_rows_without_id_and_repeated(spark):
    docs = spark.createDataFrame([(None, "some text is here to stay"), (4, "some text is here to stay"), (4, "some text is here to stay")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "some text is here to stay")], "item_id long, text string")
    assert [r.similarity for r in contaminated(docs, items).collect()] == [1.0] * 3


def test_blocks_guarantee_the_radius():
    rng = random.Random(0)
    masks = set(_errors(RADIUS))
    for _ in range(200):
        errors = rng.sample(range(64), RADIUS)
        blocks = [sum(1 << (e % BLOCK) for e in errors if e // BLOCK == k) for k in range(64 // BLOCK)]
        assert any(b in masks for b in blocks)


def test_windows_are_clipped_to_the_document(spark):
    """Every window and every clipped one by brute force, without a condition on where its shingles stand."""
    weight = lambda s: sum(map(len, s))
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 60)))) for i in range(20)]
    docs, more = [], lambda: [word() for _ in range(30)]
    for _, text in items:
        v = words(text)
        middle = v[: len(v) // 2] + v[len(v) // 2 + 1 :]
        docs += [v[1:], v[:-1], v[1:] + more(), more() + v[:-1], v[1:-1], middle, middle + more(), more() + middle, v[: len(v) // 2]]
    want = set()
    for d, w in enumerate(docs):
        for i, text in items:
            v = words(text)
            b = shingles(v)
            for at in range(1 - len(v), len(w)):
                a = shingles(w[max(0, at) : at + len(v)])
                if a & b and round(weight(a & b) / weight(a | b), 6) >= 0.8:
                    want.add((d, i))
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = contaminated(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want
    assert {d for d, _ in want} >= {d for d in range(len(docs)) if d % 9 < 4}
    for r in rows:
        assert 0 <= r.start_word and r.start_word + r.n_words <= len(docs[r.doc_id])
    assert {r.doc_id for r in clean(frame, bench).collect()} == set(range(len(docs))) - {d for d, _ in want}


def test_what_is_sent_to_every_executor_is_counted_by_its_entries(spark):
    rows = spark.createDataFrame([(1, [1] * 50), (2, []), (3, None)], "id long, windows array<int>")
    hinted = lambda df: "Broadcast" in df._jdf.queryExecution().optimizedPlan().toString() or "broadcast" in df._jdf.queryExecution().optimizedPlan().toString()
    other = spark.range(10)
    assert hinted(other.join(few(rows, 52, "windows"), "id")) and not hinted(other.join(few(rows, 51, "windows"), "id"))
    assert few(rows.limit(0), 5, "windows").count() == 0


def test_a_phrase_that_all_items_share(spark):
    phrase = "which of the following is the right"
    items = [(i, f"item{i} a{i} b{i} {phrase} c{i} d{i} e{i} f{i} g{i}") for i in range(40)]
    texts = [(i, f"x{i} " * 30 + phrase + f" y{i}" * 30) for i in range(20)] + [(100, f"x y z {items[7][1]} and more")]
    got = contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(100, 7)]
