"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted shingles.

A window is as many words of a document as a benchmark item has, placed so that one of its shingles stands where that
shingle stands in an item of this length. What sticks out of the document is clipped, so an item that lacks words where
the document starts or ends, or a document shorter than the item, has its window too. Windows and items get a 64-bit SimHash of their shingles. Fingerprints within ``radius`` 23 bits have, of
8 blocks of 8 bits, one that differs in 2 bits at most: items are indexed under every such variant of every block,
windows look their blocks up, and all pairs within the radius are found. A pair counts if its shingles, weighed by
their letters, have a similarity (common weight over united weight) of ``least`` or more.

DataFrame functions only. A document's windows depend on its text alone, so equal texts are looked at once.

Defined cases: A-Z count as a-z; a null, empty or blank text is never a hit, a blank item never hits; an item with fewer
words than a shingle is one shingle; repeated items and rows keep their rows; empty tables give an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import few, kept, lower_ascii, text_of, words_of

BITS, BLOCK = 64, 8
RADIUS = 23


def _hash_at(words: Column, i: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, i + k) for k in range(size)])


def _short_runs(n: int) -> Column:
    """The hashes of all runs of ``n`` words, for items too short for a shingle."""
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, n), " "), F.lit(n)))
    return F.when(F.size("w") >= n, runs)


def shingles(words: Column, size: int) -> Column:
    """The distinct shingles of a list of words; all words as one where they are too few."""
    each = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))
    return F.when(F.size(words) > size, F.array_distinct(each)).otherwise(F.array(F.array_join(words, " ")))


def _weight(of: Column) -> Column:
    return F.aggregate(of, F.lit(0).cast("long"), lambda acc, s: acc + F.length(s))


def similarity(a: Column, b: Column) -> Column:
    return F.try_divide(_weight(F.array_intersect(a, b)).cast("double"), _weight(F.array_union(a, b)).cast("double"))


def simhash(of: Column) -> Column:
    """Bit j is set where the weight of the shingles with bit j outweighs that of those without."""
    hashed = F.transform(of, lambda s: F.struct(F.xxhash64(s).alias("h"), F.length(s).alias("w")))

    def vote(j: Column) -> Column:
        return F.aggregate(hashed, F.lit(0).cast("long"), lambda acc, x: acc + x["w"] * (2 * F.call_function("shiftrightunsigned", x["h"], j).bitwiseAND(F.lit(1)) - 1))

    bits = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda j: F.when(vote(j) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(b))


def _blocks(print_: Column) -> Column:
    """(number, value) of the blocks of a fingerprint."""
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(print_, BLOCK * k).bitwiseAND(F.lit((1 << BLOCK) - 1)).cast("int").alias("value")) for k in range(BITS // BLOCK)])


def _errors(radius: int) -> list[int]:
    """All masks of a block with at most as many bits as one of the blocks may differ in."""
    return [m for m in range(1 << BLOCK) if m.bit_count() <= radius // (BITS // BLOCK)]


def matches(
    docs: DataFrame, items: DataFrame, size: int = 5, least: float = 0.8, radius: int = RADIUS, text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """address (of the text), item_id, similarity, start_word, n_words: each text's best window for each item it holds."""
    items = items.select(F.col(item_id).cast("long").alias("item_id"), words_of(lower_ascii(text_of(item_text))).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("n", F.size("w")).withColumn("shingles", shingles(F.col("w"), size)).withColumn("print", simhash(F.col("shingles")))
    items = kept(items.withColumn("item", F.monotonically_increasing_id()), "items")
    # where each shingle stands in items of each length; an item shorter than a shingle stands for itself, by its length
    places = F.when(F.col("n") >= size, F.transform(F.sequence(F.lit(0), F.col("n") - size), lambda i: F.struct(i.alias("at"), _hash_at(F.col("w"), i, size).alias("hash"))))
    lengths = [r[0] for r in items.where(F.col("n") < size).select("n").distinct().collect()]  # size - 1 numbers at most
    short = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(F.array_join("w", " "), "n").alias("hash")))
    places = kept(items.select("n", F.explode(F.coalesce(places, short)).alias("p")).select("n", "p.at", "p.hash").distinct(), "places")

    rows = docs.select(F.md5(text_of(text)).alias("address"), words_of(lower_ascii(text_of(text))).alias("w"))
    long = F.when(F.size("w") >= size, F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: _hash_at(F.col("w"), i, size)))
    runs = [rows.select("address", F.size("w").alias("words"), F.posexplode(long).alias("pos", "hash"))]
    runs += [rows.select("address", F.size("w").alias("words"), F.posexplode(_short_runs(n)).alias("pos", "hash")) for n in lengths]
    found = [r.join(few(places), "hash") for r in runs]
    windows = found[0]
    for more in found[1:]:
        windows = windows.unionByName(more)
    windows = windows.select("address", (F.col("pos") - F.col("at")).alias("start"), "n", "words")
    # n stays that of the item, held is how many words the document has there
    clipped = F.struct(F.greatest(F.lit(0), "start").alias("start"), "n", (F.least("words", F.col("start") + F.col("n")) - F.greatest(F.lit(0), "start")).alias("held"))
    windows = windows.groupBy("address").agg(F.collect_set(clipped).alias("windows"))
    windows = kept(windows, "windows")
    texts = docs.select(F.md5(text_of(text)).alias("address"), text_of(text).alias("t")).join(few(windows, entries="windows"), "address").dropDuplicates(["address"])
    texts = texts.select("address", "windows", words_of(lower_ascii(F.col("t"))).alias("w"))
    cut = texts.select("address", "w", F.explode("windows").alias("p")).select("address", "p.start", "p.n", "p.held", F.slice("w", F.col("p.start") + 1, F.col("p.held")).alias("w"))
    cut = cut.select("address", "start", "n", "held", shingles(F.col("w"), size).alias("own"))
    cut = kept(cut.withColumn("own_print", simhash(F.col("own"))), "prints")

    asked = cut.select("address", "start", "n", "held", "own_print", F.explode(_blocks(F.col("own_print"))).alias("b")).select("address", "start", "n", "held", "own_print", "b.block", "b.value")
    masks = F.array(*[F.lit(m) for m in _errors(radius)])
    index = items.select("item", "n", "print", F.explode(_blocks(F.col("print"))).alias("b"), masks.alias("m")).select("item", "n", "print", "b.block", "b.value", F.explode("m").alias("mask"))
    index = index.select("item", "n", "print", "block", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
    near = asked.join(index, (asked["n"] == index["n"]) & (asked["block"] == index["block"]) & (asked["value"] == index["value"]) & (F.bit_count(F.col("own_print").bitwiseXOR(F.col("print"))) <= radius))
    near = near.select("address", "start", asked["n"], "held", "item").distinct()
    pairs = near.join(cut.select("address", "start", "n", "held", "own"), ["address", "start", "n", "held"]).join(items.select("item", "item_id", "shingles"), "item")
    scored = pairs.select("address", "item_id", "start", "held", F.round(similarity(F.col("own"), F.col("shingles")), 6).alias("similarity")).where(F.col("similarity") >= least)
    best = scored.groupBy("address", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "held")).alias("b"))
    return best.select("address", "item_id", "b.similarity", (-F.col("b.s")).cast("long").alias("start_word"), F.col("b.held").cast("long").alias("n_words"))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words of every row that holds an item."""
    found = kept(matches(docs, items, text=text, **options), "matches")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.md5(text_of(text)).alias("address"))
    return rows.join(few(found), "address").select("doc_id", "item_id", "similarity", "start_word", "n_words")


def clean(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    found = kept(matches(docs, items, text=text, **options).select(F.col("address").alias("__address")).distinct(), "matches")
    rows = docs.withColumn("__address", F.md5(text_of(text)))
    return rows.join(few(found), "__address", "left_anti").select(docs.columns)
