"""Collocations by a suffix tree that is cut at a few words and built in parts, as large texts need it.

A text is cut into pieces at punctuation and line ends, pieces into words. Every word starts a suffix of at most ``longest``
words of its piece; a phrase is a path from the root, and its number of occurrences is the total of the leaves below it. Equal
suffixes of a language are one leaf with a count, added up in the task and then by hash. A suffix that ends after its first or second
word is sent by no task: it would only add to the count of that word or pair, and both are counted before. Every task has nearly all
frequent pairs, and both tasks and pairs grow with the corpus. A frequent pair is one leaf that has the count of all its places.

Pairs are counted by the codes of their words, 32 bits each. A word's code is its hash over ``codes``; words that share one, among those
that tasks take for frequent, get codes above, so that no two have the same: about m * m / 2**32 of m words, which all tasks know.

Vertical partitioning: leaves are divided by their first word; a prefix with more than ``budget`` leaves is divided by one word
more, and again, until each fits. Prefixes are dealt by a hash to groups of about ``budget`` leaves. A group is sorted by itself, and
sums over runs of equal starts, read off the sorted leaves, are the nodes of its subtrees. Only nodes above a divided
prefix have parts in several groups; those parts are added up afterwards.

A phrase that occurs ``least`` times is made of words, and of pairs of neighbours, that do. A suffix ends before a word that is not
frequent, and after the first word of a pair that is not. Both are told by a table of 2**BITS bits in which two bits of every
frequent word or pair are set, whatever the size of the corpus: another one that has both bits set only makes a suffix longer
than needed, so the result does not depend on it. With one bit such suffixes grew with the square of the corpus, as more pairs
met a fuller table. Counts of single words, and of all of a language, are over the whole
corpus.

Scores, the least over the cuts of a phrase, are whole numbers of 38 digits until they are divided.

Defined cases: a null or empty text has no words, a null language is ``und``; A-Z count as a-z; a piece may hold any
character but those it is cut at and blanks; phrases never cross a piece; equal scores go by count, then by the bytes
of the phrase; repeated rows count as often as they are there; an empty table gives an empty result; the id and other columns
are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import few, kept, text_of

LONGEST = 5
BUDGET = 1 << 18
BITS = 25
CODES = (1 << 32) - (1 << 24)  # codes that hashes give; those above are for words that share one
CHUNK = 1 << 19  # words that a task gathers before it adds up their pairs or suffixes
KNOWN = 150_000
#: Ends of pieces become line ends, a tab a blank.
TABLE = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
SUFFIX = "lang string, suffix binary, n long"


def pieces_of(data: bytes) -> list[bytes]:
    return data.lower().translate(TABLE).split(b"\n")


def _hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "replace") + b"\n" + word)


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first << np.uint64(32) | second


def _mixed(pairs: np.ndarray) -> np.ndarray:
    x = pairs * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _slabs(piece: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A long piece in parts cut at blanks, so that not all its words are in memory at once."""
    at = 0
    while at < len(piece):
        end = piece.find(b" ", at + size)
        end = len(piece) if end < 0 else end
        yield piece[at:end]
        at = end


def count_words(docs: DataFrame) -> DataFrame:
    """lang, word, n over all of ``docs`` (lang, text as bytes); a word once a task for every KNOWN of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())], names=["lang", "word", "n"])
            counts.clear()

        for batch in batches:
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for slab in _slabs(value.as_py().lower().translate(TABLE).replace(b"\n", b" ")):
                    counts.setdefault(lang, Counter()).update(slab.split())
                    if sum(map(len, counts.values())) > KNOWN:
                        yield from flush()
        yield from flush()

    return docs.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def bit_table(hashes: DataFrame) -> bytes:
    """The table with two bits of each of ``hashes`` (h), at its first and its next BITS bits; at most 2**BITS bits reach the driver, in words of 64."""
    places = F.array(F.shiftrightunsigned("h", 64 - BITS), F.shiftrightunsigned("h", 64 - 2 * BITS).bitwiseAND(F.lit((1 << BITS) - 1)))
    place = F.col("place")
    rows = hashes.select(F.explode(places).alias("place")).select((place / 64).cast("long").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("mask"))
    rows = rows.groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(1 << (BITS - 6), dtype="<i8")
    table[rows["at"].to_numpy()] = rows["mask"].to_numpy()
    return table.tobytes()


def word_hashes(words: DataFrame) -> DataFrame:
    """h of each (lang, word), as tasks compute it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.array([_hash(lang, word) for lang, word in zip(*(c.to_pylist() for c in batch.columns), strict=True)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    return words.select("lang", "word").mapInArrow(run, "h long")


def _told(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    told = np.ones(len(hashes), dtype=bool)
    for place in (hashes >> np.uint64(64 - BITS), hashes >> np.uint64(64 - 2 * BITS) & np.uint64((1 << BITS) - 1)):
        told &= (table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return told


def told_words(words: DataFrame, table: bytes, codes: int) -> DataFrame:
    """lang, word and the code that its hash gives, of those of ``words`` that tasks take for frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table, dtype=np.uint8)
        for batch in batches:
            h = np.array([_hash(lang, word) for lang, word in zip(*(c.to_pylist() for c in batch.columns), strict=True)], dtype=np.uint64)
            told = _told(bits, h)
            found = batch.filter(pa.array(told))
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array((h[told] % np.uint64(codes)).astype(np.int64))], names=["lang", "word", "code"])

    return words.select("lang", "word").mapInArrow(run, "lang string, word binary, code long")


def own_codes(told: DataFrame, codes: int) -> dict[tuple[str, bytes], int]:
    """The codes of the words that share the one of their hash with another."""
    shared = told.groupBy("code").agg(F.count("*").alias("__n")).where("__n > 1").select("code")
    rows = sorted((r.lang, bytes(r.word)) for r in told.join(shared, "code").select("lang", "word").toLocalIterator())
    if codes + len(rows) > 1 << 32:
        raise ValueError(f"{len(rows)} words share a code")
    return {word: codes + i for i, word in enumerate(rows)}


class Words(dict):
    """Word to a number from 1 on, 0 for a word that is not frequent; ``names`` and ``codes`` have those by number."""

    def __init__(self, lang: str, table: np.ndarray, own: dict[tuple[str, bytes], int] | None = None, codes: int = CODES):
        super().__init__()
        self.lang, self.table, self.own, self.of, self.names, self.codes = lang, table, own or {}, codes, [], [0]

    def __missing__(self, word: bytes) -> int:
        h, number = _hash(self.lang, word), 0
        first, second = h >> (64 - BITS), h >> (64 - 2 * BITS) & ((1 << BITS) - 1)
        if (self.table[first >> 3] >> (first & 7)) & (self.table[second >> 3] >> (second & 7)) & 1:
            self.names.append(word)
            self.codes.append(self.own.get((self.lang, word), h % self.of))
            number = len(self.names)
        self[word] = number
        return number


class Gathered:
    """The numbers of the words of a task's texts by language, 0 at ends and for words that are not frequent.

    ``flush`` is called with a language's words, their numbers and how many places at the end still lack what follows them.
    """

    def __init__(self, table: bytes, own: dict[tuple[str, bytes], int], codes: int, flush, overlap: int):
        self.words = lambda lang: Words(lang, np.frombuffer(table, dtype=np.uint8), own, codes)
        self.flush, self.overlap = flush, overlap
        self.known: dict[str, Words] = {}
        self.texts: dict[str, list[int]] = {}

    def _out(self, lang: str, keep: int = 0) -> Iterator[pa.RecordBatch]:
        words, numbers = self.known[lang], self.texts[lang]
        yield from self.flush(lang, words, np.array(numbers, dtype=np.int64), keep)
        rest = [words.names[i - 1] if i else None for i in numbers[len(numbers) - keep :]]
        if len(words) > KNOWN:
            words = self.known[lang] = self.words(lang)
        self.texts[lang] = [0 if w is None else words[w] for w in rest]

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lang not in self.known:
                    self.known[lang], self.texts[lang] = self.words(lang), []
                for piece in pieces_of(value.as_py()):
                    for slab in _slabs(piece):
                        self.texts[lang].extend(map(self.known[lang].__getitem__, slab.split()))
                        if len(self.texts[lang]) > CHUNK:
                            yield from self._out(lang, self.overlap)
                    self.texts[lang].append(0)
                if sum(map(len, self.texts.values())) > 2 * CHUNK:
                    yield from self.end()
        yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        for lang in list(self.texts):
            yield from self._out(lang)
            self.known.pop(lang), self.texts.pop(lang)


def pair_counts(docs: DataFrame, table: bytes, own: dict[tuple[str, bytes], int], codes: int) -> DataFrame:
    """pair, the codes of its words in 32 bits each, and n, its number of places, of every pair of neighbours that are both frequent."""
    def flush(lang: str, words: Words, numbers: np.ndarray, keep: int) -> Iterator[pa.RecordBatch]:
        first, second = numbers[:-1], numbers[1:]
        packed, n = np.unique((first << 21 | second)[(first > 0) & (second > 0)], return_counts=True)
        of = np.array(words.codes, dtype=np.uint64)
        pair = _pairs(of[packed >> 21], of[packed & ((1 << 21) - 1)])
        yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])

    return docs.mapInArrow(lambda batches: Gathered(table, own, codes, flush, 1).run(batches), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def pair_hashes(pairs: DataFrame) -> DataFrame:
    """h of each pair, as tasks compute it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_mixed(batch.column(0).to_numpy().view(np.uint64)).view(np.int64))], names=["h"])

    return pairs.select("pair").mapInArrow(run, "h long")


def pair_leaves(pairs: DataFrame, told: DataFrame, own: dict[tuple[str, bytes], int]) -> DataFrame:
    """lang, suffix and n of every pair, its words put back for their codes."""
    if own:
        rows = told.sparkSession.createDataFrame([(*word, code) for word, code in own.items()], "lang string, word binary, own long")
        told = told.join(few(rows), ["lang", "word"], "left").select("lang", "word", F.coalesce("own", "code").alias("code"))
    first = told.select("lang", F.col("word").alias("__first"), F.col("code").alias("__code"))
    second = told.select(F.col("word").alias("__second"), F.col("code").alias("__next"))
    found = pairs.withColumns({"__code": F.shiftrightunsigned("pair", 32), "__next": F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))})
    found = found.join(few(first), "__code").join(few(second), "__next")
    return found.select("lang", F.concat_ws(" ", F.col("__first").cast("string"), F.col("__second").cast("string")).alias("suffix"), "n")


def distinct_suffixes(numbers: np.ndarray, goes_on: np.ndarray, starts: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct suffixes of three words or more, rows of ``longest`` numbers (below 2**21) filled up with 0, of the first ``starts`` places, and how often each is there.

    ``goes_on`` tells whether a place and the next one are a pair that suffixes may hold.
    """
    padded, goes_on = np.concatenate([numbers, np.zeros(longest, dtype=np.int64)]), np.concatenate([goes_on, np.zeros(longest, dtype=bool)])
    cols = [padded[:starts]]
    for j in range(1, longest):
        cols.append(np.where((cols[-1] > 0) & goes_on[j - 1 : starts + j - 1], padded[j : starts + j], 0))
    there = cols[2] > 0 if longest > 2 else np.zeros(len(cols[0]), dtype=bool)
    cols = [c[there] for c in cols] + [np.zeros(int(there.sum()), dtype=np.int64)] * (-longest % 3)
    if not len(cols[0]):
        return np.zeros((0, longest), dtype=np.int64), np.zeros(0, dtype=np.int64)
    packed = [(cols[j] << 42) | (cols[j + 1] << 21) | cols[j + 2] for j in range(0, len(cols), 3)]
    order = np.lexsort(packed[::-1])
    packed = [x[order] for x in packed]
    first = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in packed], axis=0)]))
    return np.stack([(packed[j // 3][first] >> (42 - 21 * (j % 3))) & ((1 << 21) - 1) for j in range(longest)], axis=1), np.diff(np.append(first, len(order)))


def joined(rows: np.ndarray, names: pa.Array) -> pa.Array:
    """The words of each row, numbers from 1 on and 0 for none, with a blank between them."""
    there = rows > 0
    offsets = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
    words = names.take(pa.array(rows[there] - 1))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words), pa.scalar(b" ", pa.binary()))


def _rows(lang: str, suffix: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(n), 1 << 16):
        part = slice(low, low + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n[part]), pa.string()), suffix[part], pa.array(n[part], pa.int64())], names=["lang", "suffix", "n"])


def leaves(docs: DataFrame, table: bytes, own: dict[tuple[str, bytes], int], codes: int, pairs: bytes, longest: int) -> DataFrame:
    """lang, suffix and n, its number of places, of every distinct suffix of three words or more of ``docs`` (lang, text as bytes)."""
    def flush(lang: str, words: Words, numbers: np.ndarray, keep: int) -> Iterator[pa.RecordBatch]:
        of = np.array(words.codes, dtype=np.uint64)
        goes_on = _told(np.frombuffer(pairs, dtype=np.uint8), _mixed(_pairs(of[numbers[:-1]], of[numbers[1:]])))
        rows, n = distinct_suffixes(numbers, goes_on, len(numbers) - keep, longest)
        yield from _rows(lang, joined(rows, pa.array(words.names, pa.binary())), n)

    found = docs.mapInArrow(lambda batches: Gathered(table, own, codes, flush, longest - 1).run(batches), SUFFIX)
    return found.groupBy("lang", F.col("suffix").cast("string").alias("suffix")).agg(F.sum("n").alias("n"))


def divided(leaves: DataFrame, budget: int, longest: int) -> DataFrame:
    """``leaves`` with ``part`` (the group they are built in) and ``level``, the length of the prefix they are divided by."""
    start = lambda words: F.substring_index("suffix", " ", words)
    placed = leaves.withColumns({"prefix": start(1), "level": F.lit(1)})
    sizes = kept(placed.groupBy("lang", "prefix").agg(F.count("*").alias("__n")), "prefixes")
    groups = max(1, -(-(sizes.agg(F.sum("__n")).first()[0] or 0) // budget))
    for words in range(2, longest + 1):
        large = kept(sizes.where(F.col("__n") > budget), "prefixes")
        if not large.limit(1).count():
            break
        placed = placed.join(few(large), ["lang", "prefix"], "left")
        placed = placed.withColumns({"prefix": F.when(F.col("__n").isNull(), F.col("prefix")).otherwise(start(words)), "level": F.when(F.col("__n").isNull(), F.col("level")).otherwise(words)}).drop("__n")
        sizes = placed.where(F.col("level") == words).groupBy("lang", "prefix").agg(F.count("*").alias("__n"))
    return placed.withColumn("part", F.pmod(F.xxhash64("lang", "prefix"), F.lit(groups)).cast("int"))


def subtrees(parts: DataFrame, least: int, longest: int) -> DataFrame:
    """lang, phrase, words and a, its count, of every phrase of two words or more that is there ``least`` times, from leaves with their part.

    A leaf of two words has the count of the pair, one of more words that of its own places.
    """
    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = lambda name: table[name].chunk(0)
        lang, words = column("lang").dictionary_encode(), pc.split_pattern(column("suffix"), b" ")
        lengths, flat = pc.list_value_length(words).to_numpy(), words.flatten().dictionary_encode()
        rows = np.zeros((len(lengths), longest + 1), dtype=np.int64)
        rows[:, 0] = lang.indices.to_numpy()
        rows[:, 1:][np.arange(longest) < lengths[:, None]] = flat.indices.to_numpy() + 1
        order = np.lexsort(rows.T[::-1])
        rows, n, level = rows[order], column("n").to_numpy()[order], column("level").to_numpy()[order]
        pair = lengths[order] == 2
        other = np.concatenate([np.ones((1, longest + 1), dtype=bool), rows[1:] != rows[:-1]])
        made = []
        for depth in range(2, longest + 1):
            first = np.flatnonzero(other[:, : depth + 1].any(axis=1))
            total = np.add.reduceat(np.where(pair == (depth == 2), n, 0), first)
            whole = np.maximum.reduceat(level, first) <= depth  # else other groups have leaves of it too
            keep = (rows[first, depth] > 0) & (total > 0) & ((total >= least) | ~whole)
            at = first[keep]
            if len(at):
                phrase = joined(rows[at, 1 : depth + 1], flat.dictionary)
                made.append(pa.table({"lang": lang.dictionary.take(pa.array(rows[at, 0])), "phrase": phrase, "words": pa.array(np.full(len(at), depth, dtype=np.int32)), "a": pa.array(total[keep])}))
        empty = pa.table({"lang": pa.array([], pa.string()), "phrase": pa.array([], pa.binary()), "words": pa.array([], pa.int32()), "a": pa.array([], pa.int64())})
        return pa.concat_tables([t.cast(empty.schema) for t in made] or [empty])

    rows = parts.select("part", "lang", F.col("suffix").cast("binary").alias("suffix"), "n", "level")
    nodes = rows.groupBy("part").applyInArrow(build, "lang string, phrase binary, words int, a long")
    nodes = nodes.groupBy("lang", F.col("phrase").cast("string").alias("phrase"), "words").agg(F.sum("a").alias("a"))
    return nodes.where(F.col("a") >= least)


def phrases(docs: DataFrame, least: int = 100, longest: int = LONGEST, budget: int = BUDGET, codes: int = CODES, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """lang, phrase, words and a of every phrase that is there ``least`` times; lang and n, its number of words."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_of(text).cast("binary").alias("text"))
    counted = kept(count_words(texts), "words")
    totals, often = counted.groupBy("lang").agg(F.sum("n").alias("n")), counted.where(F.col("n") >= least)
    table = bit_table(word_hashes(often))
    told = kept(told_words(counted, table, codes), "codes")
    own = own_codes(told, codes)
    pairs = kept(pair_counts(texts, table, own, codes).where((F.col("n") >= least) & (F.lit(longest) > 1)), "pairs")
    longer = leaves(texts, table, own, codes, bit_table(pair_hashes(pairs)), longest)
    parts = divided(kept(longer.unionByName(pair_leaves(pairs, told, own)), "leaves"), budget, longest)
    alone = often.select("lang", F.col("word").cast("string").alias("phrase"), F.lit(1).alias("words"), F.col("n").alias("a"))
    return kept(alone.unionByName(subtrees(parts, least, longest)), "phrases"), totals


def scored(found: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, words, a, n and, of the cut with the lowest score, l, r and score, for every phrase of two words or more."""
    split = F.split("phrase", " ")
    cut = lambda k: F.struct(k.alias("k"), F.array_join(F.slice(split, F.lit(1), k), " ").alias("first"), F.array_join(F.slice(split, k + 1, F.col("words") - k), " ").alias("rest"))
    cuts = found.where("words > 1").select("lang", "phrase", "words", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), cut)).alias("c")).select("lang", "phrase", "words", "a", "c.*")
    count = lambda phrase, a: found.select("lang", F.col("phrase").alias(phrase), F.col("a").alias(a))
    cuts = cuts.join(count("first", "l"), ["lang", "first"]).join(count("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    big = lambda *names: " * ".join(f"cast({x} as decimal(18, 0))" for x in names)
    cuts = cuts.withColumn("score", F.expr(f"(1000 * ({big('a', 'n')})) div ({big('l', 'r')})"))
    best = cuts.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "words", "a", "n", "b.l", "b.r", "b.score")


def inside_others(found: DataFrame, share: int) -> DataFrame:
    """lang and phrase of those inside a longer one that is there ``share`` in a hundred times as often."""
    split = F.split("phrase", " ")
    at = lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda i: F.array_join(F.slice(split, i, size), " "))
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), at))
    inner = found.where("words > 2").select("lang", F.explode(F.array_distinct(parts)).alias("phrase"), "a")
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return found.join(inner, ["lang", "phrase"]).where(100 * F.col("longer") >= share * F.col("a")).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, share: int = 100, longest: int = LONGEST, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language that are in no longer one as often."""
    found, totals = phrases(docs, least, longest, **options)
    ranked = scored(found, totals).join(inside_others(found, share), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
