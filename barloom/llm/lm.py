"""Masked pseudo-likelihood: a window network trained in numpy predicts every token from both sides.

Tokens are words. Every word found ``often`` times in the corpus, and the ``words`` most frequent ones anyway, have a
token of their own, so the vocabulary grows with the corpus; all others share ``others`` buckets by a checksum. The network
adds the embeddings of two tokens on each side (weighed by place), and predicts the token in two steps, its class and
then its place in the class; classes are about as many as their members. A word in a bucket has a third step, its share of the
bucket's words by the counts of the whole corpus: n / (N + T + 1) where it was counted n times, N and T being the words and
the distinct words of the bucket; the rest, (T + 1) / (N + T + 1), is for words never counted, spelled byte by byte at 1/257 a byte
and for the end. A document's score is the sum of the log-probabilities of its words.

Texts are split once: ``encode`` writes them as numbers with the words of each chunk of documents, and counting, every round of
training and scoring read those.

Training is by rounds. In a round every partition of the corpus starts from the same weights, learns from its share of
the ``mask`` residues of positions, one residue after the other, and returns its weights and token count; the mean over
partitions, formed in groups of 64 or fewer, starts the next round. Together the rounds predict every position once. Only the counts of
words found ``often`` / 10 times, one row a bucket and weights reach the driver; the counts of all others meet the
documents in a join, once a chunk and word, which no word that is frequent enough to be skewed enters. A partition learns from its
own share, so the same rows in other files give slightly other weights.

Defined cases: a null or empty text has no token, score 0 and a null mean; a token longer than 64 bytes is never counted,
so it is spelled; an empty corpus leaves the first weights; repeated rows are scored alike; columns other than the
id and the text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import kept, text_of
from barloom.session import fresh_path

WIDE = 32
SIDES = (-2, -1, 1, 2)
LONGEST = 64
SPELLED = math.log(257)
AVERAGED = 64 << 20
POSITIONS, DISTINCT, DOCS = 1 << 20, 200_000, 1 << 12
ROW_GROUP = 16 << 20


def encode(docs: DataFrame, doc_id: str | None = None, text: str = "text") -> DataFrame:
    """The texts as numbers, split once and written: chunks of whole documents, each with its own words.

    ``words`` are the distinct words of a chunk in the order of their numbers, between blanks; ``ids`` the numbers of all words and
    ``sizes`` the words of each document, as little-endian 32- and 64-bit integers. A chunk ends with the document that gives it
    ``POSITIONS`` words, ``DISTINCT`` distinct ones or ``DOCS`` documents. Row groups are small, as a reader holds one at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 20

        def fresh() -> tuple[defaultdict, list, list]:
            place: defaultdict = defaultdict()
            place.default_factory = place.__len__
            return place, [], []

        def row() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in ids], dtype=np.int64)
            columns = [
                pa.array([chunk], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([sizes.tobytes()], pa.binary()),
                pa.array([b" ".join(place)], pa.binary()), pa.array([np.concatenate(ids).tobytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "doc_ids", "sizes", "words", "ids"])

        place, keys, ids = fresh()
        size = 0
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = value.as_py().encode("utf-8", "replace").split()
                keys.append(key)
                ids.append(np.fromiter(map(place.__getitem__, words), dtype=np.int32, count=len(words)))
                size += len(words)
                if size >= POSITIONS or len(place) >= DISTINCT or len(keys) >= DOCS:
                    yield row()
                    place, keys, ids = fresh()
                    size, chunk = 0, chunk + 1
        if keys:
            yield row()

    key = F.lit(None) if doc_id is None else F.col(doc_id)
    rows = docs.select(key.cast("long").alias("doc_id"), text_of(text).alias("text"))
    chunks = rows.mapInArrow(run, "chunk long, doc_ids array<long>, sizes binary, words binary, ids binary")
    path = fresh_path(docs.sparkSession, "chunks")
    checks = {f"parquet.{kind}.size.row.check.min": 1 for kind in ("page", "block")}
    chunks.write.options(**checks, **{"parquet.block.size": ROW_GROUP}).parquet(path)
    return docs.sparkSession.read.schema(chunks.schema).parquet(path)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray, list[bytes], np.ndarray]]:
    """number, doc_ids, sizes, words and ids of each chunk."""
    for batch in batches:
        for i in range(len(batch)):
            chunk, keys, sizes, words, ids = (batch.column(j)[i] for j in range(5))
            blob = words.as_py()
            yield chunk.as_py(), keys.as_py(), np.frombuffer(sizes.as_py(), np.int64), blob.split(b" ") if blob else [], np.frombuffer(ids.as_py(), np.int32)


def _counted(chunks: DataFrame) -> DataFrame:
    """word and count over all chunks; a chunk sends each of its words once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, words, ids in _chunks(batches):
            times = np.bincount(ids, minlength=len(words))
            short = [i for i, x in enumerate(words) if len(x) <= LONGEST]
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in short], pa.binary()), pa.array(times[short], pa.int64())], names=["word", "n"])

    return chunks.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """word and count over all documents."""
    return _counted(encode(docs, text=text))


def wide_of(size: int) -> int:
    """The members of a class among ``size`` tokens: a power of two near the root, WIDE at least."""
    return max(WIDE, 1 << (size - 1).bit_length() // 2)


class Vocabulary(dict):
    """Word to token: the frequent words in order, then the buckets of all others.

    On the driver it also has the counts of the others: those to send along, the table of all, and (N, T) of each bucket.
    """

    def __init__(self, words: list[bytes], others: int):
        super().__init__({w: i for i, w in enumerate(words)})
        self.first, self.others = len(words), others
        self.sent: dict[bytes, int] = {}
        self.counts: DataFrame | None = None
        self.totals: list[tuple[int, int]] = [(0, 0)] * others

    def __reduce__(self):
        return Vocabulary, (list(self)[: self.first], self.others)

    @property
    def size(self) -> int:
        wide = wide_of(self.first + self.others)
        return -(-(self.first + self.others) // wide) * wide

    def tokens(self, text: str) -> np.ndarray:
        return self.of(text.encode("utf-8", "replace").split())

    def of(self, words: list[bytes]) -> np.ndarray:
        """The token of each word; a word without one of its own gets its bucket's."""
        token = np.fromiter(map(self.get, words, repeat(-1)), dtype=np.int32, count=len(words))
        other = np.flatnonzero(token < 0)
        sums = np.fromiter(map(zlib.crc32, map(words.__getitem__, other.tolist())), dtype=np.int64, count=len(other))
        token[other] = self.first + sums % self.others
        return token


def first_weights(size: int, width: int = 16, seed: int = 1) -> dict[str, np.ndarray]:
    """``size`` tokens in classes of ``wide_of(size)``; the embedding after the last is the end of a text."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    wide = wide_of(size)
    classes = -(-size // wide)
    return {
        "embedding": draw(size + 1, width), "side": np.ones((len(SIDES), width), dtype=np.float32), "bias": np.zeros(width, dtype=np.float32),
        "cls": draw(width, classes), "cls_bias": np.zeros(classes, dtype=np.float32),
        "place": draw(classes, width, wide), "place_bias": np.zeros((classes, wide), dtype=np.float32),
    }


def _small(weights: np.ndarray, bias: np.ndarray) -> bool:
    """No input within -1 to 1 gives a sum whose exponential leaves the range of a float."""
    return bool((np.abs(weights).sum(axis=-2) + np.abs(bias)).max() < 60)


def _exp(x: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """The exponentials in place, and their sum by row; of sums that are not small, less the row's largest."""
    if not small:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], dtype=x.dtype)


def _softmax(x: np.ndarray, small: bool) -> np.ndarray:
    x, total = _exp(x, small)
    x /= total[:, None]
    return x


def _log_softmax_at(x: np.ndarray, chosen: np.ndarray, small: bool) -> np.ndarray:
    """The log of the chosen one of each row."""
    if not small:
        x -= x.max(axis=1, keepdims=True)
    own = x[np.arange(len(x)), chosen]
    return own - np.log(_exp(x, True)[1])


def hidden(w: dict[str, np.ndarray], flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = w["embedding"][flat[at + SIDES[0]]]
    h *= w["side"][0]
    for j, s in enumerate(SIDES[1:], 1):
        h += w["embedding"][flat[at + s]] * w["side"][j]
    h += w["bias"]
    return np.tanh(h, out=h)


def _by_class(w: dict[str, np.ndarray], flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of the positions by class, their classes and places in it, and where each class begins and ends."""
    cls, place = np.divmod(flat[at], w["place_bias"].shape[1])
    order = np.argsort(cls.astype(np.int16), kind="stable")
    cls = cls[order]
    return order, cls, place[order], np.searchsorted(cls, np.arange(len(w["cls_bias"]) + 1))


def log_probabilities(w: dict[str, np.ndarray], flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the tokens at the positions ``at`` of ``flat``, which has two ends before, between and after texts."""
    order, cls, place, edges = _by_class(w, flat, at)
    h = hidden(w, flat, at[order])
    logs = _log_softmax_at(h @ w["cls"] + w["cls_bias"], cls, _small(w["cls"], w["cls_bias"]))
    small = _small(w["place"], w["place_bias"])
    for c in np.flatnonzero(np.diff(edges)):
        own = slice(edges[c], edges[c + 1])
        logs[own] += _log_softmax_at(h[own] @ w["place"][c] + w["place_bias"][c], place[own], small)
    out = np.empty_like(logs)
    out[order] = logs
    return out


def gradient(w: dict[str, np.ndarray], flat: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log-probability."""
    order, cls, place, edges = _by_class(w, flat, at)
    at, n = at[order], len(at)
    h = hidden(w, flat, at)
    d = _softmax(h @ w["cls"] + w["cls_bias"], _small(w["cls"], w["cls_bias"]))
    d[np.arange(n), cls] -= 1
    g = {"cls": h.T @ d, "cls_bias": d.sum(0), "place": np.zeros_like(w["place"]), "place_bias": np.zeros_like(w["place_bias"])}
    d_h = d @ w["cls"].T
    small = _small(w["place"], w["place_bias"])
    for c in np.flatnonzero(np.diff(edges)):
        own = slice(edges[c], edges[c + 1])
        d = _softmax(h[own] @ w["place"][c] + w["place_bias"][c], small)
        d[np.arange(len(d)), place[own]] -= 1
        g["place"][c], g["place_bias"][c] = h[own].T @ d, d.sum(0)
        d_h[own] += d @ w["place"][c].T
    d_in = d_h * (1 - h**2)
    g["bias"] = d_in.sum(0)
    size, width = w["embedding"].shape
    columns = np.ascontiguousarray(d_in.T, dtype=np.float64)
    by_token, g["side"] = np.empty((len(SIDES), width, size)), np.empty_like(w["side"])
    for j, s in enumerate(SIDES):
        token = flat[at + s].astype(np.intp)
        for k in range(width):
            by_token[j, k] = np.bincount(token, weights=columns[k], minlength=size)
        g["side"][j] = (by_token[j] * w["embedding"].T).sum(axis=1)
    g["embedding"] = np.einsum("jkt,jk->tk", by_token, w["side"]).astype(w["embedding"].dtype)
    return {k: v / n for k, v in g.items()}


def lay_out(texts: Iterable[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another between ends, and where each begins."""
    gap = np.full(2, end, dtype=np.int32)
    parts, starts, at = [gap], [], 2
    for t in texts:
        starts.append(at)
        parts += [t, gap]
        at += len(t) + 2
    return np.concatenate(parts), np.array(starts, dtype=np.int64)


def residues(turn: int, rounds: int, mask: int) -> list[int]:
    """Those that are learned from in a round: over all rounds each of 0 to ``mask`` - 1, once where rounds are not more."""
    return [r % mask for r in range(turn, max(rounds, mask), rounds)]


def learn(w: dict[str, np.ndarray], texts: Iterator[np.ndarray], turn: int | list[int], mask: int, batch: int = 4096, rate: float = 0.1) -> tuple[dict[str, np.ndarray], int]:
    """Adagrad over batches of the positions masked in this turn, or in these in order; returns the weights and the number of positions."""
    turns = [turn] if isinstance(turn, int) else turn
    w = {k: v.copy() for k, v in w.items()}
    square = {k: np.full_like(v, 1e-4) for k, v in w.items()}
    end, seen = len(w["embedding"]) - 1, 0

    def step(group: list[np.ndarray]) -> int:
        flat, _ = lay_out(group, end)
        every, seen = np.flatnonzero(flat != end), 0
        for t in turns:
            at = every[(every + t) % mask == 0]
            for k in range(0, len(at), batch):
                for name, d in gradient(w, flat, at[k : k + batch]).items():
                    square[name] += d * d
                    w[name] -= (rate * d / np.sqrt(square[name])).astype(np.float32)
            seen += len(at)
        return seen

    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= batch * mask:
            seen += step(group)
            group, size = [], 0
    return w, seen + (step(group) if group else 0)


def pack_weights(w: dict[str, np.ndarray]) -> bytes:
    return b"".join(w[k].astype(np.float32).tobytes() for k in sorted(w))


def unpack_weights(data: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(data, dtype=np.float32), {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def _mean(rows: DataFrame, many: int = 64) -> tuple[bytes, int] | None:
    """The mean of the weights in (part, n, weights), weighed by n; groups of ``many`` at a time."""
    def one(frame: pd.DataFrame) -> pd.DataFrame:
        total = int(frame["n"].sum())
        mean = sum(np.frombuffer(x, dtype=np.float32).astype(np.float64) * (n / total) for x, n in zip(frame["weights"], frame["n"], strict=True))
        return pd.DataFrame({"part": [int(frame["part"].iloc[0])], "n": [total], "weights": [mean.astype(np.float32).tobytes()]})

    for _ in range(math.ceil(24 / math.log2(many))):  # enough for 16 million partitions
        rows = rows.withColumn("part", F.floor(F.col("part") / many)).groupBy("part").applyInPandas(one, "part long, n long, weights binary")
    found = rows.select("n", "weights").collect()  # one row
    return (bytes(found[0].weights), found[0].n) if found else None


def count(docs: DataFrame, words: int, others: int, often: int, text: str = "text") -> Vocabulary:
    """The vocabulary of ``docs`` with the counts of all words that have no token of their own."""
    return _count(encode(docs, text=text), words, others, often)


def _count(chunks: DataFrame, words: int, others: int, often: int) -> Vocabulary:
    counted = kept(_counted(chunks), "words")
    frequent = {bytes(r.word): r.n for r in counted.where(F.col("n") >= often / 10).collect()}
    own = {bytes(r.word): r.n for r in counted.orderBy(F.col("n").desc(), "word").limit(words).collect()} | {x: n for x, n in frequent.items() if n >= often}
    vocabulary = Vocabulary(sorted(own, key=lambda x: (-own[x], x)), others)
    vocabulary.sent = {x: n for x, n in frequent.items() if x not in own}
    if not own:
        return vocabulary
    bucket = F.pmod(F.crc32("word"), F.lit(others)).cast("int")
    totals = {r.b: (r.n, r.t) for r in counted.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("t")).collect()}
    for x, n in own.items():
        b = zlib.crc32(x) % others
        totals[b] = (totals[b][0] - n, totals[b][1] - 1)
    vocabulary.totals = [totals.get(b, (0, 0)) for b in range(others)]
    vocabulary.counts = counted.where(F.col("n") < often / 10)
    return vocabulary


def train(
    docs: DataFrame, words: int = 992, others: int = 32, rounds: int = 2, mask: int = 8, width: int = 16, text: str = "text", often: int = 10_000, batch: int = 16_384
) -> tuple[Vocabulary, dict[str, np.ndarray]]:
    return _train(encode(docs, text=text), words, others, rounds, mask, width, often, batch)


def _train(
    chunks: DataFrame, words: int = 992, others: int = 32, rounds: int = 2, mask: int = 8, width: int = 16, often: int = 10_000, batch: int = 16_384
) -> tuple[Vocabulary, dict[str, np.ndarray]]:
    vocabulary = _count(chunks, words, others, often)
    w = first_weights(vocabulary.size, width)
    many = max(2, min(64, AVERAGED // len(pack_weights(w))))
    for turn in range(rounds):
        def run(batches: Iterator[pa.RecordBatch], w: dict = w, turns: list[int] = residues(turn, rounds, mask)) -> Iterator[pa.RecordBatch]:
            def each() -> Iterator[np.ndarray]:
                for _, _, sizes, own, ids in _chunks(batches):
                    yield from np.split(vocabulary.of(own)[ids], np.cumsum(sizes)[:-1])

            after, seen = learn(w, each(), turns, mask, batch)
            if seen:
                part = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seen], pa.int64()), pa.array([pack_weights(after)], pa.binary())], names=["part", "n", "weights"])

        found = _mean(chunks.mapInArrow(run, "part long, n long, weights binary"), many)
        w = unpack_weights(found[0], w) if found else w
    return vocabulary, w


def score(docs: DataFrame, vocabulary: Vocabulary, w: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text", slice_tokens: int = 16_384) -> DataFrame:
    """n_tokens, the summed log-probability of the words and its mean for every row."""
    return _score(encode(docs, doc_id, text), vocabulary, w, slice_tokens)


def train_and_score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``score`` of every row by a model of all rows; the texts are split once for all passes."""
    chunks = encode(docs, doc_id, text)
    return _score(chunks, *_train(chunks))


def _score(chunks: DataFrame, vocabulary: Vocabulary, w: dict[str, np.ndarray], slice_tokens: int = 16_384) -> DataFrame:
    first, others, totals = vocabulary.first, vocabulary.others, vocabulary.totals
    bottom = [math.log(n + t + 1) for n, t in totals]
    fresh = [math.log(t + 1) - low for (_, t), low in zip(totals, bottom, strict=True)]
    sent = {x: math.log(n) - bottom[zlib.crc32(x) % others] for x, n in vocabulary.sent.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a document, without the words whose counts must be looked up."""
        end = len(w["embedding"]) - 1
        for chunk, keys, sizes, words, ids in _chunks(batches):
            token = vocabulary.of(words)
            share = np.fromiter(map(sent.get, words, repeat(0.0)), dtype=np.float64, count=len(words))
            long = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            for i in np.flatnonzero(long > LONGEST).tolist():
                share[i] = fresh[token[i] - first] - (long[i] + 1) * SPELLED
            starts = 2 + np.concatenate([[0], np.cumsum(sizes + 2)[:-1]])
            at = np.arange(len(ids)) + 2 * np.repeat(np.arange(1, len(sizes) + 1), sizes)
            flat = np.full(len(ids) + 2 * len(sizes) + 2, end, dtype=np.int32)
            flat[at] = token[ids]
            logs = np.zeros(len(flat))
            for k in range(0, len(at), slice_tokens):
                logs[at[k : k + slice_tokens]] = log_probabilities(w, flat, at[k : k + slice_tokens])
            logs[at] += share[ids]
            own = [pa.array((chunk * DOCS) + np.arange(len(sizes))), pa.array(keys, pa.int64()), pa.array(sizes), pa.array(np.add.reduceat(logs, starts))]
            yield pa.RecordBatch.from_arrays(own, names=["key", "doc_id", "n_tokens", "log_likelihood"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a chunk and word whose count must be looked up, with the documents that have it and how often."""
        for chunk, _, sizes, words, ids in _chunks(batches):
            token = vocabulary.of(words)
            asked = np.array([t >= first and x not in sent and len(x) <= LONGEST for t, x in zip(token.tolist(), words, strict=True)], dtype=bool)
            rare = asked[ids]
            pairs, times = np.unique(ids[rare].astype(np.int64) * DOCS + np.repeat(np.arange(len(sizes)), sizes)[rare], return_counts=True)
            word, doc = np.divmod(pairs, DOCS)
            begins = np.flatnonzero(np.diff(word, prepend=-1))
            edges = pa.array(np.append(begins, len(word)), pa.int32())
            lists = [pa.ListArray.from_arrays(edges, pa.array(x, pa.int64())) for x in (chunk * DOCS + doc, times)]
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in word[begins].tolist()], pa.binary()), *lists], names=["word", "keys", "times"])

    heads = chunks.mapInArrow(run, "key long, doc_id long, n_tokens long, log_likelihood double")
    asked = chunks.mapInArrow(ask, "word binary, keys array<long>, times array<long>")
    counts = vocabulary.counts if vocabulary.counts is not None else chunks.sparkSession.createDataFrame([], "word binary, n long")
    bucket = F.pmod(F.crc32("word"), F.lit(others)).cast("int")
    look = lambda values: F.get(F.array(*[F.lit(float(x)) for x in values]), bucket)
    logs = F.when(F.col("n").isNull(), look(fresh) - (F.length("word") + 1) * SPELLED).otherwise(F.log("n") - look(bottom))
    shares = asked.join(counts, "word", "left").select(logs.alias("log"), F.explode(F.arrays_zip("keys", "times")).alias("one"))
    shares = shares.select(F.col("one.keys").alias("key"), (F.col("one.times") * F.col("log")).alias("log_likelihood"))
    sums = heads.unionByName(shares, allowMissingColumns=True).groupBy("key")
    sums = sums.agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("log_likelihood").alias("log_likelihood"))
    return sums.select("doc_id", "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_likelihood"))
