"""Lines that many documents share are dropped, found by a sharded minimal perfect hash instead of a join of lines.

A line's key is the line without blanks at its ends, A-Z in lower case; it goes by its 128-bit hash. Tasks count, a key once a
document, and one row per distinct key and task is added up by hash. The distinct keys are dealt into shards of about
``SHARD`` keys. A shard is built by itself: a cascade of bit tables, in each of which the keys that hit a bit alone have
found their place and the others go on, so that the place of a key is the number of bits set before its own; two arrays in
that order hold a 16-bit fingerprint of the key and its number of documents, which stops at 255 where no more is asked
for. A shard of 8,192 keys has about 30 KB.

Documents probe those arrays. The keys of each text, 16 bytes each, are sent to their shards, meet the one
row that a shard is, and only those found often enough come back. A key in a great share of all documents would bring all its askers
to one shard, so keys counted above ``HOT`` and above a 100,000th of all that is asked, 100,000 at most by that
bound, are built into one more shard that every task is sent; they are looked up on the spot and never travel. As
strangers are looked up there too, its fingerprints have 64 bits.

Defined cases: a null or empty text is one empty line; keys of fewer than ``points`` code points are never dropped; every row
counts as a document, a repeated one too; a row without id is treated like any other;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import few, kept, text_of

BLANK = b" \t\x0b\x0c\r"
SHARD = 8192
HOT = 1000
FLUSH = 200_000
GAMMA = 2.0
MIX = 0x9E3779B97F4A7C15
PAIR = "h1 long, h2 long"
#: So many keys of texts may be sent to every task.
PAIRS = 500_000


def keys_of(data: bytes) -> list[bytes]:
    """The keys of all lines of a text, in order."""
    return [line.strip(BLANK) for line in data.lower().split(b"\n")]


def hashed(keys: list[bytes]) -> np.ndarray:
    """(n, 2) of 64 bits each."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype=">u8").astype(np.uint64).reshape(-1, 2)


def _long_enough(key: bytes, points: int) -> bool:
    return len(key) >= points and (points < 2 or len(key.decode("utf-8", "replace")) >= points)


# the minimal perfect hash of a shard


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where keys stand in the table of a level; ``size`` is below 2**32."""
    x = (h[:, 0] + np.uint64(level * MIX % (1 << 64))) ^ h[:, 1]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(MIX)
    x ^= x >> np.uint64(29)
    return (((x >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)


class Shard(NamedTuple):
    levels: list[np.ndarray]  # bits as bytes of 0 and 1
    ranks: list[np.ndarray]  # how many bits are set up to each, those of earlier levels included
    prints: np.ndarray
    counts: np.ndarray

    def pack(self) -> bytes:
        head = [self.prints.dtype.itemsize, self.counts.dtype.itemsize, len(self.prints), len(self.levels), *map(len, self.levels)]
        return np.array(head, dtype="<u4").tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels) + self.prints.tobytes() + self.counts.tobytes()


def _ranked(levels: list[np.ndarray]) -> list[np.ndarray]:
    ends = np.cumsum(np.concatenate([np.zeros(0, np.int64), *levels]), dtype=np.int64)
    return np.split(ends, np.cumsum([len(x) for x in levels])[:-1]) if levels else []


def _print(h: np.ndarray, wide: type) -> np.ndarray:
    return (h[:, 1] >> np.uint64(64 - 8 * np.dtype(wide).itemsize)).astype(wide)


def build(h: np.ndarray, n: np.ndarray, enough: int, wide: type = np.uint16) -> Shard:
    """Of distinct hashes ``h`` and their numbers of documents, which are told apart up to ``enough`` at least."""
    kind = np.uint8 if enough < 256 else np.uint32
    values = np.minimum(n, np.iinfo(kind).max).astype(kind)
    levels, order, live = [], [], np.arange(len(h))
    while len(live):
        size = max(8, int(GAMMA * len(live)))
        at = _place(h[live], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        done = alone[at]
        levels.append(alone.astype(np.uint8))
        order.append(live[done][np.argsort(at[done])])
        live = live[~done]
    by = np.concatenate(order) if order else np.zeros(0, dtype=np.int64)
    return Shard(levels, _ranked(levels), _print(h[by], wide), values[by])


def unpack(data: bytes) -> Shard:
    wide, kind, many, n = np.frombuffer(data, dtype="<u4", count=4).tolist()
    sizes = np.frombuffer(data, dtype="<u4", count=n, offset=16).tolist()
    levels, at = [], 16 + 4 * n
    for size in sizes:
        levels.append(np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=-(-size // 8), offset=at), count=size))
        at += -(-size // 8)
    prints = np.frombuffer(data, dtype=f"<u{wide}", count=many, offset=at)
    return Shard(levels, _ranked(levels), prints, np.frombuffer(data, dtype=f"<u{kind}", count=many, offset=at + wide * many))


def probe(shard: Shard, h: np.ndarray) -> np.ndarray:
    """The number of documents of each hash; 0 for one whose fingerprint is not there."""
    out, live = np.zeros(len(h), dtype=np.int64), np.arange(len(h))
    own = _print(h, shard.prints.dtype)
    for level, (bits, ranks) in enumerate(zip(shard.levels, shard.ranks, strict=True)):
        if not len(live):
            break
        at = _place(h[live], level, len(bits))
        hit = bits[at] == 1
        found, place = live[hit], ranks[at[hit]] - 1
        same = shard.prints[place] == own[found]
        out[found[same]] = shard.counts[place[same]]
        live = live[~hit]
    return out


# the corpus


def count_keys(docs: DataFrame, points: int, text: str = "text") -> DataFrame:
    """h1, h2 and n, the number of documents, of every distinct key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            h = np.frombuffer(b"".join(counts), dtype=">u8").astype(np.uint64).reshape(-1, 2).view(np.int64)
            out = pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(list(counts.values()), pa.int64())], names=["h1", "h2", "n"])
            counts.clear()
            return out

        for batch in batches:
            for value in batch.column(0):
                distinct = [k for k in set(keys_of(value.as_py())) if _long_enough(k, points)]
                for low in range(0, len(distinct), FLUSH):
                    counts.update(map(xxhash.xxh3_128_digest, distinct[low : low + FLUSH]))
                    if len(counts) > FLUSH:
                        yield flush()
        yield flush()

    rows = docs.select(text_of(text).cast("binary").alias("text")).mapInArrow(run, f"{PAIR}, n long")
    return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def _shard_of(shards: int):
    return F.pmod(F.col("h1"), F.lit(shards)).cast("int").alias("shard")


def index(counted: DataFrame, shards: int, enough: int) -> DataFrame:
    """shard and data, one row a shard."""
    def one(table: pa.Table) -> pa.Table:
        h = np.stack([table["h1"].to_numpy(), table["h2"].to_numpy()], axis=1).view(np.uint64)
        return pa.table({"shard": table["shard"][:1].cast(pa.int32()), "data": pa.array([build(h, table["n"].to_numpy(), enough).pack()], pa.binary())})

    return counted.select("h1", "h2", "n", _shard_of(shards)).groupBy("shard").applyInArrow(one, "shard int, data binary")


def asked(docs: DataFrame, hot: bytes, points: int, shards: int, text: str = "text") -> DataFrame:
    """shard, address (of the text), h1, h2: the distinct keys of every text but those that ``hot`` holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = unpack(hot)
        for batch in batches:
            for low in range(0, len(batch), 256):
                texts = {hashlib.md5(data).digest(): data for data in batch.column(0)[low : low + 256].to_pylist()}
                keys = [[k for k in set(keys_of(data)) if _long_enough(k, points)] for data in texts.values()]
                h = hashed([k for own in keys for k in own])
                which = np.repeat(np.arange(len(keys)), [len(own) for own in keys])
                cold = probe(known, h) == 0
                pairs = h[cold].view(np.int64)
                address = pa.array(list(texts), pa.binary()).take(pa.array(which[cold]))
                shard = np.mod(pairs[:, 0], shards).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard), address, pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["shard", "address", "h1", "h2"])

    return docs.select(text_of(text).cast("binary").alias("text")).mapInArrow(run, f"shard int, address binary, {PAIR}")


def answers(index: DataFrame, asked: DataFrame, enough: int) -> DataFrame:
    """address and the packed hashes (found) of its keys that at least ``enough`` documents have."""
    def meet(key: tuple, shard: pa.Table, asked: pa.Table) -> pa.Table:
        h = np.stack([asked["h1"].to_numpy(), asked["h2"].to_numpy()], axis=1).view(np.uint64)
        n = probe(unpack(shard["data"][0].as_py()), h) if len(shard) else np.zeros(len(h))
        return asked.select(["address", "h1", "h2"]).filter(pa.array(n >= enough))

    return index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(meet, f"address binary, {PAIR}")


def common_keys(docs: DataFrame, enough: int = 10, points: int = 1, text: str = "text", shard_keys: int = SHARD, hot_above: int = HOT) -> tuple[DataFrame, bytes]:
    """address, found (pairs h1, h2) of each text that has shared keys, and the shard of the hot ones."""
    counted = kept(count_keys(docs, points, text), "keys")
    distinct, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards, bound = max(1, -(-distinct // shard_keys)), max(hot_above, enough - 1, total // 100_000)
    hot = counted.where(F.col("n") > bound).toArrow()  # 100,000 rows at most, as n > total / 100,000
    h = np.stack([hot["h1"].to_numpy(), hot["h2"].to_numpy()], axis=1).view(np.uint64)
    shard = build(h, hot["n"].to_numpy(), enough, np.uint64).pack()
    found = answers(kept(index(counted, shards, enough), "index"), asked(docs, shard, points, shards, text), enough)
    return kept(found.groupBy("address").agg(F.collect_set(F.struct("h1", "h2")).alias("found")), "found"), shard


def split_texts(docs: DataFrame, enough: int = 10, points: int = 1, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text, what is left of the text, of every row."""
    found, hot = common_keys(docs, enough, points, text, **options)
    pairs = found.agg(F.coalesce(F.sum(F.size("found")), F.lit(0))).first()[0]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).cast("binary").alias("text"))
    rows = rows.withColumn("address", F.unhex(F.md5("text"))).join(few(found) if pairs <= PAIRS else found, "address", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = unpack(hot)
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                texts = part.column(1).to_pylist()
                keys = [keys_of(data) for data in texts]
                lines = np.array([len(k) for k in keys], dtype=np.int64)
                h = hashed([k for own in keys for k in own])
                gone, starts = probe(known, h) >= enough, np.concatenate([[0], np.cumsum(lines)])
                for i, own in enumerate(part.column(2)):
                    if own.is_valid:
                        there = {(x["h1"], x["h2"]) for x in own.as_py()}
                        mine = h[starts[i] : starts[i + 1]].view(np.int64)
                        gone[starts[i] : starts[i + 1]] |= [(a, b) in there for a, b in mine.tolist()]
                gone &= np.fromiter((_long_enough(k, points) for own in keys for k in own), dtype=bool, count=len(gone))
                left = []
                for i, data in enumerate(texts):
                    own = gone[starts[i] : starts[i + 1]]
                    left.append(b"\n".join(line for line, x in zip(data.split(b"\n"), own.tolist(), strict=True) if not x) if own.any() else data)
                dropped = np.add.reduceat(gone.astype(np.int64), starts[:-1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lines), pa.array(dropped), pa.array(left, pa.binary())], names=["doc_id", "n_lines", "n_dropped", "kept_text"])

    out = rows.select("doc_id", "text", "found").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_text binary")
    return out.withColumn("kept_text", F.col("kept_text").cast("string"))
