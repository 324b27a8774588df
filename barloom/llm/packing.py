"""Packing of token sequences by best-two-fit.

``encode_pieces`` turns texts into pieces of at most ``capacity`` tokens, ``pack`` puts the pieces into sequences.
A piece as long as a sequence is one by itself. The shorter ones are dealt into blocks of about ``block_rows`` pieces
and every block is packed by one task: fill a sequence greedily with the longest piece that fits, then replace its
shortest piece by the two unpacked pieces that fill the widened gap best. A block leaves at most a few sequences
partly filled, so the loss against one packing of everything is a few sequences in ``block_rows`` pieces.

Defined cases: a null or empty text is the end token alone; repeated rows and a null ``doc_id`` are packed like any
other row; an empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm.common import kept, text_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BLOCK_ROWS = 16_384


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def token_ids(path: str):
    """A function from a text to its ids as uint32, equal to those of ``tokenizers`` for the file at ``path``.

    A byte-level BPE whose ids follow the order of its merges is run by ``tiktoken``, about six times as fast; any other
    file, and a text that spells out an added token, by ``tokenizers`` itself.
    """
    slow = Tokenizer.from_file(path)

    def exact(text: str) -> np.ndarray:
        return np.asarray(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    added = [x["content"] for x in spec.get("added_tokens", [])]
    letters = _byte_letters()
    vocab = {k: v for k, v in model.get("vocab", {}).items() if k not in added} if model.get("type") == "BPE" else {}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])] if vocab else []
    ordered = all(vocab.get(m) == 256 + i for i, m in enumerate(merged))
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
    if not (vocab and ordered and plain and len(vocab) == 256 + len(merged)) or model.get("dropout") or model.get("ignore_merges"):
        return exact
    ranks = {bytes(letters[c] for c in k): v for k, v in vocab.items()}
    # the split of byte-level vocabularies, a fixed value
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> np.ndarray:
        if any(a in text for a in added):
            return exact(text)
        return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)

    return ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full ones, but for a shorter first one."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def encode_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """The pieces of every document: its ids, then ``end_id``, cut where longer than ``capacity``.

    ``with_ids`` adds the ids themselves as ``ids array<int>``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(tokenizer)
        end = np.asarray([end_id], dtype="<u4")
        for batch in batches:
            rows: dict[str, list] = defaultdict(list)
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encode(value.as_py()).astype("<u4", copy=False), end])
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    row = (key, k, start, length, zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else []))
                    for name, cell in zip(names, row, strict=True):
                        rows[name].append(cell)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows[n], t) for n, t in zip(names, kinds, strict=True)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
    schema = PIECES + ", ids array<int>" * with_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, schema)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the place in it of every length, for lengths of 1 to ``capacity``.

    Lengths still unpacked are bits of one number, so the longest that fits and the best pair are a few bit operations.
    """
    where: dict[int, list[int]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        where[int(lengths[i])].append(i)
    free = sum(1 << n for n in where)
    mirror = sum(1 << (capacity - n) for n in where)
    bins, places = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)

    def take(n: int) -> tuple[int, int]:
        nonlocal free, mirror
        i = where[n].pop()
        if not where[n]:
            free ^= 1 << n
            mirror ^= 1 << (capacity - n)
        return n, i

    def give(n: int, i: int) -> None:
        nonlocal free, mirror
        where[n].append(i)
        free |= 1 << n
        mirror |= 1 << (capacity - n)

    def best_pair(least: int, room: int) -> tuple[int, int] | None:
        for total in range(room, least, -1):
            both = free & (mirror >> (capacity - total))
            while both:
                longer = both.bit_length() - 1
                if 2 * longer != total:
                    return longer, total - longer
                if len(where[longer]) > 1:
                    return longer, longer
                both ^= 1 << longer
        return None

    at = 0
    while free:
        chosen, gap = [], capacity
        while (n := (free & ((2 << gap) - 1)).bit_length() - 1) > 0:
            chosen.append(take(n))
            gap -= n
        if gap and len(chosen) > 1 and (pair := best_pair(chosen[-1][0], gap + chosen[-1][0])):
            taken = [take(n) for n in pair]
            give(*chosen.pop())
            chosen += taken
        place = 0
        for n, i in chosen:
            bins[i], places[i] = at, place
            place += n
        at += 1
    return bins, places


def pack(pieces: DataFrame, capacity: int = 2048, block_rows: int = BLOCK_ROWS, sizes: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; the pieces are written once before they are dealt into blocks.

    Every length must lie between 1 and ``capacity``.
    """
    pieces = kept(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    full, part = pieces.where(F.col(sizes) >= capacity), pieces.where(F.col(sizes) < capacity)
    blocks = max(1, -(-part.count() // block_rows))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        bins, places = best_two_fit(frame["__size"].to_numpy(), capacity)
        return frame.assign(sequence_id=(int(frame["__block"].iloc[0]) << 32) + bins, offset=places)[["__row", "sequence_id", "offset"]]

    # only lengths meet in a block; what else a piece has, such as its ids, is joined to its place
    dealt = part.select("__row", F.col(sizes).cast("long").alias("__size"), F.pmod("__row", F.lit(blocks)).cast("int").alias("__block"))
    placed = dealt.groupBy("__block").applyInPandas(one, "__row long, sequence_id long, offset long")
    alone = full.select("*", (-1 - F.col("__row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(part.join(placed, "__row")).drop("__row")


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence with its ids in order, from packed pieces that carry ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("__p")).select(
        "sequence_id", F.col("__p.doc_id").alias("doc_ids"), F.flatten("__p.ids").alias("ids")
    )
