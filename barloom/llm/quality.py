"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 160 words. Every passage is encoded (how kinds of characters follow one another, and
how its words repeat), a hidden layer and gated attention weigh the passages, and the weighted passage vector is scored.
The weights are learned in numpy from document labels alone.

``fit`` reads at most ``max_docs`` labelled documents, the first by a hash of their id, and learns from all their
passages. What reaches the driver is bounded: a text of more than ``max_passages`` is that many runs of passages in a row, each
the mean of its run, so that none is left out. ``score`` encodes every passage of every document.

Defined cases: a null text is an empty one, and an empty one is one passage of zeros, scored like any other; labels
that are null are left out, a document labelled both ways counts with its mean, rounded up; without labels of both
kinds every score is the share of label 1 (0.5 without any); repeated rows are scored alike, and of several texts with
one id the first in order is learned from; an empty table gives an empty result; columns other than the id and the text
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from barloom.llm.common import text_of

PASSAGE_WORDS = 160
HIDDEN, GATE = 24, 12
MAX_DOCS, MAX_PASSAGES, EPOCHS = 3000, 128, 40
KINDS = 8
FEATURES = KINDS**3 + 4
SCORES = "doc_id long, score double"


def _kinds() -> np.ndarray:
    """The kind of each byte: lower, upper, digit, blank, sentence mark, other sign, beyond ASCII, control."""
    kind = np.full(256, 7, dtype=np.int32)
    kind[128:] = 6
    for b in range(33, 127):
        c = chr(b)
        kind[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 4 if c in ".,;:'\"()-!?" else 5
    kind[[9, 10, 11, 12, 13, 32]] = 3
    return kind


KIND = _kinds()


def encode(text: str) -> np.ndarray:
    """A row of features for every passage of a text: shares of character-kind triples, then four about its words."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    if not words:
        return np.zeros((1, FEATURES), dtype=np.float32)
    kind = KIND[np.frombuffer(data, dtype=np.uint8)]
    blank = kind == 3
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    n = -(-len(words) // PASSAGE_WORDS)
    edges = np.append(starts[::PASSAGE_WORDS], len(kind))
    edges[0] = 0
    before = np.concatenate([[3], kind[:-1]])
    triples = (np.concatenate([[3], before[:-1]]) * KINDS + before) * KINDS + kind
    out = np.zeros((n, FEATURES), dtype=np.float32)
    ids = np.fromiter(map(hash, words), dtype=np.int64, count=len(words))
    for p in range(n):
        shares = np.bincount(triples[edges[p] : edges[p + 1]], minlength=KINDS**3)
        out[p, : KINDS**3] = np.sqrt(shares / shares.sum())
        own = ids[p * PASSAGE_WORDS : (p + 1) * PASSAGE_WORDS]
        ordered = np.sort(own)
        out[p, KINDS**3 :] = (
            np.mean(own[1:] == own[:-1]) if len(own) > 1 else 0.0,
            (1 + np.count_nonzero(ordered[1:] != ordered[:-1])) / len(own),
            min((edges[p + 1] - edges[p]) / len(own), 50) / 10,
            len(own) / PASSAGE_WORDS,
        )
    return out


def pooled(x: np.ndarray, most: int) -> np.ndarray:
    """The passages, or the means of ``most`` runs of them that are as even as can be."""
    if len(x) <= most:
        return x
    first = np.arange(most) * len(x) // most
    return np.add.reduceat(x, first, dtype=np.float64) / np.diff(np.append(first, len(x)))[:, None]


@dataclass
class Weights:
    hidden: np.ndarray
    hidden_bias: np.ndarray
    content: np.ndarray
    gate: np.ndarray
    attention: np.ndarray
    score: np.ndarray
    bias: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(w: Weights, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """``x`` holds the passages of all bags one after another, ``first`` the row where each bag begins."""
    sizes = np.diff(np.append(first, len(x)))
    of = np.repeat(np.arange(len(first)), sizes)
    h = np.maximum(x @ w.hidden + w.hidden_bias, 0)
    content, gate = np.tanh(h @ w.content), _sigmoid(h @ w.gate)
    raw = (content * gate) @ w.attention
    share = np.exp(raw - np.maximum.reduceat(raw, first)[of])
    share /= np.add.reduceat(share, first)[of]
    bag = np.add.reduceat(h * share[:, None], first)
    return {"of": of, "h": h, "content": content, "gate": gate, "share": share, "bag": bag, "score": _sigmoid(bag @ w.score + w.bias[0])}


def gradient(w: Weights, x: np.ndarray, first: np.ndarray, y: np.ndarray, importance: np.ndarray) -> Weights:
    f = forward(w, x, first)
    of, h, share = f["of"], f["h"], f["share"]
    d_score = (f["score"] - y) * importance / importance.sum()
    d_bag = d_score[:, None] * w.score[None, :]
    d_share = np.einsum("ij,ij->i", h, d_bag[of])
    d_raw = share * (d_share - np.add.reduceat(share * d_share, first)[of])
    d_gated = d_raw[:, None] * w.attention[None, :]
    d_content = d_gated * f["gate"] * (1 - f["content"] ** 2)
    d_gate = d_gated * f["content"] * f["gate"] * (1 - f["gate"])
    d_h = (share[:, None] * d_bag[of] + d_content @ w.content.T + d_gate @ w.gate.T) * (h > 0)
    return Weights(x.T @ d_h, d_h.sum(0), h.T @ d_content, h.T @ d_gate, (f["content"] * f["gate"]).T @ d_raw, f["bag"].T @ d_score, np.array([d_score.sum()]))


def train(bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = 1) -> Weights:
    """Adam over shuffled batches of bags; both labels weigh the same in sum, up to a factor of 3."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = Weights(draw(FEATURES, HIDDEN), np.zeros(HIDDEN), draw(HIDDEN, GATE), draw(HIDDEN, GATE), draw(GATE), draw(HIDDEN), np.zeros(1))
    share = np.clip(y.mean(), 0.25, 0.75)
    importance = np.where(y == 1, 1 / share, 1 / (1 - share))
    names = [f.name for f in fields(Weights)]
    mean, square, t = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            own = [bags[i] for i in pick]
            first = np.cumsum([0] + [len(b) for b in own[:-1]])
            g, t = gradient(w, np.concatenate(own).astype(np.float64), first, y[pick], importance[pick]), t + 1
            for n in names:
                d = getattr(g, n) + 1e-5 * getattr(w, n)
                mean[n] = 0.9 * mean[n] + 0.1 * d
                square[n] = 0.999 * square[n] + 0.001 * d**2
                setattr(w, n, getattr(w, n) - rate * (mean[n] / (1 - 0.9**t)) / (np.sqrt(square[n] / (1 - 0.999**t)) + 1e-8))
    return w


def held_out(doc_id: str) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def fit(
    docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_passages: int = MAX_PASSAGES, epochs: int = EPOCHS,
    doc_id: str = "doc_id", text: str = "text", label: str = "quality",
) -> Weights | float:
    """Weights from the labels of rows that are not held out, or the share of label 1 where they are all alike."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("y is not null and doc_id is not null")
    chosen = named.where(~held_out("doc_id")).groupBy("doc_id").agg(F.round(F.avg("y")).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ys, blobs = [], [], []
            for key, value, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                x = pooled(encode(value.as_py()), max_passages)
                ids.append(key), ys.append(y), blobs.append(x.astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.float64()), pa.array(blobs, pa.binary())], names=["doc_id", "y", "x"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # max_docs rows
    rows = rows.select("doc_id", "text", "y").mapInArrow(encoded, "doc_id long, y double, x binary")
    found = sorted(((r.doc_id, r.y, bytes(r.x)) for r in rows.collect()), key=lambda r: r[0])  # max_docs rows of max_passages passages
    y = np.array([r[1] for r in found])
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    return train([np.frombuffer(r[2], dtype=np.float16).reshape(-1, FEATURES) for r in found], y, epochs)


def score(docs: DataFrame, weights: Weights | float, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """``doc_id`` and ``score`` of every row; with ``keep`` those columns as they are and the score as ``name``.

    A text that is kept is sent to the task once.
    """
    sent = keep.index(text) if text in keep and docs.schema[text].dataType == StringType() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for value in batch.column(1 if sent is None else 1 + sent):
                x = encode(value.as_py() or "")
                scores.append(weights if isinstance(weights, float) else float(forward(weights, x.astype(np.float64), np.zeros(1, dtype=int))["score"][0]))
            columns = [batch.column(0), pa.array(scores, pa.float64()), *batch.columns[len(batch.columns) - len(keep) :]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "score", *[f"__keep{i}" for i in range(len(keep))]]
    read = [text_of(text).alias("__text")] if sent is None else []
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *read, *[F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)])
    schema = SCORES + "".join(f", __keep{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    scored = picked.mapInArrow(run, schema)
    return scored.select(*[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)], F.col("score").alias(name)) if keep else scored
