"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded by how bytes of each kind
follow each other, and by how its words repeat. A gated attention, learned with the rest of the model
from labels of whole documents, weighs the passages; the score is that of the weighted representation.

Learning uses at most ``sample_docs`` labelled documents, those of least hash of doc_id, and of each at
most ``sample_passages`` passages, spread over the whole text. Where a doc_id has many texts, these are
cut to ``sample_docs`` by hash as well; equal rows teach once. Scoring reads every passage of every text.

Nulls and ties: null, empty and blank texts have one passage without words. Null labels are not used;
rows without doc_id have no label and are not held out. Without labels the score is 0.5, with labels of
one kind it is that kind. Repeated rows score alike. Empty tables give an empty result. Columns that the
result adds replace columns of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import text as T
from llm.sampling import distinct_texts, least_hashed

PASSAGE = 64
_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".,;:",
          b"!?", b"#*$%&|<>", b"'\"()-"]
_KIND = np.full(256, len(_KINDS), np.int64)  # the last kind: the rest of ASCII
for _i, _set in enumerate(_KINDS):
    _KIND[list(_set)] = _i
_KIND[128:] = len(_KINDS) + 1
_N = len(_KINDS) + 2
WIDTH = _N * _N + 4


def passages(column, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """One row of WIDTH numbers for each passage, and the text it is of; each text has one at least."""
    data, offsets = T.buffer(column)
    n = len(offsets) - 1
    starts, ends, texts = T.spans(T.NOT_BLANK[data], offsets)
    count = np.bincount(texts, minlength=n)
    first_word = np.cumsum(count) - count
    many = np.maximum(1, -(-count // size))
    first = np.cumsum(many) - many
    total = int(many.sum())
    of_text = np.repeat(np.arange(n), many)
    of_word = first[texts] + (np.arange(len(starts)) - first_word[texts]) // size
    # A passage reaches from its first word, or the beginning of the text, to the next passage.
    rank = np.arange(total) - first[of_text]
    begin = offsets[of_text].copy()
    later = rank > 0
    begin[later] = starts[first_word[of_text[later]] + rank[later] * size]
    length = np.diff(np.append(begin, len(data)))
    kind = _KIND[data]
    after = np.full(len(data), 3, np.int64)
    after[:-1] = kind[1:]
    closing = offsets[1:][np.diff(offsets) > 0] - 1
    after[closing] = 3
    of_byte = np.repeat(np.arange(total), length)
    pairs = np.bincount(of_byte * (_N * _N) + kind * _N + after, minlength=total * _N * _N).reshape(total, -1)
    out = np.zeros((total, WIDTH), np.float32)
    out[:, : _N * _N] = np.sqrt(pairs / np.maximum(length, 1)[:, None])
    words = T.span_hash(T.prefix_hash(data), starts, ends)
    held = np.maximum(np.bincount(of_word, minlength=total), 1)
    echo = np.flatnonzero((words[1:] == words[:-1]) & (of_word[1:] == of_word[:-1]))
    own = np.sort(words ^ T.mix(of_word.astype(np.uint64) + np.uint64(1)))
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    order = np.argsort(words ^ T.mix(of_word.astype(np.uint64) + np.uint64(1)), kind="stable")
    out[:, -4] = np.bincount(of_word[echo], minlength=total) / held
    out[:, -3] = np.bincount(of_word[order[new]], minlength=total) / held
    out[:, -2] = np.bincount(of_word, weights=ends - starts, minlength=total) / held / 10
    out[:, -1] = np.bincount(of_word, minlength=total) / size
    return out, of_text


class Model:
    """Encoder, gated attention and a logistic score."""

    def __init__(self, mean, scale, weights, constant=None):
        self.mean, self.scale, self.w, self.constant = mean, scale, weights, constant

    def scores(self, x: np.ndarray, bags: np.ndarray, n: int) -> np.ndarray:
        if self.constant is not None:
            return np.full(n, self.constant)
        first = np.searchsorted(bags, np.arange(n))
        return _forward(self.w, (x - self.mean) / self.scale, bags, first)["p"]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(w, x, bags, first):
    h = np.tanh(x @ w["E"] + w["e"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    a = (t * g) @ w["a"]
    top = np.maximum.reduceat(a, first)
    weight = np.exp(a - top[bags])
    weight /= np.add.reduceat(weight, first)[bags]
    z = np.add.reduceat(h * weight[:, None], first, axis=0)
    return {"h": h, "t": t, "g": g, "weight": weight, "z": z, "p": _sigmoid(z @ w["c"] + w["d"])}


def fit(x: np.ndarray, bags: np.ndarray, good: np.ndarray, hidden: int = 16, rounds: int = 250, rate: float = 0.02,
        decay: float = 1e-4, seed: int = 7) -> Model:
    """Gradient descent (Adam) on the balanced log loss of the labels of bags."""
    if len(good) == 0 or good.all() or not good.any():
        return Model(None, None, None, 0.5 if len(good) == 0 else float(good[0]))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.02
    x = ((x - mean) / scale).astype(np.float32)
    draw = np.random.default_rng(seed)
    w = {
        "E": draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), "e": np.zeros(hidden),
        "V": draw.normal(0, 0.3, (hidden, hidden)), "U": draw.normal(0, 0.3, (hidden, hidden)),
        "a": draw.normal(0, 0.3, hidden), "c": draw.normal(0, 0.3, hidden), "d": np.zeros(1),
    }
    w = {k: v.astype(np.float32) for k, v in w.items()}
    first = np.searchsorted(bags, np.arange(len(good)))
    balance = np.where(good, 0.5 / good.mean(), 0.5 / (1 - good.mean())).astype(np.float32) / len(good)
    one, two = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    for i in range(1, rounds + 1):
        s = _forward(w, x, bags, first)
        dp = ((s["p"] - good) * balance).astype(np.float32)
        dz = dp[:, None] * w["c"]
        dh = dz[bags] * s["weight"][:, None]
        dw = (dz[bags] * s["h"]).sum(axis=1)
        da = s["weight"] * (dw - np.add.reduceat(dw * s["weight"], first)[bags])
        dt = da[:, None] * w["a"] * s["g"] * (1 - s["t"] ** 2)
        dg = da[:, None] * w["a"] * s["t"] * s["g"] * (1 - s["g"])
        dh += dt @ w["V"].T + dg @ w["U"].T
        de = dh * (1 - s["h"] ** 2)
        grad = {
            "E": x.T @ de, "e": de.sum(axis=0), "V": s["h"].T @ dt, "U": s["h"].T @ dg,
            "a": (s["t"] * s["g"]).T @ da, "c": s["z"].T @ dp, "d": dp.sum(keepdims=True),
        }
        for k in w:
            grad[k] = grad[k] + decay * w[k]
            one[k] = 0.9 * one[k] + 0.1 * grad[k]
            two[k] = 0.999 * two[k] + 0.001 * grad[k] ** 2
            w[k] = w[k] - rate * (one[k] / (1 - 0.9**i)) / (np.sqrt(two[k] / (1 - 0.999**i)) + 1e-8)
    return Model(mean, scale, w)


def held_out(key: str = "doc_id", parts: int = 5, rest: int = 0):
    """Whether crc32 of the key as text leaves ``rest``; a row without key is not held out."""
    own = F.crc32(F.col(key).cast("string").cast("binary")) % parts == rest
    return F.coalesce(own, F.lit(False))


def sampled_passages(docs: DataFrame, labels: DataFrame, sample_docs: int, sample_passages: int) -> list:
    """Rows (doc_id, quality, x) of ``sample_docs`` labelled texts at most, x the bytes of their passages."""
    usable = labels.where("quality is not null and doc_id is not null").where(~held_out())
    few = least_hashed(usable, "doc_id", sample_docs, "quality").select(F.col("doc_id").alias("_id"), "quality")
    rows = distinct_texts(docs, few, sample_docs, "quality-sample")

    def encode(batches):
        for batch in batches:
            for part in T.slices(batch, "text", 2 << 20):
                x, bags = passages(part.column("text"))
                out = []
                for i in range(part.num_rows):
                    own = x[bags == i] if part.num_rows < 2 else x[np.searchsorted(bags, i) : np.searchsorted(bags, i + 1)]
                    if len(own) > sample_passages:
                        own = own[np.linspace(0, len(own) - 1, sample_passages).astype(int)]
                    out.append(own.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("quality"), pa.array(out, pa.binary())], ["doc_id", "quality", "x"]
                )

    kind, mark = (few.schema[c].dataType.simpleString() for c in ("_id", "quality"))
    got = rows.select("_id", "quality", "text").mapInArrow(encode, f"doc_id {kind}, quality {mark}, x binary").collect()
    return sorted(got, key=lambda r: (str(r.doc_id), r.quality, bytes(r.x)))


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = 4000, sample_passages: int = 64) -> Model:
    """A model of labels.quality from labelled documents that are not held out."""
    got = sampled_passages(docs, labels, sample_docs, sample_passages)
    each = [np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in got]
    x = np.concatenate(each) if each else np.zeros((0, WIDTH), np.float32)
    return fit(x, np.repeat(np.arange(len(each)), [len(e) for e in each]), np.array([r.quality == 1 for r in got], bool))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, part_bytes: int = 2 << 20) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    docs = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches):
        for batch in batches:
            for part in T.slices(batch, "text", part_bytes):
                scores = sent.value.scores(*passages(part.column("text")), part.num_rows).astype(float)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                    [*part.schema.names, "score", "predicted"],
                )

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{names}, score double, predicted int")
