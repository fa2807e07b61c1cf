"""Language-model scores from the lattice of all subword segmentations.

The pieces are those of an existing subword vocabulary; its scores, which are ranks, give the pieces
their first weights by Zipf's law. A word's probability sums over all ways to cut it into pieces, by a
forward recursion in log space. Expected counts of pieces over the distinct training words (forward and
backward) make the weights probabilities. The lattice of a word also has one arc that spans it: its
discounted frequency in the training documents. The discount's mass goes to the subword paths, so new
words have a probability too.

The tokens of documents are written once as blocks: the distinct words of a block and the tokens as
places among them. Words are counted and scored once for the whole corpus, and each block gets the
figures of its words back. A frequent word is one row per block, whatever its count.

Nulls and ties: null is the empty text, which is one end. Rows without doc_id are not held out. Repeated
rows are scored, and counted, as often as they occur. Without training documents no word is known and the
subword paths have all mass. Empty tables give an empty result. Further columns are not kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diarist.scratch import materialize, scratch_path
from llm import text as T

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Pieces:
    """Byte strings by their hash, with natural log weights. A blank begins a word."""

    hashes: np.ndarray
    weights: np.ndarray
    longest: int

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def load_pieces(path: str = VOCABULARY, offset: float = 2.7) -> Pieces:
    """Pieces of a sentencepiece vocabulary, weighed by 1 / (rank + offset). Byte pieces rank last."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranks: dict[bytes, float] = {}
    last = float(model.get_piece_size())
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i):
            continue
        piece = model.id_to_piece(i)
        own = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
        if own and b" " not in own[1:]:
            ranks.setdefault(own, last if model.is_byte(i) else -model.get_score(i))
    for b in range(256):
        ranks.setdefault(bytes([b]), last)
    names = list(ranks)
    data = np.frombuffer(b"".join(names), np.uint8)
    ends = np.cumsum([len(n) for n in names])
    hashes = T.span_hash(T.prefix_hash(data), ends - [len(n) for n in names], ends)
    weights = 1 / (np.array([ranks[n] for n in names]) + offset)
    order = np.argsort(hashes)
    return Pieces(hashes[order], np.log(weights / weights.sum())[order], max(map(len, names)))


def _log_sum(terms: np.ndarray) -> np.ndarray:
    top = terms.max(axis=1)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(terms - safe[:, None]).sum(axis=1)) + safe


def _equal_lengths(column, most_cells: int = 1 << 21):
    """Words with a blank before them, in groups of one length: places, and a matrix of prefix hashes."""
    data, offsets = T.buffer(column)
    size = np.diff(offsets)
    order = np.argsort(size, kind="stable")
    cut = np.flatnonzero(np.diff(size[order])) + 1
    for group in np.split(order, cut):
        if not len(group):
            continue
        n = int(size[group[0]])
        for at in range(0, len(group), max(1, most_cells // (n + 1) ** 2 + 1)):
            own = group[at : at + max(1, most_cells // (n + 1) ** 2 + 1)]
            chars = np.full((len(own), n + 1), 32, np.uint8)
            chars[:, 1:] = data[offsets[own][:, None] + np.arange(n)]
            yield own, chars


def _arcs(chars: np.ndarray, pieces: Pieces):
    """For each end t, the pieces that end there: place of the piece by its length, -1 for none."""
    n, size = chars.shape
    prefix = T.prefix_hash(chars.ravel())
    base = np.arange(n) * size
    for t in range(1, size + 1):
        lengths = np.arange(1, min(t, pieces.longest) + 1)
        ends = (base + t)[:, None] - np.zeros(len(lengths), np.int64)
        yield t, lengths, pieces.find(T.span_hash(prefix, ends - lengths, ends))


def log_marginals(column, pieces: Pieces) -> np.ndarray:
    """Natural log of the summed probability of all segmentations of each word."""
    out = np.zeros(len(column))
    padded = np.append(pieces.weights, -np.inf)
    for own, chars in _equal_lengths(column):
        alpha = np.full((len(own), chars.shape[1] + 1), -np.inf)
        alpha[:, 0] = 0
        for t, lengths, found in _arcs(chars, pieces):
            alpha[:, t] = _log_sum(alpha[:, t - lengths] + padded[found])
        out[own] = alpha[:, -1]
    return out


def expected_counts(column, pieces: Pieces) -> np.ndarray:
    """How often each piece is expected in the words, over all segmentations."""
    out = np.zeros(len(pieces.weights) + 1)
    padded = np.append(pieces.weights, -np.inf)
    for own, chars in _equal_lengths(column):
        size = chars.shape[1]
        alpha, beta = (np.full((len(own), size + 1), -np.inf) for _ in range(2))
        alpha[:, 0] = beta[:, size] = 0
        arcs = list(_arcs(chars, pieces))
        for t, lengths, found in arcs:
            alpha[:, t] = _log_sum(alpha[:, t - lengths] + padded[found])
        for t, lengths, found in reversed(arcs):
            onward = padded[found] + beta[:, t][:, None]
            share = alpha[:, t - lengths] + onward - alpha[:, -1:]
            np.add(out, np.bincount(found.ravel() % len(out), np.exp(share).ravel(), len(out)), out=out)
            beta[:, t - lengths] = np.logaddexp(beta[:, t - lengths], onward)
    return out[:-1]


def _words(part: pa.RecordBatch, slice_bytes: int = 1 << 20):
    """Lower-case bytes of a block's texts, and of each word its bounds, text and hash; in slices, to save memory."""
    data, found, byte, text = [], [], 0, 0
    for some in T.slices(part, "text", slice_bytes):
        own, offsets = T.buffer(some.column("text"))
        own = T.LOWER[own]
        starts, ends, texts = T.spans(T.NOT_BLANK[own], offsets)
        found.append((starts + byte, ends + byte, texts + text, T.span_hash(T.prefix_hash(own), starts, ends)))
        data.append(own)
        byte, text = byte + len(own), text + some.num_rows
    return np.concatenate(data), *(np.concatenate(x) for x in zip(*found))


def _pack(places: np.ndarray) -> bytes:
    """Places, small ones first in number, by bytes of equal weight, compressed."""
    planes = np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.Codec("zstd", compression_level=6).compress(planes, asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed, 4 * n), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def blocks(docs: DataFrame, part_bytes: int = 4 << 20) -> DataFrame:
    """Written blocks of documents (doc_id, text, held_out): ``words``, how often each is in training, and tokens."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"ids array<{kind}>, held array<boolean>, sizes array<int>, tokens binary, words array<string>, taught array<long>"

    def run(batches):
        for batch in batches:
            for part in T.slices(batch, "text", part_bytes):
                data, starts, ends, texts, hashes = _words(part)
                _, first, place = np.unique(hashes, return_index=True, return_inverse=True)
                frequent = np.argsort(-np.bincount(place, minlength=len(first)), kind="stable")
                rank = np.empty(len(first), np.int64)
                rank[frequent] = np.arange(len(first))
                first, place = first[frequent], rank[place]
                held = part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                taught = np.bincount(place, weights=~held[texts], minlength=len(first)).astype(np.int64)
                size = ends[first] - starts[first]
                upto = np.append(0, np.cumsum(size))
                at = np.repeat(starts[first] - upto[:-1], size) + np.arange(upto[-1])
                words = pa.Array.from_buffers(
                    pa.string(), len(first), [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(data[at])]
                )
                tokens = _pack(place)

                def one(values):
                    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

                yield pa.RecordBatch.from_arrays(
                    [one(part.column("doc_id")), one(pa.array(held)),
                     one(pa.array(np.bincount(texts, minlength=part.num_rows), pa.int32())),
                     pa.array([tokens], pa.binary()), one(words), one(pa.array(taught))],
                    ["ids", "held", "sizes", "tokens", "words", "taught"],
                )

    rows = docs.select("doc_id", "text", "held_out").mapInArrow(run, schema)
    path = scratch_path(docs.sparkSession, "lm-blocks")
    rows.withColumn("block", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def learn_pieces(words: DataFrame, pieces: Pieces, rounds: int = 2, floor: float = 0.01) -> Pieces:
    """Piece probabilities by expected counts over distinct training ``word``s."""
    for _ in range(rounds):
        sent = words.sparkSession.sparkContext.broadcast(pieces)  # as many numbers as the vocabulary has pieces

        def count(batches, sent=sent):
            total = np.zeros(len(sent.value.weights))
            for batch in batches:
                total += expected_counts(batch.column(0), sent.value)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "n"])

        got = words.select("word").mapInArrow(count, "piece long, n double").groupBy("piece").agg(F.sum("n")).collect()
        weights = np.full(len(pieces.weights), floor)
        for piece, n in got:
            weights[piece] += n
        pieces = Pieces(pieces.hashes, np.log(weights / weights.sum()), pieces.longest)
    return pieces


def score(docs: DataFrame, vocabulary: str = VOCABULARY, rounds: int = 2) -> DataFrame:
    """Per document (doc_id, text, held_out): token figures, ``base_score`` and ``score``, both log10."""
    spark = docs.sparkSession
    written = blocks(docs)
    asked = written.select("block", F.posexplode(F.arrays_zip("words", "taught")).alias("place", "w")).select(
        "block", "place", F.col("w.words").alias("word"), F.col("w.taught").alias("taught")
    )
    types = materialize(asked.groupBy("word").agg(F.sum("taught").alias("c")), "lm-words")
    known = F.col("c") > 0
    total = types.agg(
        F.sum("c"), F.count(F.when(known, 1)), F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))
    ).first()
    ends = written.select(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    words, distinct, once, two = (int(x or 0) for x in total)
    n, v = words + ends, distinct + (ends > 0)
    less = max(once / (once + 2 * two) if once else 0.0, 0.1)  # the subword paths always have mass
    rest = less * distinct / n if n else 1.0
    pieces = learn_pieces(types.where(known), load_pieces(vocabulary), rounds if words else 0)
    sent = spark.sparkContext.broadcast(pieces)
    norm = n + 0.1 * (v + 1)

    def marginal(batches):
        for batch in batches:
            c = batch.column("c").to_numpy().astype(float)
            q = log_marginals(batch.column("word"), sent.value)
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(c - less, 0) / max(n, 1))
                score = np.logaddexp(whole, q + np.log(rest)) / np.log(10)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(score)], ["word", "c", "score"])

    scored = types.mapInArrow(marginal, "word string, c long, score double")
    told = asked.select(F.col("block").alias("asking"), "place", "word").join(scored, "word").select(
        "asking", "place", "c", "score"
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    end = float(np.log10((ends + 0.1) / norm))

    def per_document(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, held = (left.column(c).combine_chunks().flatten() for c in ("ids", "held"))
        sizes = left.column("sizes").combine_chunks().flatten().to_numpy()
        tokens = _unpack(left.column("tokens")[0].as_py(), int(sizes.sum())) if sizes.sum() else np.zeros(0, np.int64)
        place = right.column("place").to_numpy()
        c, own = np.zeros(len(place), np.int64), np.zeros(len(place))
        c[place], own[place] = right.column("c").to_numpy(), right.column("score").to_numpy()
        base = np.log10((c + 0.1) / norm)
        of = np.repeat(np.arange(len(sizes)), sizes)

        def per(values):
            return np.bincount(of, weights=values[tokens], minlength=len(sizes))

        return pa.table({
            "doc_id": ids, "held_out": held, "n_tokens": sizes.astype(np.int64) + 1,
            "n_known": per(c > 0).astype(np.int64) + int(ends > 0), "train_tokens": np.full(len(sizes), n, np.int64),
            "base_score": per(base) + end, "score": per(own) + end,
        })

    left = written.select("block", "ids", "held", "sizes", "tokens")
    return left.groupBy("block").cogroup(told.groupBy("asking")).applyInArrow(per_document, schema)
