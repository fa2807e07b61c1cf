"""Language by cross-parsing entropy.

Texts are read as letters with one blank between words. A suffix automaton of labelled text per language knows every substring of that text. A document is
parsed from left to right into the longest phrases that each language's text holds; phrases times the
bits that name a place in that text, per byte, is the cross entropy, and the least wins. Parsing starts
anew every ``CHUNK`` bytes, for all languages alike, so that many chunks are stepped through at once.

Learning uses per language at most ``sample_docs`` distinct texts of least hash. Each is cut, whole, into
pieces of ``piece`` characters, of which ``doc_pieces`` teach, chosen by hash anywhere in the text; first one
of every text, then a second, until a language has ``sample_bytes`` bytes. ``block`` languages are broadcast at a time, so the tables that a
task holds are bounded whatever the number of languages; every document meets every block, whole.

Nulls and ties: null texts and texts without a letter are ``und`` with score 0, as are all without
labelled text. Null languages and rows without doc_id teach nothing. Of equal entropies the first
language by name wins. Repeated rows are judged alike. Empty tables give an empty result. Columns that
the result adds replace columns of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diarist.scratch import materialize
from llm import text as T

CHUNK = 256
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True


def letters(column) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters (and all beyond ASCII) of each text; whatever stands between is one blank."""
    data, offsets = T.buffer(column)
    data = T.LOWER[data]
    letter = LETTER[data]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    closing = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    keep[closing] &= letter[closing]  # a text doesn't begin with the blank of the one before
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    return np.where(letter, data, 32).astype(np.uint8)[keep], place[offsets]


def suffix_automaton(symbols) -> list[dict[int, int]]:
    """Transitions of the automaton that knows every substring; state 0 is the beginning."""
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at != -1 and c not in step[at]:
            step[at][c] = new
            at = link[at]
        if at != -1:
            to = step[at][c]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                twin = len(step)
                step.append(dict(step[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at != -1 and step[at].get(c) == to:
                    step[at][c] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    return step


class Languages:
    """Automata of some languages as tables: row state, column byte class; 0 is no transition."""

    def __init__(self, samples: dict[str, bytes]):
        self.names = sorted(samples)
        seen = sorted({b for s in samples.values() for b in s})
        self.classes = np.zeros(256, np.int64)  # class 0: bytes in no sample
        self.classes[seen] = np.arange(1, len(seen) + 1)
        self.width = len(seen) + 1
        self.tables, self.bits = [], []
        for name in self.names:
            sample = np.frombuffer(samples[name], np.uint8)
            steps = suffix_automaton(self.classes[sample].tolist())
            table = np.zeros((len(steps), self.width), np.int32)
            for state, to in enumerate(steps):
                for c, target in to.items():
                    table[state, c] = target
            self.tables.append(table.ravel())
            self.bits.append(np.log2(max(len(sample), 2)))

    def entropies(self, column) -> np.ndarray:
        """Bits per byte of each text by each language; nothing to parse counts as none."""
        data, offsets = letters(column)
        sizes = np.diff(offsets)
        n = len(sizes)
        out = np.zeros((n, len(self.names)))
        many = -(-sizes // CHUNK)
        if not many.sum():
            return out
        text = np.repeat(np.arange(n), many)
        rank = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        begin = offsets[text] + rank * CHUNK
        length = np.minimum(CHUNK, offsets[text + 1] - begin)
        order = np.argsort(-length, kind="stable")
        begin, length, text = begin[order], length[order], text[order]
        classes = self.classes[data]
        active = np.searchsorted(-length, -np.arange(CHUNK), "left")  # chunks longer than a step
        for i, table in enumerate(self.tables):
            state, phrases = np.zeros((2, len(begin)), np.int32)
            for t in range(CHUNK):
                m = int(active[t])
                if not m:
                    break
                c = classes[begin[:m] + t]
                to = table[state[:m] * np.int64(self.width) + c]
                miss = to == 0
                phrases[:m] += miss | (state[:m] == 0)
                to[miss] = table[c[miss]]
                state[:m] = to
            total = np.bincount(text, weights=phrases, minlength=n)
            out[:, i] = total * self.bits[i] / np.maximum(sizes, 1)
        return out


def samples(docs: DataFrame, sample_docs: int = 96, doc_pieces: int = 4, piece: int = 500, sample_bytes: int = 32_768):
    """Labelled text per language, joined by blanks."""
    usable = docs.where("lang is not null and doc_id is not null and text is not null")
    usable = usable.select("lang", "text", F.xxhash64("text").alias("_hash"))
    # Copies go before texts are ranked; ranks above sample_docs go before the shuffle by language.
    by = Window.partitionBy("lang").orderBy("_hash")
    ranked = usable.select("lang", "_hash").distinct().withColumn("_rank", F.row_number().over(by))
    few = materialize(ranked.where(F.col("_rank") <= sample_docs), "language-sample")
    own = usable.join(few, ["lang", "_hash"]).groupBy("lang", "_hash", "_rank").agg(F.min("text").alias("text"))
    places = F.sequence(F.lit(0), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / piece).cast("int"))
    drawn = F.slice(F.array_sort(F.transform(
        places, lambda i: F.struct(F.xxhash64("_hash", i).alias("order"), i.alias("place"))
    )), 1, doc_pieces)
    pieces = F.transform(drawn, lambda d: F.substring(F.col("text"), d["place"] * piece + 1, F.lit(piece)))
    got = own.select("lang", "_rank", F.posexplode(pieces).alias("_turn", "text")).collect()
    out: dict[str, bytes] = {}
    for row in sorted(got, key=lambda r: (r.lang, r._turn, r._rank)):
        held = out.get(row.lang, b"")
        if len(held) < sample_bytes:
            out[row.lang] = (held + letters(pa.array([row.text + "\n"]))[0].tobytes())[:sample_bytes]
    return {k: v for k, v in out.items() if v.strip()}


def identify(docs: DataFrame, learned: dict[str, bytes], block: int = 8, part_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the runner-up's share of both entropies, from 0.5 to 1."""
    spark = docs.sparkSession
    state = ["_best", "_first", "_second"]
    rows = docs.drop("lang_pred", "score", *state)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    ordered = sorted(learned)
    rows = rows.withColumns({"_best": F.lit(None).cast("string"), "_first": F.lit(float("inf")), "_second": F.lit(float("inf"))})
    for at in range(0, len(ordered), block):
        sent = spark.sparkContext.broadcast(Languages({k: learned[k] for k in ordered[at : at + block]}))

        def parse(batches, sent=sent):
            known = sent.value
            for batch in batches:
                for part in T.slices(batch, "text", part_bytes):
                    cost = known.entropies(part.column("text"))
                    best = part.column("_best").to_pylist()
                    first, second = (part.column(c).to_numpy(zero_copy_only=False).copy() for c in state[1:])
                    for i, name in enumerate(known.names):
                        better = cost[:, i] < first
                        second = np.where(better, first, np.minimum(second, cost[:, i]))
                        first = np.where(better, cost[:, i], first)
                        for r in np.flatnonzero(better):
                            best[r] = name
                    kept = [part.column(c) for c in part.schema.names if c not in state]
                    names = [c for c in part.schema.names if c not in state]
                    yield pa.RecordBatch.from_arrays(
                        [*kept, pa.array(best, pa.string()), pa.array(first), pa.array(second)], [*names, *state]
                    )

        rows = rows.mapInArrow(parse, f"{names}, _best string, _first double, _second double")
        if at + block < len(ordered):
            rows = materialize(rows, "languages")
    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.col("_best").isNotNull()
    share = F.when(F.col("_second") == float("inf"), 1.0).otherwise(F.col("_second") / (F.col("_first") + F.col("_second")))
    return rows.withColumn("lang_pred", F.when(known, F.col("_best")).otherwise("und")).withColumn(
        "score", F.when(known, F.coalesce(share, F.lit(0.5))).otherwise(0.0)
    ).drop(*state)
