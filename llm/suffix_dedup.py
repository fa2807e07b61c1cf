"""Removal of repeated byte strings, by suffix arrays.

A byte goes if a string of ``width`` bytes that covers it also starts in a document with a smaller doc_id.
Sorting all suffixes of a corpus would move many times its size, so suffixes that cannot matter are ruled
out first, exactly:

1. Every ``width`` bytes hold the k-gram of least hash among their k-grams, wherever they stand: an anchor.
   Equal strings have equal anchors at equal places, so a string is repeated only if its anchor's k-gram is.
   With an anchor goes its context, all bytes of all strings that hold it.
2. Anchors meet by their k-gram, a record for each block and k-gram. If nobody else has it, none of its
   strings is repeated; if a smaller document has the same context, all are.
3. What is left, k-grams in several contexts, is decided by the distributed difference-cover algorithm:
   contexts are dealt by k-gram, and in each bucket suffixes at two of three places are sorted by triples,
   with recursion on the names of triples, the others are merged in, and adjacent prefixes are compared.
   A k-gram with more than ``many`` contexts, or with several in a block, would make a large bucket; its
   strings are dealt by the hash of the whole string instead, one record for each block and string.

No bucket gets more than a record of each block for a key, however frequent that is. Hashes have 64 bits
for k-grams and strings and 40 more for contexts under one k-gram.

Nulls and ties: null texts are empty, a row without doc_id comes after all others. Rows of equal doc_id
don't remove from each other. Empty tables give an empty result. Further columns are not kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diarist.scratch import materialize
from llm import blocks as B
from llm import text as T
from llm.difference_cover import repeated_windows

NONE, COVERED, CONTEXT, STRINGS = range(4)  # what becomes of a record
SAME_TEXT, SEVERAL = 0, 1  # contexts of a k-gram that has several in one block: in one document, or in more


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        values = pick(values[:-have], values[have:])
        have *= 2
    return pick(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


def anchors(data: np.ndarray, offsets: np.ndarray, width: int, gram: int):
    """Anchors of all strings of ``width`` bytes: place, k-gram key, begin and end of the context, context hash, text."""
    out = []
    sizes = np.diff(offsets)
    cut = np.searchsorted(offsets, np.arange(0, max(int(offsets[-1]), 1), 1 << 20))
    cut = np.unique(np.append(cut, len(sizes)))
    for a, b in zip(cut[:-1], cut[1:]):
        out.append(_anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width, gram, offsets[a], a))
    kinds = (np.int64, np.uint64, np.int64, np.int64, np.uint64, np.int64)
    return [np.concatenate([np.zeros(0, k), *(o[i] for o in out if o)]) for i, k in enumerate(kinds)]


def _anchors(data, offsets, width, gram, shift, first_text):
    n, wide = len(data), width - gram + 1
    if n < width:
        return None
    prefix = T.prefix_hash(data)
    back = T.powers(T._BACK, n + 1)
    hashes = (prefix[gram:] - prefix[:-gram]) * back[: n - gram + 1]
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    least = _sliding(hashes, wide, np.minimum)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        least[max(a, b - width + 1) : b] = 0  # strings that would cross into the next text
    none = np.zeros(wide - 1, np.uint64)
    held = _sliding(np.concatenate([none, least, none]), wide, np.maximum)
    at = np.flatnonzero((hashes == held) & (held > 0))
    text = np.searchsorted(offsets, at, "right") - 1
    begin = np.maximum(at - (wide - 1), offsets[text])
    end = np.minimum(at + width, offsets[text + 1])
    context = T.span_hash(prefix, begin, end) ^ T.mix(((at - begin) * 4096 + (end - begin)).astype(np.uint64))
    return at + shift, T.mix(hashes[at]), begin + shift, end + shift, context >> np.uint64(24), text + first_text


class Block:
    """The anchors of a block in the order of their keys, and one record for each key."""

    def __init__(self, rows: bytes, width: int, gram: int):
        self.width = width
        self.ids, self.numbers, self.data, self.offsets = B.unpack(rows)
        at, key, begin, end, context, text = anchors(self.data, self.offsets, width, gram)
        doc = self.numbers[text]
        order = np.lexsort((at, doc, key))
        self.at, self.key, self.begin, self.end = at[order], key[order], begin[order], end[order]
        self.context, self.doc = np.maximum(context[order], 2), doc[order]
        new = np.append(True, self.key[1:] != self.key[:-1]) if len(at) else np.zeros(0, bool)
        self.head = np.flatnonzero(new)
        self.record = np.cumsum(new) - 1
        if len(at):
            least = np.minimum.reduceat(self.context, self.head)
            most = np.maximum.reduceat(self.context, self.head)
            one_text = self.doc[self.head] == np.maximum.reduceat(self.doc, self.head)
            several = np.where(one_text, SAME_TEXT, SEVERAL).astype(np.uint64)
            self.record_context = np.where(least == most, least, several)
        else:
            self.record_context = np.zeros(0, np.uint64)

    def records(self):
        """Key, context and smallest document of each record."""
        return self.key[self.head], self.record_context, self.doc[self.head]

    def contexts(self, codes):
        """Records whose context is to be sorted."""
        return np.flatnonzero(codes == CONTEXT)

    def strings(self, codes):
        """Strings that are dealt one by one: hash, smallest document, and for each place its string."""
        own = np.flatnonzero(codes[self.record] == STRINGS)
        many = self.end[own] - self.begin[own] - self.width + 1
        starts = np.repeat(self.begin[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        docs = np.repeat(self.doc[own], many)
        starts, first = np.unique(starts, return_index=True)
        docs = docs[first]
        hashes = _string_hashes(self.data, starts, self.width)
        order = np.lexsort((docs, hashes))
        starts, docs, hashes = starts[order], docs[order], hashes[order]
        new = np.append(True, hashes[1:] != hashes[:-1]) if len(hashes) else np.zeros(0, bool)
        return hashes[new], docs[new], starts, docs, np.cumsum(new) - 1

    def covered(self, codes, masks, told) -> np.ndarray:
        """Which bytes go. ``masks``: for each record to sort, a bit for each repeated string; ``told``: for each string."""
        step = np.zeros(len(self.data) + 1, np.int64)

        def cover(begin, end):
            np.add.at(step, begin, 1)
            np.add.at(step, end, -1)

        code, first = codes[self.record], self.doc[self.head][self.record]
        one = self.record_context[self.record] > SEVERAL
        whole = one & (code != STRINGS) & ((code == COVERED) | (self.doc > first))
        # A context that is dealt as strings but equal to that of a smaller document here is covered as well.
        whole |= one & (code == STRINGS) & (self.doc > first)
        cover(self.begin[whole], self.end[whole])
        mask = np.zeros(len(codes), np.int64)
        mask[self.contexts(codes)] = masks
        partly = np.flatnonzero((code == CONTEXT) & (self.doc == first))
        for bit in range(int(mask.max(initial=0)).bit_length()):
            hit = partly[(mask[self.record[partly]] >> bit) & 1 > 0]
            cover(self.at[hit] - bit, self.at[hit] - bit + self.width)
        _, least, starts, docs, string = self.strings(codes)
        hit = (docs > least[string]) | told[string] if len(starts) else np.zeros(0, bool)
        cover(starts[hit], starts[hit] + self.width)
        return np.cumsum(step)[:-1] > 0


def _string_hashes(data, starts, width):
    """Hashes of strings at sorted starts, in parts, so that prefix sums stay small."""
    out = np.zeros(len(starts), np.uint64)
    for a in range(0, len(starts), 1 << 18):
        own = starts[a : a + (1 << 18)]
        low = int(own[0])
        for b in range(0, len(own), 1 << 14):
            some = own[b : b + (1 << 14)]
            low, high = int(some[0]), int(some[-1]) + width
            prefix = T.prefix_hash(data[low:high])
            out[a + b : a + b + len(some)] = T.span_hash(prefix, some - low, some - low + width)
    return out


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    """The answers of a block, put together in the order of buckets."""
    order = np.argsort(table.column("bucket").to_numpy(), kind="stable")
    values = table.column(column)
    return np.frombuffer(b"".join(values[int(i)].as_py() for i in order), kind)


def _answer_records(many: int):
    """For one bucket of k-grams: what becomes of each record."""

    def run(table: pa.Table) -> pa.Table:
        sizes = np.array(table.column("n").to_pylist())
        key, context, doc = (
            np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in (("keys", "<u8"), ("contexts", "<u8"), ("docs", "<i8"))
        )
        order = np.lexsort((doc, context, key))
        k, c, d = key[order], context[order], doc[order]
        new_key = np.append(True, k[1:] != k[:-1])
        new_class = new_key | np.append(True, c[1:] != c[:-1])
        head, heads = np.flatnonzero(new_key), np.flatnonzero(new_class)
        group = np.cumsum(new_key) - 1
        least_doc, most_doc = np.minimum.reduceat(d, head), np.maximum.reduceat(d, head)
        least_context = c[head]
        classes = np.add.reduceat(new_class.astype(np.int64), head)
        records = np.diff(np.append(head, len(k)))
        shared = (least_doc < most_doc) | (np.add.reduceat((c == SEVERAL).astype(np.int64), head) > 0)
        mixed = shared & (least_context <= SEVERAL)
        of_class = d[heads][np.cumsum(new_class) - 1]
        code = np.full(len(k), NONE, np.uint8)
        code[shared[group] & (d > of_class)] = COVERED
        open_ = shared[group] & (d == of_class) & (classes[group] > 1)
        code[open_] = np.where(records[group[open_]] <= many, CONTEXT, STRINGS)
        code[mixed[group]] = STRINGS
        out = np.empty(len(k), np.uint8)
        out[order] = code
        ends = np.cumsum(sizes)
        parts = [out[e - s : e] for s, e in zip(sizes, ends)]
        return pa.table({
            "block": table.column("block"), "bucket": table.column("bucket"), "kind": pa.array([0] * len(parts), pa.int32()),
            "answer": pa.array([p.tobytes() for p in parts], pa.binary()),
            "contexts": pa.array([int((p == CONTEXT).sum()) for p in parts], pa.int64()),
            "strings": pa.array([int((p == STRINGS).sum()) for p in parts], pa.int64()),
        })

    return run


def _answer_suffixes(width: int):
    """For one bucket of contexts: a suffix array of them, and a mask of repeated strings for each."""

    def run(table: pa.Table) -> pa.Table:
        sizes = np.array(table.column("n").to_pylist())
        doc, left, size = (
            np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in (("docs", "<i8"), ("lefts", "u1"), ("sizes", "u1"))
        )
        data = np.frombuffer(b"".join(table.column("data").to_pylist()), np.uint8)
        left, size = left.astype(np.int64), size.astype(np.int64)
        begin = np.cumsum(size) - size
        many = size - width + 1
        owner = np.repeat(np.arange(len(size)), many)
        starts = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())
        hit = repeated_windows(data, starts, doc[owner], width)
        bit = left[owner] - (starts - begin[owner])
        masks = np.zeros(len(size), np.int64)
        np.bitwise_or.at(masks, owner[hit], np.int64(1) << bit[hit])
        ends = np.cumsum(sizes)
        return pa.table({
            "block": table.column("block"), "bucket": table.column("bucket"), "kind": pa.array([1] * len(sizes), pa.int32()),
            "answer": pa.array([masks[e - s : e].astype("<i8").tobytes() for s, e in zip(sizes, ends)], pa.binary()),
        })

    return run


def _answer_strings(table: pa.Table) -> pa.Table:
    """For one bucket of strings: whether a smaller document has each."""
    sizes = np.array(table.column("n").to_pylist())
    key, doc = (np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in (("keys", "<u8"), ("docs", "<i8")))
    order = np.lexsort((doc, key))
    new = np.append(True, key[order][1:] != key[order][:-1])
    least = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.empty(len(key), np.uint8)
    out[order] = doc[order] > least
    ends = np.cumsum(sizes)
    return pa.table({
        "block": table.column("block"), "bucket": table.column("bucket"), "kind": pa.array([2] * len(sizes), pa.int32()),
        "answer": pa.array([out[e - s : e].tobytes() for s, e in zip(sizes, ends)], pa.binary()),
    })


ANSWER = "block long, bucket int, kind int, answer binary"
_ASKED_RECORDS = pa.schema([
    ("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("contexts", pa.binary()),
    ("docs", pa.binary()),
])
_ASKED_SECOND = pa.schema([
    ("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()),
    ("docs", pa.binary()), ("lefts", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary()),
])
_KEPT = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
    ("kept", pa.binary()),
])


def _small(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def remove_repeats(docs: DataFrame, width: int = 50, gram: int = 24, many: int = 2000, block_bytes: int = 8 << 20,
                   bucket_bytes: int = 24 << 20, sort_bytes: int = 1 << 20) -> DataFrame:
    """Per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the bytes that stay."""
    if not gram <= width <= gram + 60:
        raise ValueError("a string must hold 1 to 61 k-grams")
    stored = B.write_blocks(docs, block_bytes)
    total = stored.agg(F.sum("bytes")).first()[0] or 0
    density = 2 / (width - gram + 2)
    buckets = max(1, int(total * density * 24) // bucket_bytes + 1)

    def ask_records(batches):
        for batch in batches:
            for block, rows in zip(batch.column("block").to_pylist(), batch.column("rows")):
                key, context, doc = Block(rows.as_py(), width, gram).records()
                for bucket, a, b in B.cuts(key, buckets):
                    yield pa.RecordBatch.from_pylist([{
                        "block": block, "bucket": bucket, "n": b - a, "keys": _small(key[a:b]),
                        "contexts": _small(context[a:b]), "docs": _small(doc[a:b]),
                    }], _ASKED_RECORDS)

    asked = stored.select("block", "rows").mapInArrow(
        ask_records, "block long, bucket int, n long, keys binary, contexts binary, docs binary"
    )
    first = materialize(
        asked.groupBy("bucket").applyInArrow(_answer_records(many), ANSWER + ", contexts long, strings long"), "repeat-records"
    )
    counts = first.agg(F.sum("contexts"), F.sum("strings")).first()
    wide = 2 * width - gram
    context_buckets = max(1, (counts[0] or 0) * wide // sort_bytes + 1)
    string_buckets = max(1, (counts[1] or 0) * (width - gram + 1) * 16 // bucket_bytes + 1)

    def ask_second(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for block, rows in zip(left.column("block").to_pylist(), left.column("rows")):
            own = Block(rows.as_py(), width, gram)
            codes = _joined(right, "answer", np.uint8)
            record = own.contexts(codes)
            at = own.head[record]
            for bucket, a, b in B.cuts(own.key[at], context_buckets):
                some = at[a:b]
                size = own.end[some] - own.begin[some]
                place = np.repeat(own.begin[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                out.append({
                    "block": block, "kind": 1, "bucket": bucket, "n": b - a, "docs": _small(own.doc[some]),
                    "lefts": _small((own.at[some] - own.begin[some]).astype(np.uint8)),
                    "sizes": _small(size.astype(np.uint8)), "data": _small(own.data[place]), "keys": b"",
                })
            hashes, doc, *_ = own.strings(codes)
            for bucket, a, b in B.cuts(hashes, string_buckets):
                out.append({
                    "block": block, "kind": 2, "bucket": bucket, "n": b - a, "keys": _small(hashes[a:b]),
                    "docs": _small(doc[a:b]), "lefts": b"", "sizes": b"", "data": b"",
                })
        return pa.Table.from_pylist(out, _ASKED_SECOND)

    answers = first.select(F.col("block").alias("of"), "bucket", "kind", "answer")
    second = stored.select("block", "rows").groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(
        ask_second,
        "block long, kind int, bucket int, n long, keys binary, docs binary, lefts binary, sizes binary, data binary",
    )

    def answer_second(key, table):
        return _answer_suffixes(width)(table) if key[0].as_py() == 1 else _answer_strings(table)

    told = materialize(second.groupBy("kind", "bucket").applyInArrow(answer_second, ANSWER), "repeat-strings")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = np.array(right.column("kind").to_pylist())
        parts = [right.filter(pa.array(kinds == i)) for i in range(3)]
        out = []
        for rows in left.column("rows"):
            own = Block(rows.as_py(), width, gram)
            gone = own.covered(
                _joined(parts[0], "answer", np.uint8), _joined(parts[1], "answer", "<i8"), _joined(parts[2], "answer", np.uint8) > 0
            )
            _, _, of = T.spans(gone, own.offsets)
            n = len(own.ids)
            upto = np.append(0, np.cumsum(gone))
            removed = upto[own.offsets[1:]] - upto[own.offsets[:-1]]
            stay = own.data[~gone]
            ends = own.offsets - upto[own.offsets]
            kept = pa.Array.from_buffers(
                pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(stay)]
            ).cast(pa.binary())
            out.append(pa.table([
                own.ids, pa.array(np.diff(own.offsets)), pa.array(removed), pa.array(np.bincount(of, minlength=n)), kept
            ], schema=_KEPT))
        return pa.concat_tables(out) if out else _KEPT.empty_table()

    both = answers.unionByName(told.withColumnRenamed("block", "of"))
    return stored.select("block", "rows").groupBy("block").cogroup(both.groupBy("of")).applyInArrow(
        finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def digests(removed: DataFrame) -> DataFrame:
    """``removed`` with the sha256 of the kept bytes in their place."""
    return removed.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
