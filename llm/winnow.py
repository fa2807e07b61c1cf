"""Benchmark decontamination by winnowing.

Of every ten consecutive words, the five-word gram of least hash is kept, in documents as in benchmark
items. Ten words that both have are ten equal words, so both keep the same gram of them: no shared
span of ten words or more is missed. Kept grams of documents are looked up among those of the items,
and each hit is extended word by word in both directions. Items of fewer than ten words count as a
whole; for their few lengths, all grams of a document are looked up.

Items are read in blocks of at most ``block_words`` words, so what is broadcast has a bound whatever
the size of the benchmark; every document meets every block, and its hits are merged.

Nulls and ties: a null text has no words, an item without words never occurs, a null item_id reads as
the empty text. Repeated documents are reported as often as they occur, items of equal id count once.
Empty tables are fine. Columns that the result adds replace columns of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diarist.scratch import materialize
from llm import text as T
from llm.naming import free_names

WINDOW, GRAM = 10, 5
ADDED = "n_words long, spans array<struct<first:int,end:int>>, items array<string>"


def kept_grams(words: np.ndarray, texts: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Places and hashes of the grams that winnowing keeps; ``texts`` tells which text a word is of."""
    grams = T.gram_hash(words, gram)
    wide = window - gram + 1
    m = len(grams) - wide + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, place = grams[:m].copy(), np.zeros(m, np.int8)
    for j in range(1, wide):
        now = grams[j : j + m]
        better = now < least
        least[better] = now[better]
        place[better] = j
    whole = texts[:m] == texts[window - 1 : window - 1 + m]
    keep = np.zeros(len(grams), bool)
    keep[(np.arange(m) + place)[whole]] = True
    at = np.flatnonzero(keep)
    return at, grams[at]


def tokens(column):
    """Word hashes and the text of each word."""
    data, offsets = T.buffer(column)
    data = T.LOWER[data]
    starts, ends, texts = T.spans(T.ALNUM[data], offsets)
    return T.span_hash(T.prefix_hash(data), starts, ends), texts


class Block:
    """Some items, ready to be looked up."""

    def __init__(self, ids: list[str], column, window: int = WINDOW, gram: int = GRAM):
        self.ids, self.window, self.gram = ids, window, gram
        self.words, self.item = tokens(column)
        counts = np.bincount(self.item, minlength=len(ids))
        at, grams = kept_grams(self.words, self.item, window, gram)
        order = np.argsort(grams, kind="stable")
        self.at, self.grams = at[order], grams[order]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        first = np.searchsorted(self.item, np.arange(len(ids)))
        for n in range(1, window):
            if len(own := np.flatnonzero(counts == n)):
                whole = np.array([T.gram_hash(self.words[first[i] : first[i] + n], n)[0] for i in own])
                order = np.argsort(whole, kind="stable")
                self.short[n] = whole[order], own[order]

    def hits(self, words: np.ndarray, texts: np.ndarray):
        """First word, end and item of each matching run; runs of one item may overlap."""
        found = []
        at, grams = kept_grams(words, texts, self.window, self.gram)
        for rows, post in _pairs(self.grams, grams):
            found.append(self._extend(words, texts, at[rows], self.at[post]))
        for n, (whole, own) in self.short.items():
            grams = T.gram_hash(words, n)
            inside = np.flatnonzero(texts[: len(grams)] == texts[n - 1 : n - 1 + len(grams)])
            for rows, post in _pairs(whole, grams[inside]):
                start = inside[rows]
                found.append((start, start + n, own[post]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))

    def _extend(self, words, texts, here, there):
        reach = self.window - self.gram

        def same(step):
            a, b = here + step, there + step
            ok = (a >= 0) & (a < len(words)) & (b >= 0) & (b < len(self.words))
            a, b = np.where(ok, a, 0), np.where(ok, b, 0)
            return ok & (words[a] == self.words[b]) & (texts[a] == texts[here]) & (self.item[b] == self.item[there])

        whole = np.ones(len(here), bool)
        for step in range(self.gram):
            whole &= same(step)
        left, on = np.zeros(len(here), np.int64), whole.copy()
        for step in range(1, reach + 1):
            on &= same(-step)
            left += on
        right, on = np.zeros(len(here), np.int64), whole.copy()
        for step in range(reach):
            on &= same(self.gram + step)
            right += on
        ok = whole & (left + self.gram + right >= self.window)
        return (here - left)[ok], (here + self.gram + right)[ok], self.item[there[ok]]


def _pairs(sorted_keys: np.ndarray, keys: np.ndarray, most: int = 1 << 20):
    """Index pairs of equal keys, in parts of about ``most`` pairs."""
    if not len(sorted_keys) or not len(keys):
        return
    low = np.searchsorted(sorted_keys, keys, "left")
    rows = np.flatnonzero(sorted_keys[np.minimum(low, len(sorted_keys) - 1)] == keys)
    low = low[rows]
    count = np.searchsorted(sorted_keys, keys[rows], "right") - low
    ends = np.cumsum(count)
    begin = 0
    while begin < len(rows):
        done = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, done + most, "right")))
        c = count[begin:stop]
        shift = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        yield np.repeat(rows[begin:stop], c), np.repeat(low[begin:stop], c) + shift
        begin = stop


def _union(first, end, texts):
    """Overlapping and touching runs of a text as one, in order."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    head = np.ones(len(first), bool)
    head[1:] = (first[1:] > end[:-1]) | (texts[first[1:]] != texts[first[:-1]])
    last = np.append(np.flatnonzero(head)[1:] - 1, len(first) - 1)
    return first[head], end[last]


def _scan(block, part_bytes: int):
    """A function for mapInArrow: the rows with ADDED."""

    def run(batches):
        own = block.value
        ids = np.array(own.ids, object)
        for batch in batches:
            for part in T.slices(batch, "text", part_bytes):
                words, texts = tokens(part.column("text"))
                n = part.num_rows
                counts = np.bincount(texts, minlength=n)
                begin = np.cumsum(counts) - counts
                first, end, item = own.hits(words, texts)
                row = texts[first]
                items = [[] for _ in range(n)]
                pairs = np.unique(np.stack([row, item]), axis=1) if len(row) else np.zeros((2, 0), int)
                for r, i in zip(*pairs):
                    items[r].append(ids[i])
                spans = [[] for _ in range(n)]
                if len(first):
                    for x, y in zip(*(x.tolist() for x in _union(first, end, texts))):
                        r = texts[x]
                        spans[r].append({"first": x - begin[r], "end": y - begin[r]})
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(counts, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
                     pa.array(items, pa.list_(pa.string()))],
                    [*part.schema.names, "n_words", "spans", "items"],
                )

    return run


def _blocks(benchmark: DataFrame, block_words: int):
    """Items in parts that hold at most ``block_words`` words by a bound on their bytes."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text")
    ids, texts, held = [], [], 0
    for row in rows.where("text is not null").toLocalIterator():
        size = len(row.text) // 2 + 1
        if ids and held + size > block_words:
            yield Block(ids, pa.array(texts, pa.string()))
            ids, texts, held = [], [], 0
        ids.append(row.i)
        texts.append(row.text)
        held += size
    yield Block(ids, pa.array(texts, pa.string()))


def matches(docs: DataFrame, benchmark: DataFrame, block_words: int = 2_000_000, part_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` with ``n_words``, the ``spans`` of words that lie in an occurrence, and the ``items`` that occur."""
    spark = docs.sparkSession
    docs = docs.drop("n_words", "spans", "items")
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    schema = f"{names}, {ADDED}"
    parts, last = [], None
    for block in _blocks(benchmark, block_words):
        if last is not None:
            parts.append(last)
        last = docs.mapInArrow(_scan(spark.sparkContext.broadcast(block), part_bytes), schema)
    if not parts:
        return last
    # Several blocks: keep only documents with hits of each, and merge. Repeated rows have equal hits.
    found = None
    own, text, own_spans, own_items = free_names(last.columns, "_id", "_text", "_spans", "_items")
    key = [F.col("doc_id").alias(own), F.xxhash64("text").alias(text)]
    for i, part in enumerate([*parts, last]):
        hit = part.where("size(items) > 0").select(*key, "spans", "items").distinct()
        hit = materialize(hit, f"winnow-{i}")
        found = hit if found is None else found.unionByName(hit)
    found = found.groupBy(own, text).agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias(own_spans),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias(own_items),
    )
    both = last.drop("spans", "items").join(
        found, F.col("doc_id").eqNullSafe(F.col(own)) & F.xxhash64("text").eqNullSafe(F.col(text)), "left"
    )
    return both.withColumn("spans", F.coalesce(own_spans, F.array().cast("array<struct<first:int,end:int>>"))).withColumn(
        "items", F.coalesce(own_items, F.array().cast("array<string>"))
    ).drop(own, text, own_spans, own_items)


def report(matched: DataFrame) -> DataFrame:
    """``matched`` with ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` in place of spans and items."""
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["first"], s["upto"]))).alias("n"),
            F.greatest(s["upto"], x["end"]).alias("upto"),
        ),
        lambda s: s["n"],
    )
    ids = F.array_sort(F.array_distinct("items"))
    return (
        matched.withColumn("n_hit", covered)
        .withColumn("n_items", F.size(ids).cast("long"))
        .withColumn("items_sha256", F.sha2(F.concat_ws(",", ids).cast("binary"), 256))
        .withColumn("contaminated", F.col("n_hit") > 0)
        .drop("spans", "items")
    )
