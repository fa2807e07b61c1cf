"""SimHash near duplicates, found by BK-trees.

A fingerprint has a bit where most hashes of a text's shingles have it. Two fingerprints link if they
differ in ``radius`` bits or fewer. The bits are cut into radius + 2 blocks: linked fingerprints agree
in two blocks at least, so every pair of blocks deals fingerprints into groups, and each link lies
inside a group. A group is held in BK-trees, whose children are keyed by their distance to the parent;
a search follows only the edges within the radius. A group of more than ``tree_size`` fingerprints is
cut into slices; a task holds the tree of one slice and the fingerprints of one more, which search it, so
that each two slices meet in one task and no task holds the group. A group yields the links that join its parts and no more, so a mass of near copies doesn't yield all its pairs.
Components of the links follow.

Nulls and ties: null and empty texts have fingerprint zero, which links like any other. Equal texts
share a fingerprint and one place in the trees. Rows without doc_id are in components too, but do not
name them. Empty tables give an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diarist.scratch import materialize
from llm import text as T
from llm.components import components


def shingle_bounds(data: np.ndarray, offsets: np.ndarray, width: int):
    """Blank runs as one space: the bytes, starts and ends of all shingles, and how many each text has."""
    data = T.LOWER[data]
    member = T.NOT_BLANK[data]
    starts, ends, texts = T.spans(member, offsets)
    keep = member.copy()
    keep[ends[ends < len(data)]] = True  # the byte after a word; another word there shares no text with it
    place = np.cumsum(keep)
    plain = np.where(member, data, 32).astype(np.uint8)[keep]
    a = place[starts] - 1 if len(starts) else starts
    b = a + (ends - starts)
    count = np.bincount(texts, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    head = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    tail = head + np.repeat(np.minimum(width, np.maximum(count, 1)), n) - 1
    return plain, a[head], b[tail], n


def fingerprints(column, width: int = 4, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit fingerprints of a column of texts."""
    plain, begin, end, count = shingle_bounds(*T.buffer(column), width)
    plain, of = plain.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array([of(plain[a:b], seed) for a, b in zip(begin.tolist(), end.tolist())], "<u8")
    out = np.zeros(len(count), "<u8")
    stop = np.cumsum(count)
    for i in np.flatnonzero(count):
        own = hashes[stop[i] - count[i] : stop[i]]
        ones = np.zeros(64, np.int64)
        for at in range(0, len(own), 1 << 16):
            part = own[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > len(own), bitorder="little").view("<u8")[0]
    return out


def fingerprint(docs: DataFrame, width: int = 4, seed: int = 42, part_bytes: int = 4 << 20) -> DataFrame:
    """``doc_id`` and ``bits``, the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            for part in T.slices(batch, "text", part_bytes):
                bits = fingerprints(part.column("text"), width, seed).view("<i8")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(bits)], ["doc_id", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, bits long")


class BKTree:
    """Integers by their Hamming distance."""

    def __init__(self):
        self.values, self.children = [], []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        at, new = 0, len(self.values) - 1
        while at != new:
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), new)

    def near(self, value: int, radius: int) -> list[int]:
        """Places of the values within ``radius`` bits."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            low, high = d - radius, d + radius
            todo += [c for k, c in self.children[at].items() if low <= k <= high]
        return found


def _group_links(members: list[int], searching: list[int], radius: int):
    """Links that join the parts of a group: of members with each other, and of others with members."""
    tree, parent = BKTree(), []

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for value, joins in [(v, True) for v in members] + [(v, False) for v in searching]:
        near = tree.near(value, radius)
        own = len(parent) if joins else None
        if joins:
            parent.append(own)
        for at in near:
            if own is None:
                own = top(at)
                yield value, tree.values[at]
            elif top(at) != top(own):
                parent[top(at)] = top(own)
                yield value, tree.values[at]
        if joins:
            tree.add(value)


def _link_groups(radius: int):
    """For rows ordered by group, with the members of a group's tree before those that only search it."""

    def linked(pair, kept, shard, bits, member):
        new = np.ones(len(bits) + 1, bool)
        new[1:-1] = (pair[1:] != pair[:-1]) | (kept[1:] != kept[:-1]) | (shard[1:] != shard[:-1])
        at = np.flatnonzero(new)
        several = np.flatnonzero(np.diff(at) > 1)
        out = []
        for a, b in zip(at[several].tolist(), at[several + 1].tolist()):
            values = bits[a:b].tolist()
            m = int(member[a:b].sum())
            out += _group_links(values[:m], values[m:], radius)
        links = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            now[3] = now[3].view(np.uint64)
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            differ = (held[0] != held[0][-1]) | (held[1] != held[1][-1]) | (held[2] != held[2][-1])
            last = int(np.flatnonzero(differ)[-1]) + 1 if differ.any() else 0
            if last:
                yield linked(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if held is not None and len(held[0]):
            yield linked(*held)

    return run


def deal(distinct: DataFrame, radius: int = 4, tree_size: int = 20_000) -> DataFrame:
    """Distinct ``bits`` by group (``pair``, ``kept``) and task (``shard``); ``member`` of its tree, or searching it."""
    blocks = radius + 2
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    pairs = [masks[i] | masks[j] for i, j in combinations(range(blocks), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in pairs]
    keys = F.array(*(
        F.struct(F.lit(i).cast("short").alias("pair"), F.col("bits").bitwiseAND(F.lit(m).cast("long")).alias("kept"))
        for i, m in enumerate(signed)
    ))
    rows = distinct.select("bits", F.explode(keys).alias("k")).select("k.pair", "k.kept", "bits")
    large = materialize(
        rows.groupBy("pair", "kept").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tree_size).select(
            "pair", "kept", F.ceil(F.col("n") / tree_size).cast("int").alias("shards")
        ), "large-groups",
    )
    if large.isEmpty():
        dealt = rows.select("pair", "kept", F.lit(0).alias("shard"), "bits", F.lit(True).alias("member"))
    else:
        known = rows.join(large, ["pair", "kept"], "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
        dealt = known.withColumn("slice", F.pmod(F.xxhash64("bits"), F.col("shards"))).withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
        ).select(
            "pair", "kept", (F.least("slice", "other") * F.col("shards") + F.greatest("slice", "other")).alias("shard"), "bits",
            (F.col("slice") <= F.col("other")).alias("member"),
        )
    return dealt


def links(distinct: DataFrame, radius: int = 4, tree_size: int = 20_000) -> DataFrame:
    """Links ``a``, ``b`` among the distinct ``bits`` that keep all components whole."""
    dealt = deal(distinct, radius, tree_size)
    grouped = dealt.repartition("pair", "kept", "shard").sortWithinPartitions(
        "pair", "kept", "shard", F.desc("member"), "bits"
    )
    return grouped.mapInArrow(_link_groups(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42, tree_size: int = 20_000) -> DataFrame:
    """Per row: ``doc_id``, ``bits`` and ``component_id``, the smallest doc_id among all that are linked to it."""
    prints = materialize(fingerprint(docs, width, seed), "fingerprints")
    distinct = materialize(prints.groupBy("bits").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct, radius, tree_size))
    linked = roots.join(distinct, roots.node == distinct.bits).select("bits", "root", "least")
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("of")), "root").select("bits", "of")
    by_bits = distinct.join(named, "bits", "left").select("bits", F.coalesce("of", "least").alias("component_id"))
    return prints.join(by_bits, "bits").select("doc_id", "bits", "component_id")
