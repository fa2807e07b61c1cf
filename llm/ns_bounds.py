"""Centroid clustering of integer vectors with norm-of-sum bounds.

Each vector keeps, for every centroid, the exact distance at the round in which it was last computed. All
centroids of all rounds are retained, so a kept distance is loosened by how far that centroid is now from where it was
then: the norm of the total displacement, not the sum of the drifts of each round. If no other centroid can be
as near as the vector's own, nothing is computed; else the own distance is made exact, and then those that
still fail. Bounds are compared with a margin for rounding and ties are always computed, so assignments are exact.

Vectors lie in blocks of a few thousand, written once in a table bucketed by block. A round reads them, writes
their state (clusters, kept distances and rounds) and the sums of the vectors that changed, and never moves or rewrites a vector.
Sums of each block and cluster are added by Spark; the driver sees one row for each cluster.

Nulls and ties: vectors of another size, with null or non-finite components, or null themselves, are left out. Equal
distances go to the smaller number. Rows without id are clustered; repeated rows count as often as they occur. Fewer rows
than clusters give fewer clusters, and no rows an empty result. Further columns are not read. Scaled components beyond
2 ** 27 raise an error, as squared distances would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diarist.scratch import materialize, remove, scratch_path

LARGEST = 1 << 27
STATES = "block long, state binary, cluster long, change array<long>"


def kept_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", size: int = 64) -> DataFrame:
    """``key`` and ``v`` of the vectors of ``size`` finite components."""
    x = F.col(column).cast("array<double>")
    good = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False)))
    return vectors.where((F.size(column) == size) & good).select(F.col(key).alias("key"), x.alias("v"))


def to_integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); the product is exact for a scale that is a power of two."""
    out = np.floor(x * float(scale))
    if len(out) and np.abs(out).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST} after scaling: squared distances don't fit 64 bits")
    return out.astype(np.int32)


def starting_centroids(kept: DataFrame, clusters: int, scale: int, salt: str = "3:") -> np.ndarray:
    """The vectors whose salted ids have the least SHA-256, in that order; equal ids go by the vector."""
    hashed = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = kept.orderBy(hashed, "key", "v").limit(clusters).select("v").collect()
    return np.array([to_integers(np.array(r.v), scale) for r in rows], np.int64)


def write_vectors(kept: DataFrame, scale: int, rows: int = 4096) -> tuple[DataFrame, str, str]:
    """The blocks (``block``, ``keys``, ``vectors``), their table and their folder."""
    spark = kept.sparkSession

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                x = to_integers(part.column("v").flatten().to_numpy(zero_copy_only=False), scale)
                keys = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("key"))
                yield pa.RecordBatch.from_arrays([keys, pa.array([x.astype("<i4").tobytes()], pa.binary())], ["keys", "vectors"])

    kind = kept.schema["key"].dataType.simpleString()
    blocks = kept.mapInArrow(pack, f"keys array<{kind}>, vectors binary").withColumn("block", F.monotonically_increasing_id())
    name = f"vectors_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (blocks.write.bucketBy(buckets, "block").sortBy("block").option("path", path).option("compression", "zstd")
     .saveAsTable(name))
    return spark.table(name), name, path


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows."""
    out = np.empty(len(v), np.int64)
    for at in range(0, len(v), 1 << 14):
        d = v[at : at + (1 << 14)].astype(np.int64) - c[at : at + (1 << 14)]
        out[at : at + (1 << 14)] = np.einsum("ij,ij->i", d, d)
    return out


class State:
    """Of a block: clusters, and for each centroid the squared distance and the round it was computed in."""

    def __init__(self, cluster: np.ndarray, near: np.ndarray, seen: np.ndarray):
        self.cluster, self.near, self.seen = cluster, near, seen

    def pack(self) -> bytes:
        return self.cluster.astype("<i4").tobytes() + self.near.astype("<i8").tobytes() + self.seen.astype("<u2").tobytes()

    @classmethod
    def unpack(cls, data: bytes, k: int) -> State:
        n = len(data) // (4 + 10 * k)
        near = np.frombuffer(data, "<i8", n * k, 4 * n).reshape(n, k).copy()
        seen = np.frombuffer(data, "<u2", n * k, 4 * n + 8 * n * k).reshape(n, k).copy()
        return cls(np.frombuffer(data, "<i4", n).copy(), near, seen)


def assign(v: np.ndarray, state: State | None, history: np.ndarray) -> tuple[State, int]:
    """The nearest centroid of the last round for each vector, and how many distances were computed.

    ``history`` has the centroids of all rounds (round, cluster, component).
    """
    now, (rounds, k, _) = history[-1], history.shape
    n, last = len(v), rounds - 1
    if state is None:
        near = np.stack([squared(v, np.broadcast_to(c, v.shape)) for c in now], axis=1) if n else np.zeros((0, k), np.int64)
        return State(near.argmin(axis=1).astype(np.int32) if n else np.zeros(0, np.int32), near, np.full((n, k), last)), n * k
    moved = np.sqrt(((history - now) ** 2).sum(axis=2).astype(float))  # of each centroid since each round
    own, rows = state.cluster, np.arange(n)
    root, away = np.sqrt(state.near.astype(float)), moved[state.seen, np.arange(k)]
    slack = 1e-9 * (root + away) + 1e-9
    upper = (root + away + slack)[rows, own]
    lower = root - away - slack
    lower[rows, own] = np.inf
    ask = np.flatnonzero((lower <= upper[:, None]).any(axis=1))
    exact = squared(v[ask], now[own[ask]])
    state.near[ask, own[ask]], state.seen[ask, own[ask]] = exact, last
    upper = np.sqrt(exact.astype(float)) * (1 + 1e-9) + 1e-9
    failed = lower[ask] <= upper[:, None]
    i, j = np.nonzero(failed)
    state.near[ask[i], j] = squared(v[ask[i]], now[j])
    state.seen[ask[i], j] = last
    failed[np.arange(len(ask)), own[ask]] = True
    among = np.where(failed, state.near[ask], np.iinfo(np.int64).max)
    state.cluster[ask] = among.argmin(axis=1)  # of equal distances the smaller number
    return state, len(ask) + len(i)


def _advance(blocks: DataFrame, states: DataFrame | None, history: np.ndarray) -> DataFrame:
    """New states by block; and from each task, a row without block for each cluster whose sums and count change."""
    k, size = history.shape[1:]
    first = states is None

    def run(batches):
        change = np.zeros((k, size + 1), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                v = np.frombuffer(batch.column("vectors")[i].as_py(), "<i4").reshape(-1, size)
                before = None if first else State.unpack(batch.column("state")[i].as_py(), k)
                old = None if before is None else before.cluster.copy()
                after, _ = assign(v, before, history)
                one = np.concatenate([v.astype(np.int64), np.ones((len(v), 1), np.int64)], axis=1)
                new = np.ones(len(v), bool) if old is None else after.cluster != old
                for j in range(k):
                    change[j] += one[new & (after.cluster == j)].sum(axis=0)
                    if old is not None:
                        change[j] -= one[new & (old == j)].sum(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("block").slice(i, 1), pa.array([after.pack()], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64()))],
                    ["block", "state", "cluster", "change"],
                )
        some = np.flatnonzero(change.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.binary()), pa.array(some), pa.array(change[some].tolist(), pa.list_(pa.int64()))],
            ["block", "state", "cluster", "change"],
        )

    return _with_state(blocks, states).mapInArrow(run, STATES)


def _with_state(blocks: DataFrame, states: DataFrame | None) -> DataFrame:
    if states is None:
        return blocks.select("block", "keys", "vectors")
    return blocks.join(states.where("block is not null").select("block", "state"), "block")


def _assigned(blocks: DataFrame, states: DataFrame | None, history: np.ndarray, kind: str) -> DataFrame:
    """``key``, ``cluster`` and exact squared ``distance`` of every vector, by the last centroids."""
    k, size = history.shape[1:]
    first = states is None

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                v = np.frombuffer(batch.column("vectors")[i].as_py(), "<i4").reshape(-1, size)
                before = None if first else State.unpack(batch.column("state")[i].as_py(), k)
                after, _ = assign(v, before, history)
                keys = batch.column("keys").slice(i, 1).flatten()
                distance = squared(v, history[-1][after.cluster])
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(after.cluster.astype(np.int32)), pa.array(distance)], ["key", "cluster", "distance"]
                )

    return _with_state(blocks, states).mapInArrow(run, f"key {kind}, cluster int, distance long")


def cluster_vectors(
    vectors: DataFrame, clusters: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024,
    key: str = "vec_id", column: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """``key``, ``cluster`` and squared ``distance`` of every kept vector, and the final centroids.

    Each round assigns all vectors and moves every centroid that has some to floor(sum / count), by component.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, key, column, size)
    kind = kept.schema["key"].dataType.simpleString()
    start = starting_centroids(kept, clusters, scale)
    if not len(start):
        return spark.createDataFrame([], f"{key} {kind}, cluster int, distance long"), np.zeros((0, size), np.int64)
    blocks, name, folder = write_vectors(kept, scale)
    history, states, path = [start], None, None
    total = [[0] * (size + 1) for _ in start]
    for r in range(rounds):
        before, path = path, scratch_path(spark, f"bounds-{r}")
        _advance(blocks, states, np.stack(history)).write.option("compression", "zstd").parquet(path)
        states = spark.read.schema(STATES).parquet(path)
        if before:
            remove(spark, before)
        change = states.where("cluster is not null").groupBy("cluster").agg(
            F.array(*[F.sum(F.get("change", F.lit(i)).cast("decimal(38,0)")) for i in range(size + 1)]).alias("change")
        )
        for row in change.collect():  # one for each cluster
            total[row.cluster] = [t + int(x) for t, x in zip(total[row.cluster], row.change)]
        history.append(np.array([
            [x // t[-1] for x in t[:-1]] if t[-1] else old for t, old in zip(total, history[-1].tolist())
        ], np.int64))
    out = materialize(_assigned(blocks, states, np.stack(history), kind), "clusters")
    spark.sql(f"DROP TABLE {name}")
    remove(spark, folder, *([path] if path else []))
    return out.withColumnRenamed("key", key), history[-1]


def digests(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """With the inertia of its cluster and of all, and the digest of its cluster's final centroid."""
    spark = found.sparkSession
    rows = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    named = spark.createDataFrame(rows, "cluster int, centroid_sha256 string")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = found.agg(F.sum("distance").alias("inertia"))
    small = named.join(sums, "cluster").join(F.broadcast(whole), F.lit(True))  # a row for each cluster
    return found.join(F.broadcast(small), "cluster")
