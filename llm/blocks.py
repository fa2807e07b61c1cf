"""Documents as blocks of a few megabytes, for work that asks all blocks something and carries on with the answers.

Blocks are written once, compressed, in a table bucketed by block: each later pass joins its answers to the
blocks without moving the texts again. Questions go to buckets in packed form, a row for each block and
bucket, so a shuffle moves bytes and not rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diarist.scratch import scratch_path
from llm import text as T

LAST = np.iinfo(np.int64).max  # the order of a row without doc_id


def write_blocks(docs: DataFrame, part_bytes: int = 8 << 20) -> DataFrame:
    """A written table: ``block``, its ``bytes`` of text, and its ``rows`` (doc_id, text) compressed."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def pack(batches):
        for batch in batches:
            for part in T.slices(batch, "text", part_bytes):
                part = pa.Table.from_batches([part])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(part)
                rows = sink.getvalue().to_pybytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([T.buffer(part.column("text"))[0].size]), pa.array([rows], pa.binary())], ["bytes", "rows"]
                )

    blocks = docs.mapInArrow(pack, "bytes long, rows binary").withColumn("block", F.monotonically_increasing_id())
    name = f"blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (blocks.write.bucketBy(buckets, "block").sortBy("block").option("path", scratch_path(spark, name)).option("compression", "none")
     .saveAsTable(name))
    return spark.table(name)


def unpack(rows: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: doc_id, doc_id as numbers to compare (null last), bytes and offsets of the texts."""
    table = pa.ipc.open_stream(rows).read_all()
    ids = table.column("doc_id").combine_chunks()
    data, offsets = T.buffer(table.column("text"))
    return ids, ids.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64), data, offsets


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of equal width over all 64-bit keys; in the order of the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def cuts(keys: np.ndarray, buckets: int):
    """(bucket, begin, end) of each bucket that sorted keys fall into."""
    at = bucket_of(keys, buckets)
    begin = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else []
    for a, b in zip(begin, np.append(begin[1:], len(at)) if len(at) else []):
        yield int(at[a]), int(a), int(b)
