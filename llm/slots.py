"""Sharding by fixed virtual slots: rows hash into slots, and a versioned map says which shard holds a slot.

Moving data is an edit of the map: a slot moves whole, and its rows are never hashed anew. The map
has as many rows as there are slots, whatever the size of the data.

Nulls and ties: a row without key is hashed by its text, and without either goes where the empty text
goes. Repeated rows share a slot. Empty tables give an empty result. Columns that the result adds
replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096


def text_bytes(text: str = "text"):
    """UTF-8 bytes of a text, none for null."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")


def virtual_slot(key: str = "doc_id", text: str = "text", slots: int = SLOTS):
    """The slot of a row, for good: it depends on the row's key and the number of slots."""
    own = F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    return F.pmod(own, F.lit(slots)).cast("int")


def slot_sizes(rows: DataFrame, slot: str = "virtual_slot", size: str = "size") -> DataFrame:
    """Rows and bytes of each slot that has any."""
    return rows.groupBy(F.col(slot).alias("virtual_slot")).agg(
        F.sum(size).alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows")
    )


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: slots dealt out in turn."""
    return spark.range(slots).select(
        F.lit(0).alias("version"), F.col("id").cast("int").alias("virtual_slot"),
        F.pmod("id", F.lit(shards)).cast("int").alias("shard"),
    )


def rebalance(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of a map, for ``shards`` shards of near equal bytes.

    A shard keeps its largest slots up to the mean of all shards and gives up the rest; those go, the
    largest first, to whichever shard has least. So few slots move, and a new shard fills up. All
    tables here have a row for each slot at most.
    """
    spark = slot_map.sparkSession
    known = slot_map.join(sizes, "virtual_slot", "left").select(
        "version", "virtual_slot", "shard", F.coalesce("slot_bytes", F.lit(0)).alias("slot_bytes")
    )
    mean = F.ceil(F.sum("slot_bytes").over(Window.partitionBy("version")) / F.lit(shards))
    in_shard = Window.partitionBy("shard").orderBy(F.desc("slot_bytes"), "virtual_slot")
    held = known.withColumn("mean", mean).withColumn("upto", F.sum("slot_bytes").over(in_shard)).withColumn(
        "stays", (F.col("upto") <= F.col("mean")) & (F.col("shard") < shards)
    )
    each = spark.range(shards).select(F.col("id").cast("int").alias("shard")).join(held, "shard", "full")
    by_shard = each.groupBy("shard").agg(
        F.sum(F.when(F.col("stays"), F.col("slot_bytes")).otherwise(0)).alias("bytes"),
        F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("slot_bytes")).alias("less"), "virtual_slot"))).alias("given"),
    )
    whole = by_shard.groupBy().agg(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("shard") < shards, F.struct("shard", "bytes")))),
            lambda x: F.coalesce(x["bytes"], F.lit(0)).cast("long"),
        ).alias("loads"),
        F.array_sort(F.flatten(F.collect_list("given"))).alias("given"),
    )
    placed = F.expr("""
        aggregate(
          given,
          named_struct('loads', loads, 'placed', cast(array() as array<struct<virtual_slot:int,shard:int>>)),
          (s, x) -> named_struct(
            'loads', transform(s.loads, (v, i) ->
                if(i = array_position(s.loads, array_min(s.loads)) - 1, v - x.less, v)),
            'placed', concat(s.placed, array(named_struct(
                'virtual_slot', x.virtual_slot,
                'shard', cast(array_position(s.loads, array_min(s.loads)) - 1 as int))))),
          s -> s.placed)
    """)
    moved = whole.select(F.inline(placed)).select("virtual_slot", F.col("shard").alias("to"))
    return known.join(moved, "virtual_slot", "left").select(
        (F.col("version") + 1).alias("version"), "virtual_slot", F.coalesce("to", "shard").alias("shard")
    )


def save_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored map; older versions stay readable."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    """One stored version."""
    schema = "virtual_slot int, shard int, version int"
    return spark.read.schema(schema).parquet(path).where(F.col("version") == version).select(
        "version", "virtual_slot", "shard"
    )


def place(rows: DataFrame, slot_map: DataFrame, sizes: DataFrame, order=("doc_id",)) -> DataFrame:
    """Rows with ``virtual_slot`` get their ``shard`` and ``slot``: their place in it, counted from 0 without gaps.

    Places are numbered inside a virtual slot and moved on by the rows of the shard's earlier slots, so
    no task holds a whole shard.
    """
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_map.join(sizes, "virtual_slot").select(
        "virtual_slot", "shard", F.coalesce(F.sum("slot_rows").over(earlier), F.lit(0)).alias("_offset")
    )
    own = Window.partitionBy("virtual_slot").orderBy(*order)
    numbered = rows.drop("shard", "slot", "_offset").withColumn("slot", F.row_number().over(own).cast("long"))
    return numbered.join(offsets, "virtual_slot").withColumn("slot", F.col("slot") - 1 + F.col("_offset")).drop("_offset")


def shard(docs: DataFrame, shards: int, map_path: str, slots: int = SLOTS) -> DataFrame:
    """All columns of ``docs`` with ``size``, ``text_crc32``, ``virtual_slot``, ``shard``, ``slot``, ``map_version``.

    Stores version 0 of the map (dealt in turn) and version 1 (sizes near equal) at ``map_path``.
    """
    spark = docs.sparkSession
    rows = docs.withColumns({
        "size": text_bytes() + 1,
        "text_crc32": F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")),
        "virtual_slot": virtual_slot(slots=slots),
    })
    sizes_path = f"{map_path}-sizes"
    slot_sizes(rows.select("virtual_slot", "size")).write.parquet(sizes_path)
    sizes = spark.read.parquet(sizes_path)
    save_map(first_map(spark, shards, slots), map_path)
    save_map(rebalance(load_map(spark, map_path, 0), sizes, shards), map_path)
    latest = load_map(spark, map_path, 1)
    return place(rows, latest.drop("version"), sizes, ("doc_id", "text_crc32")).withColumn("map_version", F.lit(1))
