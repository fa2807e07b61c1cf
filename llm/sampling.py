"""Bounded samples for learning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diarist.scratch import materialize


def least_hashed(rows: DataFrame, key: str | list[str], most: int, *then: str) -> DataFrame:
    """The ``most`` rows whose key has the least hash; ties go by the key and ``then``.

    Rows are counted first, and those beyond twice the share that is wanted are left out where they are
    read, so that few rows are sorted and none of the tasks returns a whole sample of its own. If the
    keys hash so unevenly that too few are left, all rows are sorted.
    """
    keys = [key] if isinstance(key, str) else key
    total, least = rows.count(), F.xxhash64(*keys)
    order = [least, *keys, *then]
    if total > 4 * most:
        bound = -(2**63) + 2 * most * 2**64 // total
        near = rows.where(least < F.lit(bound))
        if near.count() >= most:
            return near.orderBy(*order).limit(most)
    return rows.orderBy(*order).limit(most)


def distinct_texts(docs: DataFrame, few: DataFrame, most: int, name: str) -> DataFrame:
    """The texts of the documents that ``few`` names by ``_id``, with its other columns: ``most`` at most.

    Equal rows count once. A doc_id may have any number of texts; beyond ``most``, those of least hash are
    taken. Only hashes are compared for that, so a text moves once, and only if it is taken. ``few`` and
    what is taken are broadcast: at most ``most`` rows of a few numbers each.
    """
    marks = few.columns
    rows = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("_id"))
    rows = rows.select(*marks, "text", F.xxhash64("text").alias("_hash"))
    seen = materialize(rows.select(*marks, "_hash").distinct(), name)
    taken = least_hashed(seen, seen.columns, most)
    own = rows.join(F.broadcast(taken), seen.columns, "left_semi")
    return own.groupBy(*seen.columns).agg(F.min("text").alias("text")).drop("_hash")
