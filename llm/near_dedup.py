"""One document of each group of SimHash near duplicates.

Groups are those of ``simhash_bk``: components of fingerprints of four-word shingles that differ in four bits or fewer.
The document of smallest doc_id stays; of one doc_id, the text of least digest.

Nulls and ties: null, empty and blank texts share a fingerprint, so one of them all stays. Rows without doc_id come after all
others; a group of such rows only keeps one. Of repeated rows one stays; different texts under one doc_id stay or go each
for itself. Very long texts are fingerprinted whole. Further columns are kept as they are, whatever their names. Empty
tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diarist.scratch import materialize
from llm import simhash_bk
from llm.naming import free_names


def keep_one(docs: DataFrame, radius: int = 4, width: int = 4, tree_size: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that stay."""
    same = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    own = F.struct(F.isnull("doc_id").alias("unnamed"), F.col("doc_id").alias("id"), same.alias("same"))
    found = simhash_bk.near_duplicates(docs.select(own.alias("doc_id"), "text"), radius, width, tree_size=tree_size)
    key, text, stay_id, stay_text = free_names(docs.columns, "own_key", "own_text", "stay_key", "stay_text")
    stay = found.where("doc_id = component_id").select(
        F.col("doc_id.id").alias(stay_id), F.col("doc_id.same").alias(stay_text)
    ).distinct()
    stay = materialize(stay, "staying")
    rows = docs.withColumns({key: F.col("doc_id"), text: same})
    joined = rows.join(stay, F.col(key).eqNullSafe(F.col(stay_id)) & (F.col(text) == F.col(stay_text)))
    return joined.dropDuplicates([key, text]).select(*docs.columns)
