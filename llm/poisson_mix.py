"""Mixing sources to target weights by Poisson replication.

Each source has a rate: how often its documents are repeated on average, so that the mix holds its
share of bytes. A document's number of copies is a Poisson variate of that mean, by inversion of the
distribution at a number hashed from the seed and the document: the same in any run and in any split
of the data. Copies are then dealt to partitions and ordered by a hash, which is a global shuffle.

Nulls and ties: rows without source are a source of their own. A row without doc_id is hashed by its
text. Repeated rows draw the same number. Sources that ``weights`` doesn't name have weight 0. Sources
without a byte have rate 0. Empty tables give an empty mix. Columns ``copy`` and ``mix_key`` replace
columns of these names; all others stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.naming import free_names
from llm.slots import text_bytes

PART = 500.0  # exp(-rate) of a larger rate is too small for a double; such rates are drawn as sums


def source_bytes(docs: DataFrame) -> DataFrame:
    return docs.select("source", text_bytes().alias("bytes")).groupBy("source").agg(F.sum("bytes").alias("bytes"))


def rates(sizes: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """Per source: mean repetitions ``rate``, and the distribution function of one of its ``parts``.

    ``weights`` (source, weight) are shares of bytes in the mix, of any sum; without them a source
    weighs its bytes to the power ``temperature``. The mix has ``epochs`` times the bytes of the input.
    """
    if weights is None:
        known = sizes.withColumn("weight", F.pow(F.col("bytes").cast("double"), F.lit(temperature)))
    else:
        named = weights.select(F.col("source").alias("_named"), F.col("weight").cast("double").alias("weight"))
        known = sizes.join(named, F.col("source").eqNullSafe(F.col("_named")), "left").drop("_named")
        known = known.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    known = known.where("bytes > 0")
    total = known.agg(F.sum("bytes"), F.sum("weight")).first()
    mass, norm = float(total[0] or 0) * epochs, float(total[1] or 0) or 1.0
    rate = known.withColumn("rate", F.lit(mass) * (F.col("weight") / F.lit(norm)) / F.col("bytes"))
    part = rate.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")).withColumn(
        "mean", F.col("rate") / F.col("parts")
    )
    cdf = F.expr("""
        aggregate(
          sequence(0, cast(ceil(mean + 12 * sqrt(mean) + 24) as int)),
          named_struct('p', exp(-mean), 'below', 0D, 'cdf', cast(array() as array<double>)),
          (s, k) -> named_struct('p', s.p * mean / (k + 1), 'below', s.below + s.p,
                                 'cdf', concat(s.cdf, array(s.below + s.p))),
          s -> s.cdf)
    """)
    return part.withColumn("cdf", cdf).select("source", "rate", "parts", "cdf")


def hashed(*parts):
    """A number in [0, 1) from the first 52 bits of an md5."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def mix(docs: DataFrame, source_rates: DataFrame, seed: int = 17) -> DataFrame:
    """Each document by its number of copies (``copy`` 1, 2, ...), shuffled globally by ``mix_key``.

    ``source_rates`` should be a written table: Spark then knows its size, and broadcasts it or not.
    """
    keep = [c for c in docs.columns if c.lower() not in ("copy", "mix_key")]
    of, parts, cdf, own, count = free_names([*keep, "copy", "mix_key"], "_source", "_parts", "_cdf", "_own", "_count")
    by = source_rates.select(F.col("source").alias(of), F.col("parts").alias(parts), F.col("cdf").alias(cdf))
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    rows = docs.select(*keep).withColumn(own, name).join(by, F.col("source").eqNullSafe(F.col(of)))
    # One number for each part, hashed before it is compared with the entries of the distribution.
    numbers = F.transform(F.sequence(F.lit(1), F.col(parts)), lambda i: hashed(F.lit(str(seed)), F.col(own), i.cast("string")))
    draws = F.transform(numbers, lambda u: F.size(F.filter(F.col(cdf), lambda c: c <= u)))
    total = F.aggregate(draws, F.lit(0), lambda s, x: s + x)
    copies = rows.withColumn(count, total).where(F.col(count) > 0)
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(count))))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), F.col(own), F.col("copy").cast("string")).cast("binary"))
    keyed = copies.withColumn("mix_key", key).select(*keep, "copy", "mix_key")
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key")


def mix_documents(docs: DataFrame, rates_path: str, weights: DataFrame | None = None, temperature: float = 0.5,
                  epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """Rates of all sources, written to ``rates_path`` and read again, and the mix by them."""
    spark = docs.sparkSession
    sizes_path = f"{rates_path}-sizes"
    source_bytes(docs).write.parquet(sizes_path)
    rates(spark.read.parquet(sizes_path), weights, temperature, epochs).write.parquet(rates_path)
    return mix(docs, spark.read.parquet(rates_path), seed)
