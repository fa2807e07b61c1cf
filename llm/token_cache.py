"""Token counts with a cache of digests.

A text's key is the SHA-256 of its content with each run of blanks as one space; counts are stored under that key and
the digest of the tokenizer's version (its file, the library's version and the way of counting). Contents that the
cache lacks are encoded once each, by one row chosen for each of them, and appended. Contents that many
rows share, above a thousandth of all rows, are at most a thousand: their counts are broadcast, all others joined.

Within a task, distinct words are encoded once each and added up. This holds for tokenizers that drop white space
(``by_words``); others get whole texts.

Nulls and ties: null is the empty text, of no tokens. Repeated rows and equal texts each get the count of their content, so do
rows without doc_id. Texts are encoded whole. Of extra columns none is read. Empty tables give an empty result and append nothing.
Two jobs that append at once may store a content twice, with equal counts; readers take one.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diarist.scratch import materialize
from llm import text as T
from llm.word_codes import word_codes

KEPT_WORDS = 1 << 20  # counts of words that a worker remembers between batches
_LOADED: dict[str, tuple] = {}


class Counter:
    """Counts tokens by a vocabulary given as the text of its file, so that executors need no file."""

    def __init__(self, vocabulary: str, by_words: bool = True):
        import tokenizers

        self.vocabulary, self.by_words = vocabulary, by_words
        told = f"tokenizers {tokenizers.__version__}; no added tokens; {'words' if by_words else 'texts'}\n"
        self.version = hashlib.sha256(told.encode() + vocabulary.encode()).hexdigest()

    def _loaded(self):
        """The tokenizer and the counts of words that this worker knows; they outlive a task."""
        if self.version not in _LOADED:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores
            from tokenizers import Tokenizer

            model = Tokenizer.from_str(self.vocabulary)
            model.no_truncation()
            model.no_padding()
            _LOADED[self.version] = model, {}
        return _LOADED[self.version]

    def count(self, column) -> np.ndarray:
        """Tokens of each text of a batch."""
        model, known = self._loaded()

        def encode(texts):
            return [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]

        if not self.by_words:
            return np.array(encode([t or "" for t in column.to_pylist()]), np.int64)
        words = word_codes(column)
        spelled = words.known.to_pylist()
        new = [w for w in spelled if w not in known]
        if len(known) + len(new) > KEPT_WORDS:
            known.clear()
            new = spelled
        known.update(zip(new, encode([w.decode() for w in new])))
        each = np.array([known[w] for w in spelled], np.int64)
        total = np.zeros(len(words.codes) + 1, np.int64)
        np.cumsum(each[words.codes], out=total[1:])
        return np.diff(total[words.first])


def content_key() -> F.Column:
    """The digest of a text's normalised content. Runs of blanks never change a count where white space is dropped."""
    plain = F.trim(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[ \t-\r]+", " "))
    return F.unhex(F.sha2(plain.cast("binary"), 256))


def whole_key() -> F.Column:
    """The digest of a text as it is."""
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """``content`` and ``n_tokens`` that the cache holds for a tokenizer version."""
    try:
        found = spark.read.schema("content binary, n_tokens long, version string").parquet(cache)
    except AnalysisException:  # nothing was appended yet
        return spark.createDataFrame([], "content binary, n_tokens long")
    return found.where(F.col("version") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache: str, counter: Counter, part_bytes: int = 8 << 20, shared: int = 1000) -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes`` and ``n_tokens``. ``cache`` is a folder that grows by what was missing."""
    spark = docs.sparkSession
    key = content_key() if counter.by_words else whole_key()
    who = F.xxhash64("doc_id")  # never null, so the join below is on plain equality and its partitioning serves the copies
    rows = materialize(docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), key.alias("content"), who.alias("who")
    ), "contents")
    # Copies are counted before the shuffle, so a content with a third of all rows is a row for each map task.
    contents = materialize(
        rows.groupBy("content").agg(F.count(F.lit(1)).alias("rows"), F.min("who").alias("first")), "distinct-contents"
    )
    missing = materialize(
        contents.join(stored(spark, cache, counter.version), "content", "left_anti").select("content", "first"), "missing"
    )

    def encode(batches):
        for batch in batches:
            for part in T.slices(batch, "text", part_bytes):
                n = counter.count(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("content"), pa.array(n)], ["content", "n_tokens"])

    texts = docs.select(who.alias("first"), key.alias("content"), "text")
    asked = missing.withColumnsRenamed({"content": "_c", "first": "_f"})
    asked = texts.join(asked, (F.col("content") == F.col("_c")) & (F.col("first") == F.col("_f")))
    if not missing.isEmpty():
        once = asked.dropDuplicates(["content", "first"])  # repeated rows of the chosen document
        counted = once.select("content", "text").mapInArrow(encode, "content binary, n_tokens long")
        counted.withColumn("version", F.lit(counter.version)).write.mode("append").partitionBy("version").parquet(cache)
    known = materialize(contents.join(stored(spark, cache, counter.version), "content"), "counts")
    most = rows.count() // shared + 1
    often = known.where(F.col("rows") > most).select("content", F.col("n_tokens").alias("often"))  # fewer than ``shared`` rows
    marked = rows.join(F.broadcast(often), "content", "left")
    rest = marked.where("often is null").drop("often").join(known.where(F.col("rows") <= most).select("content", "n_tokens"), "content")
    return marked.where("often is not null").select("doc_id", "n_bytes", F.col("often").alias("n_tokens")).unionByName(
        rest.select("doc_id", "n_bytes", "n_tokens")
    )
