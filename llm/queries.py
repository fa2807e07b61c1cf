"""The registered queries of this package, each over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from diarist.scratch import materialize, scratch_path
from llm import (
    cross_parse, lattice, ns_bounds, periodic, poisson_mix, quality_mil, rule_list, simhash_bk, slots, suffix_dedup, token_cache,
    vocabularies, warc, winnow,
)

QUERIES = {}
ORACLE = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op4_virtual_slots(spark, sf):
    """Eight shards of near equal bytes."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    placed = slots.shard(docs, 8, scratch_path(spark, "slot-map"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


@query
def op6_poisson_mix(spark, sf):
    """Sources at the square root of their bytes, one epoch in all."""
    docs = table(spark, sf, "documents")
    return poisson_mix.mix_documents(docs, scratch_path(spark, "rates"))


@query
def op2_winnowing(spark, sf):
    """Documents against all benchmark items."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return winnow.report(winnow.matches(docs, table(spark, sf, "benchmark"))).drop("text")


@query
def op8_simhash_bk(spark, sf):
    """Components of documents whose fingerprints differ in four bits or fewer."""
    found = simhash_bk.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_rule_list(spark, sf):
    """Base counts, base rules and the learned decision list."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    counted = materialize(rule_list.statistics(docs).drop("text"), "rule-counts")
    judged = rule_list.judge(counted, table(spark, sf, "labels"))
    return judged.select("doc_id", *rule_list.COUNTS[:5], "base_failed", "kept")


@query
def op1_attention_mil(spark, sf):
    """Quality of every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality_mil.learn(docs, table(spark, sf, "labels"))
    scored = quality_mil.score(docs, model).withColumn("held_out", quality_mil.held_out())
    return scored.select("doc_id", "held_out", "score", "predicted")


@query
def op5_cross_parse(spark, sf):
    """Language of every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    taught = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    learned = cross_parse.samples(taught)
    found = cross_parse.identify(docs.select("doc_id", "text"), learned)
    return found.withColumn("held_out", quality_mil.held_out(parts=4, rest=2)).select(
        "doc_id", "held_out", "lang_pred", "score"
    )


@query
def op7_warc_segments(spark, sf):
    """All pages into archives, and back."""
    path = scratch_path(spark, "archives")
    warc.write_archives(table(spark, sf, "pages"), path)
    return warc.read_pages(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op3_subword_lattice(spark, sf):
    """Log probability of every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return lattice.score(docs.withColumn("held_out", quality_mil.held_out(parts=10)))


@query
def op9_suffix_dedup(spark, sf):
    """Strings of 50 bytes that an earlier document has are removed."""
    return suffix_dedup.digests(suffix_dedup.remove_repeats(table(spark, sf, "documents")))


@query
def op11_periodic_runs(spark, sf):
    """Stretches of words that repeat with a period, in documents of which a tenth have one planted."""
    docs = table(spark, sf, "documents").select("doc_id", periodic.planted().alias("text"))
    return periodic.digests(periodic.periodic_runs(docs))


@query
def op12_digest_cache(spark, sf):
    """Tokens of every document, through a cache that starts empty."""
    counter = token_cache.Counter(vocabularies.read("word_bpe_49k.json"))
    counts = token_cache.token_counts(table(spark, sf, "documents"), scratch_path(spark, "token-cache"), counter)
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


@query
def op13_ns_bounds(spark, sf):
    """Eight clusters of the embeddings."""
    found, centroids = ns_bounds.cluster_vectors(table(spark, sf, "embeddings"))
    return ns_bounds.digests(found, centroids).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
