"""Every operator and stage on odd rows and on no rows."""

import hashlib
import math
import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from diarist.scratch import scratch_path
from llm import (
    cross_parse, lattice, near_dedup, ns_bounds, periodic, poisson_mix, quality_mil, rule_list, simhash_bk, slots, suffix_dedup,
    token_cache, vocabularies, winnow,
)


def _labels(spark, empty):
    rows = [] if empty else [(1, 1), (3, 0), (5, 1), (8, 0), (9, None), (None, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int")


def _items(spark, empty):
    rows = [] if empty else [
        (1, "quick brown fox jumps over the lazy dog near the old stone"), (2, "zebra"), (None, None), (3, "####"), (4, "a"),
    ]
    return spark.createDataFrame(rows, "item_id long, text string")


def _mil(spark, docs, empty):
    return quality_mil.score(docs, quality_mil.learn(docs, _labels(spark, empty)))


def _rules(spark, docs, empty):
    return rule_list.judge(rule_list.statistics(docs), _labels(spark, empty))


CASES = {
    "op1": _mil,
    "op2": lambda s, d, e: winnow.report(winnow.matches(d, _items(s, e))),
    "op3": lambda s, d, e: lattice.score(d.withColumn("held_out", quality_mil.held_out(parts=10))),
    "op4": lambda s, d, e: slots.shard(d, 3, scratch_path(s, "map"), slots=16),
    "op5": lambda s, d, e: cross_parse.identify(d, cross_parse.samples(d)),
    "op6": lambda s, d, e: poisson_mix.mix_documents(d, scratch_path(s, "rates")),
    "op8": lambda s, d, e: simhash_bk.near_duplicates(d),
    "op9": lambda s, d, e: suffix_dedup.digests(suffix_dedup.remove_repeats(d)),
    "op10": _rules,
    "op11": lambda s, d, e: periodic.digests(periodic.periodic_runs(d.withColumn("text", periodic.planted()))),
    "op12": lambda s, d, e: token_cache.token_counts(
        d, scratch_path(s, "cache"), token_cache.Counter(vocabularies.read("word_bpe_49k.json"))
    ),
    "stage8": lambda s, d, e: near_dedup.keep_one(d),
}


@pytest.mark.parametrize("name", CASES)
def test_no_rows(spark, no_docs, name):
    assert CASES[name](spark, no_docs, True).count() == 0


@pytest.mark.parametrize("name", sorted(set(CASES) - {"op6", "stage8"}))
def test_odd_rows_all_come_back(spark, odd_docs, name):
    got = CASES[name](spark, odd_docs, False)
    ids = sorted(str(r[0]) for r in got.select("doc_id").collect())
    assert ids == sorted(str(r[0]) for r in odd_docs.select("doc_id").collect())


def test_odd_rows_defined_results(spark, odd_docs):
    scored = {r.doc_id: r for r in _mil(spark, odd_docs, False).collect() if r.doc_id is not None}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored.values())
    hit = {r.doc_id: r for r in CASES["op2"](spark, odd_docs, False).collect()}
    assert hit[1].contaminated and hit[1].n_hit == 12 and not hit[2].contaminated and hit[9].n_items == 1
    lm = {r.doc_id: r for r in CASES["op3"](spark, odd_docs, False).collect() if r.doc_id is not None}
    assert lm[2].n_tokens == lm[3].n_tokens == lm[4].n_tokens == 1 and lm[2].score == lm[3].score
    langs = {r.doc_id: r for r in CASES["op5"](spark, odd_docs, False).collect() if r.doc_id is not None}
    assert langs[2].lang_pred == langs[3].lang_pred == langs[8].lang_pred == "und" and langs[2].score == 0
    prints = {r.doc_id: r for r in CASES["op8"](spark, odd_docs, False).collect()}
    assert prints[2].bits == prints[3].bits == prints[4].bits == 0
    assert prints[2].component_id == prints[4].component_id == 2 and prints[10].component_id == 1
    assert prints[9].component_id == -5
    cut = {r.doc_id: r for r in CASES["op9"](spark, odd_docs, False).collect()}
    assert cut[10].n_removed == cut[10].n_bytes and cut[1].n_removed == 0 and cut[2].n_bytes == 0
    assert cut[6].n_removed == cut[5].n_bytes and cut[7].n_removed == 0
    runs = {r.doc_id: r for r in CASES["op11"](spark, odd_docs, False).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    for i in (2, 3, 4):
        assert runs[i].n_runs == 0 and runs[i].start is None and runs[i].runs_sha256 == runs[i].collapsed_sha256 == nothing
    assert runs[8].collapsed_sha256 == hashlib.sha256(b"####").hexdigest()
    tokens = {r.doc_id: r for r in CASES["op12"](spark, odd_docs, False).collect()}
    assert tokens[2].n_bytes == tokens[2].n_tokens == tokens[4].n_tokens == 0 and tokens[4].n_bytes == 4 and tokens[7].n_bytes == 600
    assert tokens[9].n_tokens == tokens[-5].n_tokens == 1 and tokens[1].n_tokens == tokens[10].n_tokens


def test_clashing_columns_stay(spark, odd_docs):
    free = [c for c in odd_docs.columns if c.startswith("_") or c in ("parts", "cdf", "rate")]
    mixed = poisson_mix.mix_documents(odd_docs, scratch_path(spark, "rates"))
    assert all(r[c] == "x" for r in mixed.collect() for c in free)
    found = winnow.matches(odd_docs, _items(spark, False), block_words=8)
    assert set(free) <= set(found.columns) and all(r[c] == "x" for r in found.collect() for c in free)


def test_odd_rows_in_the_mix(spark, odd_docs):
    """Counts of every row by inversion, said plainly: repeated rows alike, rows without doc_id by their text."""
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0), (None, 2.0)], "source string, weight double")
    got = poisson_mix.mix_documents(odd_docs, scratch_path(spark, "rates"), weights, epochs=3.0).collect()
    rows = odd_docs.collect()
    size, share = {}, {"a": 3 / 6, "b": 1 / 6, None: 2 / 6}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + len((r.text or "").encode())
    whole = sum(size.values())
    want = {}
    for r in rows:
        rate = 3 * whole * share.get(r.source, 0) / size[r.source]
        name = str(r.doc_id) if r.doc_id is not None else hashlib.md5((r.text or "").encode()).hexdigest()
        n_parts = max(1, math.ceil(rate / poisson_mix.PART))
        for i in range(1, n_parts + 1):
            u = int(hashlib.md5(f"17:{name}:{i}".encode()).hexdigest()[:13], 16) / 2**52
            p = below = math.exp(-rate / n_parts)
            k = 0
            while below <= u:
                k += 1
                p *= rate / n_parts / k
                below += p
            want[name] = want.get(name, 0) + k
    counts = {}
    for r in got:
        name = str(r.doc_id) if r.doc_id is not None else hashlib.md5((r.text or "").encode()).hexdigest()
        counts[name] = counts.get(name, 0) + 1
    assert counts == {k: n for k, n in want.items() if n}


def test_learning_is_bounded_where_one_doc_id_has_many_rows(spark):
    docs = spark.range(10_000).select(
        F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("some text number "), F.col("id").cast("string")).alias("text"),
        F.lit("en").alias("lang"),
    ).repartition(4)
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0)], "doc_id long, quality int")
    assert len(quality_mil.sampled_passages(docs, labels, 2, 64)) == 2
    assert len(rule_list.labelled_sample(rule_list.statistics(docs), labels, 2)[0]) == 2
    same = docs.withColumn("text", F.lit("the same text"))
    assert len(quality_mil.sampled_passages(same, labels, 2, 64)) == 1
    learned = cross_parse.samples(docs, sample_docs=3)
    assert learned["en"].count(b"some") == 3
    assert cross_parse.samples(same)["en"].count(b"same") == 1


def test_language_samples_reach_the_end_of_texts(spark):
    """Texts that open with the same long notice are learned from what follows it."""
    rng = random.Random(5)
    notice = "all rights are reserved and nothing here may be copied " * 60
    rows = [(i, notice + " ".join(f"mot{rng.choice('abcdefgh')}e" for _ in range(2000)), "fr") for i in range(40)]
    learned = cross_parse.samples(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert learned["fr"].count(b"mot") * 7 > 0.6 * len(learned["fr"]) and len(learned["fr"]) == 32_768


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5]), (3, None), (4, [nan, 0.0]), (5, [inf, 0.0]), (6, [None, 0.0]),
            (None, [9.0, 9.0]), (7, [0.5, 0.5]), (8, [-0.0001, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("key", "v", "block", "cluster")})
    found, centroids = ns_bounds.cluster_vectors(vectors, clusters=8, rounds=3, size=2)
    got = sorted((str(r.vec_id), r.distance) for r in found.collect())
    assert got == [("1", 0), ("1", 0), ("7", 0), ("8", 0), ("None", 0)]
    assert centroids.shape == (5, 2) and [-1, 0] in centroids.tolist()
    none, centroids = ns_bounds.cluster_vectors(vectors.where("false"), size=2)
    assert none.count() == 0 and len(centroids) == 0 and ns_bounds.digests(none, centroids).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        ns_bounds.cluster_vectors(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), size=2)


def test_copies_leave_one(spark, odd_docs):
    rows = near_dedup.keep_one(odd_docs)
    kept = sorted((r.doc_id is not None, r.doc_id or 0) for r in rows.collect())
    assert rows.columns == odd_docs.columns
    assert [i for known, i in kept if known] == [-5, 1, 2, 5, 7, 8]
    assert len(kept) == 7  # and the text that only a row without doc_id has; null texts have a doc_id too


def test_stages_on_odd_rows(spark, odd_docs, no_docs, some_labels, tmp_path):
    some_labels.write.parquet(f"{tmp_path}/labels.parquet")
    _items(spark, False).write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, str(tmp_path))
            got.count()
            if name != "shard":
                assert got.columns == docs.columns
