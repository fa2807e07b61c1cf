"""Periodic runs, token counts and clusters against brute force."""

import functools
import hashlib
import math
import random
import re
import sys
import zlib
from fractions import Fraction
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from diarist.scratch import scratch_path
from llm import ns_bounds, periodic, queries, token_cache, vocabularies
from llm.cover_lce import COVER, VERSUS, CoverLCE
from llm.word_codes import joined, word_codes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_runs(w, least=24, periods=3):
    """(start, period, length), by comparing each word with the one a period on."""
    out = {}
    for p in range(1, len(w) // periods + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, periods * p):
                out.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, p, n) for (s, n), p in out.items())


def repetitive(rng):
    w = []
    for _ in range(rng.randrange(6)):
        if rng.random() < 0.5:
            w += [rng.choice("abc") for _ in range(rng.randrange(20))]
        else:
            w += ([rng.choice("ab") for _ in range(rng.randrange(1, 12))] * 20)[: rng.randrange(1, 120)]
    return w


def test_cover_has_every_difference():
    assert {(a - b) % VERSUS for a in COVER for b in COVER} == set(range(VERSUS))


def test_common_extensions():
    rng = random.Random(1)

    def plain(s, x, y):
        k = 0
        while max(x, y) + k < len(s) and s[x + k] == s[y + k]:
            k += 1
        return k

    for t in range(150):
        n = rng.randrange(2, 300)
        s = [rng.randrange(1, rng.choice([2, 3, 5])) for _ in range(n)]
        if t % 3 == 0:
            s = (s[: rng.randrange(1, 7)] * 300)[:n]
        x = np.array([rng.randrange(n) for _ in range(60)])
        y = (x + np.array([rng.randrange(1, n) for _ in range(60)])) % n
        assert CoverLCE(np.array(s))(x, y).tolist() == [plain(s, a, b) for a, b in zip(x.tolist(), y.tolist())]


@pytest.mark.parametrize("least", [24, 6])
def test_runs_of_batches(least):
    rng = random.Random(least)
    for _ in range(120):
        texts = [repetitive(rng) for _ in range(rng.randrange(1, 8))]
        words = word_codes(pa.array([" ".join(w) for w in texts]))
        got = [[] for _ in texts]
        for t, s, n, p in zip(*(c.tolist() for c in periodic.find_runs(words.codes, words.first, least))):
            got[t].append((s, p, n))
        assert got == [plain_runs(w, least) for w in texts]
        keep = np.array([rng.random() < 0.5 for _ in words.codes], bool)
        want = [" ".join(x for x, k in zip(w, keep[f:]) if k) for w, f in zip(texts, words.first)]
        assert joined(words, keep).to_pylist() == want


def test_periodic_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[1:]) for r in queries.QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    n_runs = 0
    for d, text in docs:
        w = WORD.findall(text or "")
        n, h = len(w), zlib.crc32(str(d).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        if n > 1200:
            continue
        runs = plain_runs(w)
        n_runs += len(runs)
        best = max(runs, key=lambda r: (Fraction(r[2], r[1]), -r[0], -r[1]), default=None)
        drop = {i for s, p, n in runs for i in range(s + p, s + n)}
        strongest = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
        assert got[d] == (
            len(runs), *strongest, sha("".join(f"{s},{n},{p}\n" for s, p, n in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in drop)),
        )
    assert n_runs > 10


def test_one_word_many_times(spark):
    text = "so " * 30_000
    got = periodic.periodic_runs(spark.createDataFrame([("x", text)], "doc_id string, text string")).first()
    assert [tuple(r) for r in got.runs] == [(0, 30_000, 1)] and got.collapsed == "so"


@pytest.fixture(scope="module")
def counter():
    return token_cache.Counter(vocabularies.read("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabularies.path("word_bpe_49k.json"))


def test_tokens_of_whole_texts(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op12_digest_cache"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d, text in docs:
        n = len(tokenizer.encode(text or "", add_special_tokens=False))
        assert (got[d].n_tokens, got[d].n_bytes, got[d].over_limit) == (n, len((text or "").encode()), n > 2048)


ODD = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\u00a0\u0301\u0345\u03a3\u3000'SsTt|<>")), max_size=40)
PARTS = st.lists(st.one_of(ODD, st.sampled_from(["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "it's", "A\u030a"])), max_size=6).map("".join)


@functools.cache
def both_counters():
    from tokenizers import Tokenizer

    return token_cache.Counter(vocabularies.read("word_bpe_49k.json")), Tokenizer.from_file(vocabularies.path("word_bpe_49k.json"))


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=4))
def test_words_add_up(texts):
    counter, whole = both_counters()
    want = [len(e) for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(pa.array(texts, pa.string())).tolist() == want
    one_space = [re.sub(r"[ \t-\r]+", " ", t).strip(" ") for t in texts]
    assert [len(e) for e in whole.encode_batch(one_space, add_special_tokens=False)] == want  # what the digest relies on


def test_only_distinct_misses_are_encoded(spark, counter, tokenizer):
    cache = scratch_path(spark, "cache")
    first = [(1, "A cat  sat."), (2, "A cat\nsat."), (2, "A cat\nsat."), (3, None), (None, "dog"), (None, "dog")]
    counted = token_cache.token_counts(spark.createDataFrame(first, "doc_id long, text string"), cache, counter)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in counted.collect()) == [
        ("1", 11, 4), ("2", 10, 4), ("2", 10, 4), ("3", 0, 0), ("None", 3, 1), ("None", 3, 1)
    ]
    assert spark.read.parquet(cache).count() == 3
    more = [(i, "a cat sat." if i % 3 else f"unseen {i}") for i in range(60)]
    again = token_cache.token_counts(spark.createDataFrame([*first, *more], "doc_id long, text string"), cache, counter, shared=4)
    want = [len(tokenizer.encode(t or "", add_special_tokens=False)) for _, t in (*first, *more)]
    assert sorted(r.n_tokens for r in again.collect()) == sorted(want)
    assert spark.read.parquet(cache).count() == 3 + 1 + 20  # case is the tokenizer's business, not the digest's
    token_cache.token_counts(spark.createDataFrame(more, "doc_id long, text string"), cache, counter).count()
    assert spark.read.parquet(cache).count() == 24
    other = token_cache.Counter(counter.vocabulary, by_words=False)
    assert other.version != counter.version
    whole = token_cache.token_counts(spark.createDataFrame(first, "doc_id long, text string"), cache, other)
    assert sorted(r.n_tokens for r in whole.collect()) == [0, 1, 1, 4, 4, 4] and spark.read.parquet(cache).count() == 28


def plain_clusters(vectors, start, rounds):
    x, c = np.array(vectors, object), [list(v) for v in start]

    def nearest():
        d = np.array([[((v - np.array(q, object)) ** 2).sum() for q in c] for v in x])
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        a, _d = nearest()
        c = [[int(s) // int((a == j).sum()) for s in x[a == j].sum(axis=0)] if (a == j).any() else c[j] for j in range(len(c))]
    return *nearest(), c


def test_clusters_of_embeddings(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    kept = [(r.vec_id, [math.floor(1024 * x) for x in r.embedding]) for r in rows]
    start = [v for _, v in sorted((sha(f"3:{i}"), v) for i, v in kept)[:8]]
    a, d, c = plain_clusters([v for _, v in kept], start, 10)
    got = {r.vec_id: r for r in queries.QUERIES["op13_ns_bounds"](spark, SF).collect()}
    assert len(got) == len(kept)
    for (i, _), cluster, distance in zip(kept, a, d):
        r = got[i]
        assert (r.cluster, r.distance, r.cluster_inertia, r.inertia) == (cluster, distance, d[a == cluster].sum(), d.sum())
        assert r.centroid_sha256 == sha(",".join(map(str, c[cluster])))


def test_bounds_are_exact_and_spare_work():
    rng = np.random.default_rng(4)
    for kind in range(12):
        k, size = 6, 3
        centres = rng.integers(-400, 400, (k, size))
        v = centres[rng.integers(0, k, 500)] + rng.integers(-30, 30, (500, size)) if kind % 2 else rng.integers(-3, 3, (500, size))
        v = v.astype(np.int32)
        history, state, computed = [v[:k].astype(np.int64)], None, 0
        for _ in range(12):
            now = history[-1]
            state, n = ns_bounds.assign(v, state, np.stack(history))
            computed += n
            exact = ((v[:, None, :].astype(np.int64) - now) ** 2).sum(axis=2)
            assert (state.cluster == exact.argmin(axis=1)).all()  # ties are frequent among small integers
            state = ns_bounds.State.unpack(state.pack(), k)
            history.append(np.array([v[state.cluster == j].sum(axis=0) // max((state.cluster == j).sum(), 1) if (state.cluster == j).any() else now[j] for j in range(k)]))
        assert computed < 12 * 500 * k * (0.5 if kind % 2 else 1)


def test_vectors_are_not_shuffled(spark):
    vectors = spark.range(5000).select(F.col("id").alias("vec_id"), F.array(*[F.rand(i) for i in range(4)]).alias("embedding"))
    kept = ns_bounds.kept_vectors(vectors, size=4)
    blocks, name, _ = ns_bounds.write_vectors(kept, 1024, rows=256)
    states = spark.createDataFrame([], ns_bounds.STATES)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ns_bounds._with_state(blocks, states.repartition(3))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {name}")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
