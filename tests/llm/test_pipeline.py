"""The pipeline's stages against brute force on a small fixture."""

import collections
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean, junk, copied and contaminated documents, with labels and a benchmark."""
    rng = random.Random(11)
    syllables = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "i", "o", "un", "er")]

    def prose(n):
        words = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(n)]
        return ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, n, 9)) + "."

    items = [(i, prose(20)) for i in range(6)]
    rows, labels, kind = [], [], {}
    for i in range(160):
        what = ["clean", "clean", "clean", "junk", "copy", "leak", "clean", "clean"][i % 8]
        text = prose(rng.randrange(40, 200))
        if what == "junk":
            text = " ".join(w.upper() + "!!" for w in text.split()) if i % 16 == 3 else " | ".join(w + "###" for w in text.split())
        if what == "copy":
            source = next(r for r in reversed(rows) if kind[r[0]] == "clean")
            words = source[1].split()
            text = "  ".join(words).upper()  # the same words
        if what == "leak":
            words = text.split()
            text = " ".join(words[:15] + rng.choice(items)[1].split()[2:17] + words[15:])
        rows.append((i, text, "xx", f"s{i % 3}", len(text)))
        kind[i] = what
        if i % 4 != 1:
            labels.append((i, int(what != "junk"), 0))
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), kind


def test_stages(spark, folder):
    path, kind = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "decontaminate", "mix", "shard"]

    def ids(df):
        return {r.doc_id for r in df.select("doc_id").collect()}

    good = stages["quality"](spark, docs, path)
    assert ids(good) == {i for i, k in kind.items() if k != "junk"} and good.columns == docs.columns
    one = stages["near_dedup"](spark, docs, path)
    assert ids(one) == {i for i, k in kind.items() if k != "copy"} and one.columns == docs.columns
    clean = stages["decontaminate"](spark, docs, path)
    assert ids(clean) == {i for i, k in kind.items() if k != "leak"} and clean.columns == docs.columns


def test_run(spark, folder):
    path, kind = folder
    got = corpus_pipeline.run(spark, path).collect()
    assert got and {kind[r.doc_id] for r in got} == {"clean"}
    place = collections.defaultdict(list)
    for r in got:
        place[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in place.values())
