"""Hot groups: cutting a group into parts changes no result."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import inputs
from diarist.operators import describe, evaluate, resample
from diarist.operators.hot import hot_keys, number_digits, running_total, split_hot
from diarist.operators.sequence import sequence_features
from diarist.plans.clean import clean_diary
from diarist.schema import KEY, ORDINAL, OUTCOME, TIME


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one group, with negative, zero, tiny and large values."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else f"k{i % 40}"
        x = float(rng.choice([-1, 1]) * 10 ** rng.uniform(-9, 9)) if i % 50 else 0.0
        rows.append((key, x, int(rng.integers(1, 9)), i))
    return spark.createDataFrame(rows, "k string, x double, v int, id bigint")


@pytest.mark.parametrize("limit", [10_000, 20, 0])
def test_rows_without_key_are_cut(spark, skewed, limit):
    """A third of the rows have no key: cut into parts like any hot group, with the same results."""
    rows = skewed.withColumn("k", F.when(F.col("k") != "hot", F.col("k")))
    counts = rows.groupBy("k", "x").agg(F.sum("v").alias("v"))
    out = running_total(counts, ["k"], number_digits(F.col("x")), ["x"], {"v": F.col("v")}, limit).collect()
    plain = [r for r in rows.collect() if r["k"] is None]
    got = {r["x"]: (r["v_before"], r["v_total"]) for r in out if r["k"] is None}
    assert got == {x: (sum(r["v"] for r in plain if r["x"] < x), sum(r["v"] for r in plain)) for x in {r["x"] for r in plain}}
    hot = hot_keys(rows, ["k"], limit)
    ordinary, large = split_hot(rows, ["k"], hot)
    assert large.filter("k is null").count() == (300 if limit < 300 else 0)
    assert ordinary.count() + large.count() == 900


@pytest.mark.parametrize("limit", [300, 0])
def test_sequence_of_entries_without_account(spark, limit):
    rows = spark.range(900).select(
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("a"), F.col("id") % 40)).alias(KEY), F.col("id").alias(ORDINAL),
        F.timestamp_add("MINUTE", F.col("id") * 7, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias(TIME),
        F.when(F.col("id") % 5 == 0, "true").otherwise("false").alias(OUTCOME),
    )
    key = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    cut = sequence_features(rows, limit=limit)
    assert key(cut) == key(sequence_features(rows, limit=10_000))
    assert [r["event_nr"] for r in cut.filter(F.col(KEY).isNull()).orderBy(ORDINAL).collect()] == list(range(1, 301))


@pytest.mark.parametrize("limit", [10_000, 20, 0])
def test_running_total(skewed, limit):
    counts = skewed.groupBy("k", "x").agg(F.sum("v").alias("v"))
    out = running_total(counts, ["k"], number_digits(F.col("x")), ["x"], {"v": F.col("v")}, limit)
    got = {(r["k"], r["x"]): (r["v_before"], r["v_total"]) for r in out.collect()}
    rows = skewed.collect()
    for (k, x), (before, total) in got.items():
        mine = [r for r in rows if r["k"] == k]
        assert before == sum(r["v"] for r in mine if r["x"] < x)
        assert total == sum(r["v"] for r in mine)
    assert len(got) == len({(r["k"], r["x"]) for r in rows})


def test_running_total_without_keys(skewed):
    counts = skewed.groupBy("x").agg(F.sum("v").alias("v"))
    out = running_total(counts, [], number_digits(F.col("x")), ["x"], {"v": F.col("v")}).collect()
    seen = 0
    for r in sorted(out, key=lambda r: r["x"]):
        assert r["v_before"] == seen
        seen += r["v"]
    assert all(r["v_total"] == seen for r in out)


def test_digits_follow_the_value(spark):
    rng = np.random.default_rng(2)
    xs = np.concatenate([rng.normal(0, 1, 300), 10 ** rng.uniform(-300, 300, 300), [0.0, 1.0, 2.0, 4.0, 8.0]])
    xs = np.concatenate([xs, np.nextafter(xs, np.inf)])
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    rows = df.select("x", F.array(*number_digits(F.col("x"))).alias("d")).collect()
    digits = [r["d"] for r in sorted(rows, key=lambda r: r["x"])]
    assert digits == sorted(digits)


@pytest.mark.parametrize("limit", [5, 40])
def test_clean_diary_with_hot_accounts(spark, sf, limit):
    raw = inputs.raw(spark, sf)
    plain = clean_diary(raw, inputs.RULES)
    cut = clean_diary(raw, replace(inputs.RULES, hot_rows=limit))
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))


@pytest.mark.parametrize("limit", [3, 10_000])
def test_quantiles(skewed, limit):
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = describe.quantiles(skewed, "x", probs, ["k"], limit).collect()
    rows = skewed.collect()
    for r in got:
        xs = [s["x"] for s in rows if s["k"] == r["k"]]
        np.testing.assert_allclose([r[n] for n in probs], np.quantile(xs, list(probs.values())), rtol=1e-9)


def test_draw_ranks_with_hot_groups(skewed):
    ranks = lambda limit: sorted(
        tuple(r) for r in resample.draw_ranks(skewed, ["k"], 1, "id", limit)
        .select("id", "draw_rank", "draw_n").collect()
    )
    assert ranks(10_000) == ranks(10) == ranks(0)


def test_auc_with_hot_groups(spark, sf):
    scored = inputs.predictions(spark, sf)
    plain = evaluate.auc_ci(scored, [KEY, "model"])
    cut = evaluate.auc_ci(scored, [KEY, "model"], limit=1)
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))
    assert scored.select(F.col("row_id").alias(ORDINAL)).count() > 0


def test_a_burst_inside_one_hour(spark):
    """A hot hour is cut by second; features don't change, and no part holds the hour."""
    from diarist.operators.sequence import sequence_features, with_slots
    from diarist.schema import OUTCOME, TIME

    rows = [(i, "u", f"2024-01-01 10:{i // 60 % 60:02d}:{i % 60:02d}.{i // 3600}", "true" if i % 3 else "false") for i in range(4000)]
    rows += [(9000 + i, "u", f"2024-01-02 {i:02d}:00:00", "false") for i in range(20)] + [(9999, "v", "2024-01-01 00:00:00", "true")]
    df = spark.createDataFrame(rows, f"{ORDINAL} long, {KEY} string, t string, {OUTCOME} string").withColumn(
        TIME, F.col("t").cast("timestamp_ntz")).drop("t")
    columns = [ORDINAL, "event_nr", "prior_event_lapse", "mins_since_prev_rep", "next_event_lapse", "n_entries", "n_lapses"]
    whole, cut = (sorted(map(tuple, sequence_features(df, limit=n).select(*columns).collect())) for n in (10_000, 50))
    assert whole == cut
    parts = with_slots(df, KEY, TIME, 50).groupBy(KEY, "_slot").count()
    assert parts.agg(F.max("count")).first()[0] <= 2
