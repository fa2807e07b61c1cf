"""Exactness and completeness of the resamples."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalog import inputs
from diarist.operators import features, resample
from diarist.plans.grid import RANGES, param_grid
from diarist.schema import KEY, ORDINAL, OUTCOME


@pytest.fixture(scope="module")
def sample(spark, sf):
    return inputs.sample(spark, sf).select(ORDINAL, KEY, OUTCOME).cache()


@pytest.fixture(scope="module")
def seven_three(spark):
    return spark.createDataFrame(
        [(i, "a", "true" if i < 3 else "false") for i in range(10)], f"{ORDINAL} bigint, {KEY} string, {OUTCOME} string"
    )


def test_split_is_exact_and_complete(sample):
    sizes = Counter(r["split"] for r in resample.train_test_split(sample).collect())
    assert sizes == {"training": 392, "testing": 98}


def test_split_is_reproducible(sample):
    one = resample.train_test_split(sample).filter("split = 'training'").select(ORDINAL)
    two = resample.train_test_split(sample.repartition(5)).filter("split = 'training'").select(ORDINAL)
    assert one.exceptAll(two).count() == 0


def test_folds_differ_by_one_row(sample):
    sizes = Counter(r["fold"] for r in resample.kfold(sample, 10).collect())
    assert len(sizes) == 10 and max(sizes.values()) - min(sizes.values()) <= 1


def test_stratified_parts(sample):
    rows = resample.train_test_split(sample, keys=[KEY, OUTCOME]).collect()
    groups = Counter((r[KEY], r[OUTCOME]) for r in rows)
    training = Counter((r[KEY], r[OUTCOME]) for r in rows if r["split"] == "training")
    assert all(training[g] == int(0.8 * n) for g, n in groups.items())


def test_downsample_and_upsample(seven_three):
    down = Counter(r[OUTCOME] for r in resample.downsample(seven_three).collect())
    up = resample.upsample(seven_three).collect()
    assert down == {"true": 3, "false": 3}
    assert Counter(r[OUTCOME] for r in up) == {"true": 7, "false": 7}
    assert {r[ORDINAL] for r in up if r[OUTCOME] == "true"} <= {0, 1, 2}
    assert {r[ORDINAL] for r in up if r[OUTCOME] == "false"} == set(range(3, 10))


def test_upsample_each_account(sample):
    rows = resample.upsample(sample, [KEY]).collect()
    classes = Counter((r[KEY], r[OUTCOME]) for r in rows)
    before = Counter((r[KEY], r[OUTCOME]) for r in sample.collect())
    for (account, outcome), n in classes.items():
        assert n == max(before[account, "true"], before[account, "false"])
        assert before[account, outcome] > 0


@pytest.mark.parametrize("n,moved", [(12, 2), (13, 3)])
def test_hybrid_moves_a_fifth(spark, n, moved):
    df = spark.createDataFrame([(i, "a") for i in range(n)], f"{ORDINAL} bigint, {KEY} string")
    out = resample.hybrid_split(df)
    taken = out.filter("role = 'training'")
    assert taken.count() == moved
    assert resample.remove_sampled_rows(df, taken).count() == n - moved


def test_holdout_groups_keep_accounts_whole(sample):
    n = sample.select(KEY).distinct().count()
    held = resample.holdout_groups(sample, n)
    assert held.count() == sample.count()
    per = held.groupBy("holdout").agg(F.count_distinct(KEY).alias("a")).collect()
    assert len(per) == n and all(r["a"] == 1 for r in per)


def test_grid_uses_each_stratum_once():
    for model, ranges in RANGES.items():
        grid = param_grid(model, 47, 10)
        for name, (kind, low, high) in ranges.items():
            if kind == "real":
                strata = {int((row[name] - low) / (high - low) * 10) for row in grid}
                assert strata == set(range(10))
    assert len(param_grid("xgb", 47)) == 30 and param_grid("xgb", 47)[0]["trees"] == 1000


def test_contrasts_are_orthonormal():
    m = features.contrast_matrix(7)
    assert abs(m.T @ m - __import__("numpy").eye(6)).max() < 1e-12


def test_statistics_come_from_training_rows_only(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 2.0), (3, 100.0)], "id int, x double")
    out = features.normalize(df, ["x"], df.filter("id < 3")).orderBy("id").collect()
    assert [round(r["x"], 6) for r in out] == [-0.707107, 0.707107, 70.003571]


def test_drop_zero_variance(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0), (2, 1.0, 1.0)], "id int, a double, b double")
    assert features.drop_zero_variance(df, ["a", "b"]).columns == ["id", "b"]
