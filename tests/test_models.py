"""Training: learners, pooled, held-out and individual models."""

import hashlib

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from catalog import inputs
from diarist.functions import learners
from diarist.operators.resample import downsample
from diarist.plans import holdout, individual, pooled
from diarist.plans.clean import cohort
from diarist.plans.pooled import Design, FourierFeatures, Options
from diarist.schema import KEY
from diarist.scratch import materialize, scratch_path

FOREST = holdout.FOREST | {"trees": 10}
PARAMS = {
    "rf": {"mtry": 3, "min_n": 5, "trees": 30},
    "elnet": {"penalty": 0.01, "mixture": 0.5},
    "svm": {"cost": 1.0, "rbf_sigma": 0.1},
    "xgb": {"tree_depth": 3, "min_n": 5, "loss_reduction": 0.0, "sample_size": 0.8, "mtry": 3,
            "learn_rate": 0.1, "trees": 30},
}


@pytest.mark.parametrize("model", sorted(PARAMS))
def test_learners_find_a_signal(model):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    y = (x[:, 0] + 0.3 * rng.normal(size=200) > 0).astype(int)
    predict, weights = learners.LEARNERS[model](x[:150], y[:150], PARAMS[model], rng)
    assert learners.auc(y[150:], predict(x[150:])) > 0.85
    if weights is not None:
        assert weights.argmax() == 0


def test_huge_penalty_leaves_no_coefficient():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(60, 3)), np.arange(60) % 2
    assert not learners.elastic_net(x, y, {"penalty": 1e3, "mixture": 1.0}, rng)[1].any()


def test_auc_of_one_class():
    assert np.isnan(learners.auc(np.ones(3), np.arange(3)))


def test_fourier_features_approximate_the_kernel(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 5))
    df = spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(x)], ["i", "features"])
    lifted = FourierFeatures(sigma=0.1, size=8000).transform(df).orderBy("i").collect()
    z = np.array([r["lifted"].toArray() for r in lifted])
    exact = np.exp(-0.1 * ((x[:, None] - x) ** 2).sum(2))
    assert np.abs(z @ z.T - exact).max() < 0.06


@pytest.fixture(scope="module")
def result(spark, sf):
    options = Options(folds=2, sizes={"elnet": 2, "rf": 1}, trees=5, max_depth=4, max_iter=10, models=("elnet", "rf"))
    return pooled.pooled_models(inputs.sample(spark, sf), options=options)


def test_pooled_models(result):
    scores = result.predictions
    assert scores.groupBy("model").count().filter("count = 98").count() == 2
    assert scores.filter("score < 0 OR score > 1").count() == 0
    assert result.tuning.filter("model = 'elnet'").select("param_id").distinct().count() == 2
    assert result.auc().filter("auc IS NULL").count() == 0


def test_pooled_models_save_and_load(result, spark, tmp_path):
    result.save(str(tmp_path))
    again = pooled.score(PipelineModel.load(str(tmp_path / "elnet")), result.test)
    first = result.predictions.filter("model = 'elnet'").agg(F.sum("score")).first()[0]
    assert again.agg(F.sum("score")).first()[0] == pytest.approx(first)
    assert spark.read.parquet(str(tmp_path / "params")).count() == result.params.count()


def test_importances(result):
    built_in = pooled.model_importance(result.models["elnet"], "elnet", result.design)
    shuffled = pooled.permutation_importance(result.models["rf"], "rf", result.train, result.design)
    assert built_in.count() == shuffled.count() == len(result.design.names)
    assert shuffled.filter("abs(importance) > 1").count() == 0
    again = pooled.permutation_importance(
        result.models["rf"], "rf", result.train.repartition(5), result.design, seed=pooled.SEED)
    by_name = lambda df: {r["variable"]: round(r["importance"], 9) for r in df.collect()}
    assert by_name(again) == by_name(shuffled)


def test_folds_are_balanced_inside_training(spark, sf):
    rows = pooled.prepare(inputs.sample(spark, sf), Design(), folds=3)
    for fold in range(3):
        part = downsample(rows.filter("split = 'training'").filter(F.col("fold") != fold))
        sizes = [r["count"] for r in part.groupBy("label").count().collect()]
        assert len(sizes) == 2 and sizes[0] == sizes[1]


def test_saved_rbf_svm_scores(spark, sf):
    rows = pooled.prepare(inputs.sample(spark, sf), Design(), folds=2)
    train = pooled.part(rows.filter("split = 'training'"), Design(), downsample)
    fitted = pooled.fit("svm", {"cost": 1.0, "rbf_sigma": 0.01}, train, max_iter=5)
    scores = pooled.score(fitted, rows.filter("split = 'testing'"))
    assert scores.filter("score BETWEEN 0 AND 1").count() == 98


@pytest.mark.parametrize("moved,rows", [(None, 415), (0.2, None)])
def test_holdouts(spark, sf, moved, rows):
    mixed = cohort(inputs.clean(spark, sf), outcomes="mixed")
    scores = holdout.holdout_scores(mixed, groups=2, moved=moved, params=FOREST, max_depth=3)
    auc = holdout.holdout_auc(scores)
    assert auc.count() == 10
    if rows:
        assert scores.count() == rows
    else:
        kept = mixed.groupBy(KEY).count().selectExpr("sum(count - bround(0.2D * count))").first()[0]
        assert scores.count() == kept


def test_leave_one_account_out_needs_one_fit_per_account(spark, sf):
    some = cohort(inputs.clean(spark, sf), at_least=45, outcomes="mixed")
    n = some.select(KEY).distinct().count()
    scores = holdout.holdout_scores(some, groups=n, params=FOREST | {"trees": 2}, max_depth=2)
    assert scores.select("holdout").distinct().count() == n
    assert scores.groupBy("holdout").agg(F.count_distinct(KEY).alias("n")).filter("n > 1").count() == 0


def test_individual_models(spark, sf):
    sample = cohort(inputs.clean(spark, sf), more_than=5)
    options = Options(folds=2, sizes=dict.fromkeys(PARAMS, 1), trees=3)
    result = individual.individual_models(sample, options=options)
    accounts = sample.select(KEY).distinct().count()
    metrics = result.metrics()
    assert metrics.count() == accounts * 4 * 4
    assert result.failures.count() == 0
    test_rows = result.predictions.groupBy("row_id").count()
    assert test_rows.filter("count <> 4").count() == 0  # all algorithms score the same rows
    assert result.variables().select("model").distinct().count() == 4


def test_failures_are_kept(spark, sf):
    options = Options(folds=2, sizes={"elnet": 1}, models=("elnet",))
    result = individual.individual_models(inputs.sample(spark, sf), options=options)
    one_class = inputs.sample(spark, sf).filter("n_lapses = 0 OR n_lapses = n_entries")
    assert result.failures.count() >= one_class.select(KEY).distinct().count() > 0


def test_one_method_whatever_the_size(spark, sf):
    """Accounts above and below ``fit_rows`` go the same way: all test rows are scored, failures are alike."""
    sample = inputs.sample(spark, sf).filter("n_entries >= 45 OR n_lapses = 0")
    options = Options(folds=2, sizes={"elnet": 1}, models=("elnet",))
    whole = individual.individual_models(sample, options=options)
    chunks = individual.individual_models(sample, options=options, fit_rows=60)
    rows = lambda r: {(x[KEY], x["row_id"]): round(x["score"], 9) for x in r.predictions.collect()}
    assert rows(whole) == rows(chunks)  # no account has more than 60 training rows, some are dealt in chunks
    few = individual.individual_models(sample, options=options, fit_rows=12)
    assert rows(few).keys() <= rows(whole).keys()
    failed = lambda r: {x[KEY] for x in r.failures.collect()}
    one_class = {r[KEY] for r in sample.filter("n_lapses = 0").select(KEY).distinct().collect()}
    assert one_class and one_class <= failed(whole) == failed(chunks) and one_class <= failed(few)
    assert all(":" in x["reason"] for x in whole.failures.collect())


def test_holdouts_store_one_table(spark, sf, monkeypatch):
    """What is written doesn't grow with the number of groups."""
    some = cohort(inputs.clean(spark, sf), at_least=40, outcomes="mixed")
    names = []
    monkeypatch.setattr(holdout, "materialize", lambda df, name: names.append(name) or materialize(df, name))
    monkeypatch.setattr(pooled, "scratch_path", lambda spark, name: names.append(name) or scratch_path(spark, name))
    for groups in (2, 4):
        holdout.holdout_scores(some, groups=groups, params=FOREST | {"trees": 1}, max_depth=2)
    assert names == ["holdout", "holdout"]


def test_parts_are_deleted(spark, sf, tmp_path):
    rows = pooled.prepare(inputs.sample(spark, sf), Design(), folds=2)
    train = pooled.resampled(rows.filter("split = 'training'"), 2, Design())
    paths = [p.path for p in (*train.without_fold, train.whole)]
    assert all(spark.read.parquet(p).count() for p in paths)
    train.close()
    from pathlib import Path
    assert not any(Path(p).exists() for p in paths)


def test_scaler_learns_before_resampling(spark, sf):
    rows = pooled.prepare(inputs.sample(spark, sf), Design(), folds=2).filter("split = 'training'")
    fitted = pooled.part(rows, Design(), downsample).recipe.stages[1]
    want = rows.agg(F.avg("craving_severity"), F.stddev_samp("craving_severity")).first()
    at = list(Design().numeric).index("craving_severity")
    assert fitted.mean[at] == pytest.approx(want[0]) and fitted.std[at] == pytest.approx(want[1])


def test_grid_fills_every_stratum():
    from diarist.plans.grid import RANGES, SIZES, param_grid

    for model, size in SIZES.items():
        grid = param_grid(model, 47)
        assert len(grid) == size and [p["param_id"] for p in grid] == list(range(size))
        for name, (kind, low, high) in RANGES[model].items():
            if kind == "real":
                assert sorted(int((p[name] - low) / (high - low) * size) for p in grid) == list(range(size))


def test_parts_hold_what_each_downsample_keeps(spark, sf):
    """All parts are ranked in one pass; hot classes, null outcomes and repeated rows included."""
    made = spark.range(400).selectExpr(
        "id % 390 AS entry_ordinal", "CASE WHEN id % 57 = 0 THEN NULL WHEN id % 4 = 0 THEN 'true' ELSE 'false' END AS craving_did_smoke",
        "CAST(id % 390 * 7 % 3 AS int) AS fold")
    own = made.withColumnsRenamed({"entry_ordinal": pooled.ORDINAL, "craving_did_smoke": pooled.OUTCOME})
    rows = lambda df: sorted(map(str, df.select(own.columns).collect()))
    parts = pooled.downsample_parts(own, 3)
    for f in range(4):
        want = downsample(own.filter(F.col("fold") != f) if f < 3 else own)
        assert rows(parts.filter(F.array_contains("parts", f))) == rows(want) != []


def test_training_rows_are_ranked_once_for_all_parts(spark, sf, monkeypatch):
    rows = pooled.prepare(inputs.sample(spark, sf), Design(), folds=2).filter("split = 'training'")
    calls = []
    monkeypatch.setattr("diarist.operators.resample.draw_ranks", lambda *a, **k: calls.append(a))
    train = pooled.resampled(rows, 2, Design())
    assert calls == [] and {*train.whole.rows.columns} == {"label", "features"}
    train.close()


def test_permutation_scores_only_rows_that_change(spark, sf, result, monkeypatch):
    """The AUC of every swapped feature is that of all rows scored anew, and each row is scored once."""
    fitted, seen = result.models["elnet"], spark.sparkContext.accumulator(0)
    ready = PipelineModel(fitted.stages[:3]).transform(result.train)
    rows = [(r[pooled.ORDINAL], r["label"], r["features"].toArray()) for r in ready.collect()]
    rows.sort(key=lambda r: hashlib.md5(f"{pooled.SEED}:permute:{r[0]}".encode()).hexdigest())
    x, y = np.stack([r[2] for r in rows]), np.array([r[1] for r in rows])
    last = fitted.stages[-1]
    odds = lambda z: z @ last.coefficients.toArray() + last.intercept
    score = F.udf(lambda v: (seen.add(1), v)[1], "double").asNondeterministic()
    real = pooled.vector_to_array
    monkeypatch.setattr(pooled, "vector_to_array", lambda c: [None, score(real(c)[1])] if c == "probability" else real(c))
    got = pooled.permutation_importance(fitted, "elnet", result.train, result.design)
    got = {r["variable"]: r["importance"] for r in got.collect()}
    base, donor, moved = learners.auc(y, np.round(odds(x), 12)), np.roll(x, -1, 0), 0
    for j, name in enumerate(result.design.names):
        z = x.copy()
        z[:, j] = donor[:, j]
        moved += (z[:, j] != x[:, j]).sum()
        assert got[name] == pytest.approx(base - learners.auc(y, np.round(odds(z), 12)), abs=1e-9), name
    assert seen.value == len(rows) + moved
