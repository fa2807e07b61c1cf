"""AUC, intervals and curves against pairwise brute force, and comparison rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from diarist.operators import compare, evaluate

SCHEMA = "g string, label int, score double"


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    rows = [("a", int(rng.random() < 0.4), float(rng.integers(0, 12)) / 12) for _ in range(120)]
    rows += [("one", 1, 0.3), ("one", 1, 0.4), ("tied", 1, 0.5), ("tied", 0, 0.5), ("two", 1, 0.9), ("two", 0, 0.1)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(rows):
    pos = np.array([r["score"] for r in rows if r["label"] == 1])
    neg = np.array([r["score"] for r in rows if r["label"] == 0])
    wins = (pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)
    var = wins.mean(1).var(ddof=1) / len(pos) + wins.mean(0).var(ddof=1) / len(neg)
    return wins.mean(), np.sqrt(var)


def test_auc_and_interval(scored):
    got = {r["g"]: r for r in evaluate.auc_ci(scored, ["g"]).collect()}
    auc, se = brute([r for r in scored.collect() if r["g"] == "a"])
    assert got["a"]["auc"] == pytest.approx(auc, abs=1e-6)
    assert got["a"]["ci_lower"] == pytest.approx(max(auc - 1.959964 * se, 0), abs=1e-6)
    assert got["a"]["ci_upper"] == pytest.approx(min(auc + 1.959964 * se, 1), abs=1e-6)
    assert (got["one"]["auc"], got["tied"]["auc"], got["two"]["auc"]) == (None, 0.5, 1.0)


def test_auc_of_opposite_scores(scored):
    both = scored.filter("g = 'a'")
    up = evaluate.roc_auc(both).first()["auc"]
    down = evaluate.roc_auc(both.withColumn("score", -F.col("score"))).first()["auc"]
    assert up + down == pytest.approx(1)
    auto = evaluate.roc_auc(both.withColumn("score", -F.col("score")), direction="auto").first()["auc"]
    assert auto == pytest.approx(max(up, down), abs=1e-6) or auto == pytest.approx(down, abs=1e-6)


def test_curve_is_monotone_and_has_the_same_area(scored):
    rows = evaluate.roc_curve(scored.filter("g = 'a'")).orderBy("threshold").collect()
    assert (rows[0]["threshold"], rows[-1]["threshold"]) == (float("-inf"), float("inf"))
    sens = [r["sensitivity"] for r in rows]
    fpr = [1 - r["specificity"] for r in rows]
    assert sens == sorted(sens, reverse=True) and fpr == sorted(fpr, reverse=True)
    area = np.trapezoid(sens[::-1], fpr[::-1])
    assert area == pytest.approx(evaluate.roc_auc(scored.filter("g = 'a'")).first()["auc"], abs=1e-5)


def test_nothing_is_rounded_before_it_is_compared(spark):
    best = spark.createDataFrame([("u", "rf", 0.5 - 1e-8)], "account_id string, model string, roc_auc double")
    group = spark.createDataFrame([("u", 0.5)], "account_id string, auc double")
    assert not compare.compare_to_group(best, group).first()["individual_preferred"]
    folds = spark.createDataFrame(
        [("m", i, f, "roc_auc", x) for i, x in ((0, 0.7), (1, 0.7 + 1e-8)) for f in range(2)],
        "model string, param_id int, fold int, metric string, estimate double",
    )
    assert evaluate.select_best(evaluate.collect_metrics(folds)).first()["param_id"] == 1
    n = 5001  # an AUC whose seventh digit counts
    rows = [(1, 0.5)] + [(0, i / n) for i in range(n)]
    auc = evaluate.roc_auc(spark.createDataFrame(rows, "label int, score double")).first()["auc"]
    assert auc == pytest.approx(2501 / n, abs=1e-12)


def test_class_metrics(scored):
    row = evaluate.class_metrics(scored.filter("g = 'two'")).first()
    assert tuple(row) == (1.0, 1.0, 1.0)
    assert evaluate.class_metrics(scored.filter("g = 'one'")).first()["spec"] is None


def test_best_model_ties(spark):
    schema = "account_id string, model string, sens double, spec double, accuracy double, roc_auc double"
    df = spark.createDataFrame([
        ("a", "xgb", 0.5, 0.5, 0.5, 0.9), ("a", "svm", 0.5, 0.5, 0.6, 0.9), ("a", "rf", 1.0, 1.0, 1.0, None),
        ("b", "svm", 0.5, 0.5, 0.5, 0.5), ("b", "elnet", 0.5, 0.5, 0.5, 0.5),
    ], schema)
    best = {r["account_id"]: r["model"] for r in compare.best_model_per_account(df).collect()}
    assert best == {"a": "svm", "b": "elnet"}


def test_select_best_breaks_ties_by_parameter(spark):
    df = spark.createDataFrame(
        [("rf", p, f, "roc_auc", 0.5 + 0.1 * (p > 0)) for p in range(3) for f in range(4)],
        "model string, param_id int, fold int, metric string, estimate double",
    )
    assert evaluate.select_best(evaluate.collect_metrics(df)).first()["param_id"] == 1


def test_unmatched_accounts_prefer_nothing(spark):
    best = spark.createDataFrame([("a", "rf", 0.7), ("b", "rf", 0.6)], "account_id string, model string, roc_auc double")
    group = spark.createDataFrame([("a", 0.7)], "account_id string, auc double")
    rows = {r["account_id"]: r["individual_preferred"] for r in compare.compare_to_group(best, group).collect()}
    assert rows == {"a": True, "b": None}
    assert compare.preference_share(compare.compare_to_group(best, group)).first()["percent_preferred"] == 50
