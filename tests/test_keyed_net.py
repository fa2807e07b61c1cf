"""Elastic nets of many keys at once against a solver that fits one model at a time."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from diarist.scratch import exists
from diarist.operators.keyed_net import CONSTANT, NOT_CONVERGED, ONE_CLASS, fit_keyed_nets

NAMES = ["u", "v", "w"]
PARAMS = [{"penalty": 0.02, "mixture": 0.5}, {"penalty": 0.1, "mixture": 1.0}, {"penalty": 0.05, "mixture": 0.0}]
FOLDS = 3
SCHEMA = "who string, nr bigint, label int, fold int, u double, v double, w double, parts string"


def made(keys=20, seed=3):
    rng, out, nr = np.random.default_rng(seed), [], 0
    for k in range(keys):
        n = 400 if k == 0 else int(rng.integers(30, 60))
        x = rng.normal(size=(n, 3)) * [1, 10, 0.1] + [0, 5, 2]
        x[:, 2] += x[:, 0] * 0.05
        y = (x[:, 0] + 0.05 * x[:, 1] + rng.normal(size=n) > 0.2).astype(int)
        for i in range(n):
            out.append((f"k{k}", nr, int(y[i]), None if i % 5 == 4 else i % FOLDS, *map(float, x[i]), "extra"))
            nr += 1
    return out


def plain(x, y, penalty, mixture):
    """Scaled coefficients by plain proximal gradient steps."""
    w = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    mean = w @ x
    sd = np.sqrt(w @ (x - mean) ** 2)
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    b, rate = np.zeros(z.shape[1]), 4 / np.linalg.eigvalsh((z * w[:, None]).T @ z).max()
    for _ in range(1500):
        g = z.T @ (w * (1 / (1 + np.exp(-z @ b)) - y))
        g[1:] += penalty * (1 - mixture) * b[1:]
        new = b - 0.5 * rate * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - 0.5 * rate * penalty * mixture, 0)
        b = new
    return b, mean, sd


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(made(), SCHEMA)


@pytest.fixture(scope="module")
def nets(rows):
    return fit_keyed_nets(rows, NAMES, "who", "nr", PARAMS, FOLDS, tolerance=1e-6, block_rows=50)


def test_scores_are_those_of_models_fitted_alone(nets):
    data = pd.DataFrame(made(), columns=["who", "nr", "label", "fold", *NAMES, "parts"])
    got = nets.scores().toPandas()
    assert len(got) == len(data) * len(PARAMS) and not got.duplicated(["row_id", "param_id"]).any()
    for who, own in data.groupby("who"):
        for hold in range(FOLDS + 1):
            train = own[own["fold"].notna() & (own["fold"] != hold)]
            test = own[own["fold"].isna()] if hold == FOLDS else own[own["fold"] == hold]
            for nr, q in enumerate(PARAMS):
                b, mean, sd = plain(train[NAMES].to_numpy(), train["label"].to_numpy(), **q)
                odds = b[0] + (test[NAMES].to_numpy() - mean) / sd @ b[1:]
                mine = got[(got["param_id"] == nr) & got["row_id"].isin(test["nr"])].sort_values("row_id")["score"]
                assert np.abs(mine.to_numpy() - 1 / (1 + np.exp(-odds))).max() < 1e-4, (who, hold, nr)


def test_blocks_of_any_size_give_the_same(rows):
    few = {"params": PARAMS, "folds": FOLDS, "max_steps": 4}
    cut = fit_keyed_nets(rows, NAMES, "who", "nr", **few, block_rows=50)
    whole = fit_keyed_nets(rows, NAMES, "who", "nr", **few, block_rows=10_000)
    assert cut.blocks.where("who = 'k0'").count() > 5 and whole.blocks.where("parts > 1").isEmpty()
    both = whole.scores().join(cut.scores().withColumnRenamed("score", "other"), ["row_id", "param_id"])
    assert both.count() == rows.count() * len(PARAMS) and both.where(F.abs(F.col("score") - F.col("other")) > 1e-9).isEmpty()
    whole.close()
    assert not rows.sparkSession.catalog.tableExists(whole.table) and not any(exists(rows.sparkSession, p) for p in whole.paths)


def test_every_model_is_listed_and_converged(nets):
    models = nets.models()
    assert models.count() == 20 * (FOLDS + 1) * len(PARAMS) and models.where("NOT converged").isEmpty()
    assert nets.coefficients().count() == 20 * len(PARAMS) * 4


def test_blocks_are_joined_where_they_are(spark, nets):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = nets.scores()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1  # the coefficients, not the blocks


def test_failures_are_rows(spark):
    odd = [("one", i, 1, i % 2, 1.0 * i, 0.0, 0.0, "") for i in range(8)]
    odd += [("still", 10 + i, i % 2, i // 2 % 2, 1.0, 2.0, None, "") for i in range(8)]
    odd += [("fold", 20 + i, int(i < 4), int(i < 4), 1.0 * i, 0.0, 0.0, "") for i in range(8)]
    odd += [("parted", 30 + i, int(i > 3), i % 2, 1.0 * i, 0.0, 0.0, "") for i in range(8)]
    odd += [(None, 40, 1, 0, 1.0, 1.0, 1.0, ""), ("one", 41, None, 0, 1.0, 1.0, 1.0, "")]
    free = [{"penalty": 1e-10, "mixture": 0.0}]
    nets = fit_keyed_nets(spark.createDataFrame(odd, SCHEMA), NAMES, "who", "nr", free, 2, max_steps=5)
    got = {(r["who"], r["hold"]): r["reason"] for r in nets.models().collect()}
    assert {h: got["one", h] for h in range(3)} == dict.fromkeys(range(3), ONE_CLASS)
    assert {h: got["still", h] for h in range(3)} == dict.fromkeys(range(3), CONSTANT)
    assert (got["fold", 0], got["fold", 1]) == (ONE_CLASS, ONE_CLASS) and got["parted", 2] == NOT_CONVERGED
    assert {r["who"] for r in nets.scores().select("who").distinct().collect()} == {"parted"}


def test_no_rows(spark):
    nets = fit_keyed_nets(spark.createDataFrame([], SCHEMA), NAMES, "who", "nr", PARAMS, FOLDS)
    assert nets.models().isEmpty() and nets.scores().isEmpty() and nets.coefficients().isEmpty()
