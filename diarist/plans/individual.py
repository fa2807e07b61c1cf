"""Models of single accounts: four algorithms on each account's own entries.

Spark makes the cohort, the splits and folds, deals out the fits, and does the evaluation and the choice
of parameters. A fit is a grouped Pandas task of one account, algorithm, fold and parameter set. It learns
from at most ``fit_rows`` training rows, the first in hash order, whatever the size of the account, and
scores all test rows: those are dealt into chunks of about ``fit_rows``, each with the same fit.
"""

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diarist.functions.learners import LEARNERS, auc
from diarist.operators.compare import complete_accounts
from diarist.operators.cohort import restrict_to_accounts
from diarist.operators.evaluate import collect_metrics, metrics_long, select_best
from diarist.operators.features import INDIVIDUAL_DROPS, NOMINAL
from diarist.operators.keyed_net import KeyedNets, fit_keyed_nets
from diarist.operators.resample import draw_ranks
from diarist.plans import pooled
from diarist.plans.grid import param_grid
from diarist.plans.pooled import Design, Options
from diarist.schema import KEY, ORDINAL
from diarist.scratch import materialize

# Account-level and time columns stay out, since most of them do not vary within an account.
DESIGN = Design(
    nominal=tuple(c for c in NOMINAL if c not in INDIVIDUAL_DROPS), numeric=("craving_severity",)
)
_SCORES = "account_id string, model string, param_id int, fold int, row_id bigint, label int, score double, reason string"
_FINAL = (
    "account_id string, model string, param_id int, row_id bigint, label int, score double, "
    "variable string, importance double, reason string"
)


def _ready(train, test, rng):
    """Training and test arrays: constant columns dropped, the first column scaled, the smaller
    class redrawn up to the larger one. Also the columns kept."""
    x, y = np.stack(train["x"].to_numpy()), train["label"].to_numpy()
    z = np.stack(test["x"].to_numpy()) if len(test) else np.empty((0, x.shape[1]))
    if y.min() == y.max():
        raise ValueError("training rows hold one class")
    kept = np.flatnonzero(x.min(axis=0) < x.max(axis=0))
    if not len(kept):
        raise ValueError("no predictor varies")
    mean, sd = x[:, 0].mean(), x[:, 0].std(ddof=1) or 1.0
    for a in (x, z):
        a[:, 0] = (a[:, 0] - mean) / sd
    classes = [np.flatnonzero(y == c) for c in (0, 1)]
    most = max(map(len, classes))
    rows = np.concatenate([c if len(c) == most else rng.choice(c, most) for c in classes])
    return x[rows][:, kept], y[rows], z[:, kept], kept


def _shaped(pdf, schema):
    """Columns in schema order, with row numbers as nullable integers and text as objects."""
    types = dict(c.split() for c in schema.split(", "))
    pdf = pdf.reindex(columns=list(types))
    return pdf.astype({"row_id": "Int64", "label": "Int64"} | {
        c: object for c, t in types.items() if t == "string"
    })


def _seed(pdf, *more):
    text = ":".join(map(str, (pdf[KEY].iloc[0], pdf["model"].iloc[0], *more)))
    return np.random.default_rng(zlib.crc32(text.encode()))


def _tuning_task(grids):
    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ORDINAL)
        model, param_id, fold = (pdf[c].iloc[0] for c in ("model", "param_id", "held"))
        head = {KEY: pdf[KEY].iloc[0], "model": model, "param_id": param_id, "fold": fold}
        rng = _seed(pdf, fold, param_id)
        test = pdf[pdf["fold"] == fold]
        try:
            x, y, z, _ = _ready(pdf[pdf["fold"] != fold], test, rng)
            scores = LEARNERS[model](x, y, grids[model][param_id], rng)[0](z)
            out = pd.DataFrame({**head, "row_id": test[ORDINAL], "label": test["label"], "score": scores})
        except Exception as e:  # one account's failure is a result, not the end of the job
            out = pd.DataFrame([{**head, "reason": f"{type(e).__name__}: {e}"}])
        return _shaped(out, _SCORES)

    return task


def _final_task(grids, names):
    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ORDINAL)
        model, param_id = pdf["model"].iloc[0], int(pdf["param_id"].iloc[0])
        head = {KEY: pdf[KEY].iloc[0], "model": model, "param_id": param_id}
        rng = _seed(pdf)
        test = pdf[pdf["split"] == "testing"]
        try:
            x, y, z, kept = _ready(pdf[pdf["split"] == "training"], test, rng)
            predict, built_in = LEARNERS[model](x, y, grids[model][param_id], rng)
            out = pd.DataFrame({**head, "row_id": test[ORDINAL], "label": test["label"], "score": predict(z)})
            if pdf["chunk"].iloc[0] == 0:
                if built_in is None:  # AUC lost on the training rows when one column is shuffled
                    base, built_in = auc(y, predict(x)), np.zeros(len(kept))
                    for j in range(len(kept)):
                        mixed = x.copy()
                        mixed[:, j] = rng.permutation(mixed[:, j])
                        built_in[j] = base - auc(y, predict(mixed))
                weights = {**head, "variable": [names[k] for k in kept], "importance": built_in}
                out = pd.concat([out, pd.DataFrame(weights)])
        except Exception as e:
            out = pd.DataFrame([{**head, "reason": f"{type(e).__name__}: {e}"}])
        return _shaped(out, _FINAL)

    return task


@dataclass
class IndividualResult:
    """Long tables of all accounts and algorithms."""

    predictions: DataFrame  # account_id, model, param_id, row_id, label, score on test rows
    importance: DataFrame  # account_id, model, variable, importance
    failures: DataFrame  # account_id, model, reason
    tuning: DataFrame  # account_id, model, param_id, metric, mean, n, std_err

    def metrics(self, complete: bool = True) -> DataFrame:
        """Test metrics; ``complete`` keeps the accounts for which every algorithm succeeded."""
        rows = metrics_long(self.predictions, [KEY, "model"])
        if complete:
            rows = restrict_to_accounts(rows, complete_accounts(self.predictions))
        return rows

    def variables(self) -> DataFrame:
        """Importances of the accounts for which every algorithm succeeded."""
        return restrict_to_accounts(self.importance, complete_accounts(self.predictions))


def _dealt(rows: DataFrame, fit_rows: int, test) -> DataFrame:
    """Test rows with the ``chunk`` they are scored in, and training rows once for each chunk of the account.

    ``rows`` have ``draw_rank`` among the training rows of their account, null for others.
    """
    tested = rows.filter(test)
    sizes = tested.groupBy(KEY, "held").agg(F.ceil(F.count("*") / fit_rows).cast("int").alias("chunks"))
    wide = rows.join(sizes, [KEY, "held"])
    own = F.array(F.pmod(F.xxhash64(ORDINAL), F.col("chunks")).cast("int"))
    all_ = F.sequence(F.lit(0), F.col("chunks") - 1)
    used = wide.filter(test | (F.col("draw_rank") <= fit_rows))
    return used.withColumn("chunk", F.explode(F.when(test, own).otherwise(all_))).drop("chunks")


def individual_models(
    sample: DataFrame, design: Design = DESIGN, options: Options | None = None, fit_rows: int = 100_000
) -> IndividualResult:
    """Split, tune, fit and score each account on its own entries.

    One stratified split per account serves all algorithms, so they are compared on the same test
    rows. ``fit_rows`` bounds the labelled rows that one fit uses; larger accounts are fitted on a
    random part of their training rows, by the same algorithms, and scored whole.
    """
    options = options or Options()
    names = design.names
    rows = pooled.prepare(sample, design, folds=options.folds, keys=[KEY, "craving_did_smoke"])
    grids = {
        m: param_grid(m, len(names), options.sizes.get(m), pooled.SEED, options.trees) for m in options.models
    }
    training = draw_ranks(rows.filter("split = 'training'"), [KEY], f"{pooled.SEED}:fit").drop("draw_n")
    testing = rows.filter("split = 'testing'").withColumn("draw_rank", F.lit(None).cast("bigint"))
    columns = [ORDINAL, KEY, "label", "split", "fold", "draw_rank", F.array(*names).alias("x")]

    # Tasks here are heavy in time and light in bytes, so their number is set by hand.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(p["param_id"]).alias("param_id")) for m in options.models for p in grids[m]
    ])).alias("s")
    folds = training.select(*columns, F.explode(F.sequence(F.lit(0), F.lit(options.folds - 1))).alias("held"))
    packed = _dealt(folds, fit_rows, F.col("fold") == F.col("held")).select("*", sets).select(
        ORDINAL, KEY, "label", "fold", "x", "held", "chunk", "s.*"
    )
    fits = [KEY, "model", "held", "param_id", "chunk"]
    scores = packed.repartition(tasks, *fits).groupBy(*fits).applyInPandas(_tuning_task(grids), _SCORES)
    scores = materialize(scores, "account-tuning")
    by_fold = metrics_long(scores.filter("reason IS NULL"), [KEY, "model", "param_id", "fold"])
    tuning = materialize(collect_metrics(by_fold, [KEY, "model", "param_id"]), "account-collected")
    chosen = materialize(select_best(tuning, [KEY, "model"]).select(KEY, "model", "param_id"), "account-chosen")
    both = training.unionByName(testing).select(*columns, F.lit(0).alias("held"))
    final = _dealt(both, fit_rows, F.col("split") == "testing").join(chosen, KEY).select(
        ORDINAL, KEY, "label", "split", "x", "chunk", "model", "param_id"
    )
    last = [KEY, "model", "chunk"]
    final = materialize(
        final.repartition(tasks, *last).groupBy(*last).applyInPandas(_final_task(grids, names), _FINAL), "account-final"
    )
    failed = scores.filter("reason IS NOT NULL").groupBy(KEY, "model").agg(F.min("reason").alias("reason"))
    untuned = failed.join(chosen, [KEY, "model"], "left_anti")
    unfitted = final.filter("reason IS NOT NULL").groupBy(KEY, "model").agg(F.min("reason").alias("reason"))
    predictions = final.filter("row_id IS NOT NULL").select(KEY, "model", "param_id", "row_id", "label", "score")
    importance = final.filter("variable IS NOT NULL").select(KEY, "model", "variable", "importance")
    return IndividualResult(predictions, importance, unfitted.unionByName(untuned), tuning)


@dataclass
class IndividualNets:
    """Elastic nets of all accounts, each with the parameter set that is best over its own folds."""

    predictions: DataFrame  # account_id, param_id, row_id, label, score on test rows
    coefficients: DataFrame  # account_id, param_id, variable, estimate of the chosen model
    failures: DataFrame  # account_id, hold, param_id, change, reason of models that failed or still moved
    tuning: DataFrame  # account_id, param_id, metric, mean, n, std_err
    nets: KeyedNets


def individual_nets(
    sample: DataFrame, design: Design = DESIGN, folds: int = 10, sets: int | None = None, **fit
) -> IndividualNets:
    """Elastic nets of single accounts on all their entries, fitted together (``operators/keyed_net``).

    Split and folds are those of ``individual_models``. Classes weigh the same in place of redrawn rows, and every
    predictor is scaled over the account's training rows. ``fit`` goes to ``fit_keyed_nets``.
    """
    names = design.names
    rows = pooled.prepare(sample, design, folds=folds, keys=[KEY, "craving_did_smoke"])
    params = param_grid("elnet", len(names), sets, pooled.SEED)
    nets = fit_keyed_nets(rows, names, KEY, ORDINAL, params, folds, **fit)
    scores = materialize(nets.scores(), "net-scores")
    by_fold = metrics_long(scores.where("fold >= 0"), [KEY, "param_id", "fold"])
    tuning = materialize(collect_metrics(by_fold, [KEY, "param_id"]), "net-tuning")
    chosen = materialize(select_best(tuning, [KEY]).select(KEY, "param_id"), "net-chosen")
    tested = scores.where("fold = -1").join(chosen, [KEY, "param_id"])
    return IndividualNets(
        tested.select(KEY, "param_id", "row_id", "label", "score"), nets.coefficients().join(chosen, [KEY, "param_id"]),
        nets.models().where("reason IS NOT NULL"), tuning, nets,
    )
