"""Queries that train models, each with the defaults of the analysis and over whole tables.

The elastic net is tuned over ten folds and all parameter sets. The forest has the study's 500 trees and fixed parameters. Shallow
forests and boosted stumps on few features have SQL twins. Tuning of forests, 1,000 boosted trees, the held-out
analyses and the models of single accounts take hours on one machine: they are in ``diarist`` and their reduced runs are tests.
"""

from pyspark.sql import functions as F

from catalog import inputs
from catalog.rounding import rounded
from diarist.operators import compare, evaluate, trees
from diarist.operators.resample import downsample
from diarist.plans import holdout, pooled
from diarist.plans.holdout import FOREST
from diarist.plans.pooled import Design, Options
from diarist.schema import KEY, ORDINAL
from diarist.scratch import materialize, scratch_path

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _elastic_net(spark, sf):
    """Tuned and fitted once per session."""
    return inputs.kept(
        spark, sf, "elnet", lambda: pooled.pooled_models(inputs.sample(spark, sf), options=Options(models=("elnet",)))
    )


@query
def fit_elastic_net(spark, sf):
    """Test metrics of the tuned elastic net."""
    return rounded(_elastic_net(spark, sf).metrics())


@query
def elastic_net_tuning(spark, sf):
    """Mean metrics of every parameter set, and whether it was chosen."""
    result = _elastic_net(spark, sf)
    chosen = result.params.filter("name = 'param_id'").select("model", F.col("value").cast("int").alias("best"))
    marked = result.tuning.join(chosen, "model").withColumn("chosen", F.col("param_id") == F.col("best"))
    return rounded(marked.drop("best"))


@query
def elastic_net_scores(spark, sf):
    """Test rows with the score of the tuned model."""
    return rounded(_elastic_net(spark, sf).predictions)


@query
def elastic_net_auc(spark, sf):
    """AUC and interval on the test rows."""
    return rounded(_elastic_net(spark, sf).auc())


@query
def elastic_net_importance(spark, sf):
    """The ten largest coefficients."""
    result = _elastic_net(spark, sf)
    rows = pooled.model_importance(result.models["elnet"], "elnet", result.design)
    return rounded(compare.top_features(rows, keys=["model"]))


@query
def elastic_net_permutation(spark, sf):
    """The ten variables whose permutation costs most AUC on the training rows."""
    result = _elastic_net(spark, sf)
    rows = pooled.permutation_importance(result.models["elnet"], "elnet", result.train, result.design)
    return rounded(compare.top_features(rows, keys=["model"]))


def _prepared(spark, sf):
    return inputs.kept(spark, sf, "prepared", lambda: pooled.prepare(inputs.sample(spark, sf), Design()))


def _forest(spark, sf):
    """The forest of the study's tuned parameters on the training rows, cut to equal classes; and those rows."""
    def build():
        train = materialize(downsample(_prepared(spark, sf).where("split = 'training'")), "forest-rows")
        return trees.fit_forest(train, Design().names, ORDINAL, **FOREST), train

    return inputs.kept(spark, sf, "forest", build)


def _tested(spark, sf, model):
    test = _prepared(spark, sf).where("split = 'testing'")
    return model.score(test, [ORDINAL, KEY, "label"]).withColumnRenamed(ORDINAL, "row_id").withColumn("model", F.lit("rf"))


def _forest_scores(spark, sf):
    """Test rows scored once for all that is read off them."""
    return inputs.saved(spark, sf, "forest-scores", lambda: _tested(spark, sf, _forest(spark, sf)[0]))


@query
def fit_forest(spark, sf):
    """Test metrics of the forest of 500 trees."""
    return rounded(evaluate.metrics_long(_forest_scores(spark, sf), ["model"]))


@query
def forest_auc(spark, sf):
    """AUC and interval of the forest on the test rows."""
    return rounded(evaluate.auc_ci(_forest_scores(spark, sf), ["model"]))


@query
def forest_oob_importance(spark, sf):
    """The ten variables whose permutation costs the trees most accuracy on the rows they did not draw."""
    model, train = _forest(spark, sf)
    rows = trees.out_of_bag_importance(model, train, ORDINAL).withColumn("model", F.lit("rf"))
    return rounded(compare.top_features(rows, keys=["model"]))


@query
def saved_model_scores(spark, sf):
    """Test scores by the forest as it was stored and read again, without what fitted it."""
    path = scratch_path(spark, "saved-forest")
    _forest(spark, sf)[0].save(path)
    return rounded(_tested(spark, sf, trees.TreeModel.load(spark, path)))


# A handful of predictors, for fits small enough to be said in SQL.
FEW = [
    "craving_severity", "prior_event_lapse_yes", "craving_env_alone_true", "craving_occupation_coffee_or_tea_true",
    "craving_feeling_stressed_true",
]


def _few(spark, sf):
    """All entries of the sample with the few predictors."""
    rows = pooled.encode(inputs.sample(spark, sf), Design())
    return inputs.saved(spark, sf, "few", lambda: rows.select(ORDINAL, KEY, "label", *FEW))


def _shallow(spark, sf):
    def build():
        return trees.fit_forest(_few(spark, sf), FEW, ORDINAL, trees=5, mtry=2, min_n=13, max_depth=2)

    return inputs.kept(spark, sf, "shallow", build)


@query
def forest_shallow(spark, sf):
    """Nodes of five trees of two levels over all entries."""
    return rounded(_shallow(spark, sf).nodes.drop("left"))


@query
def forest_shallow_scores(spark, sf):
    """Scores of all entries by the five trees."""
    return rounded(_shallow(spark, sf).score(_few(spark, sf), [ORDINAL, "label"]))


@query
def forest_shallow_oob_importance(spark, sf):
    """Accuracy lost on the entries that the trees did not draw, for each predictor."""
    return rounded(trees.out_of_bag_importance(_shallow(spark, sf), _few(spark, sf), ORDINAL))


def _stumps(spark, sf):
    def build():
        return trees.fit_boosted(_few(spark, sf), FEW, ORDINAL, trees=3, tree_depth=1, min_n=2, loss_reduction=0.01, sample_size=0.8)

    return inputs.kept(spark, sf, "stumps", build)


@query
def boosted_stumps(spark, sf):
    """Nodes of three boosted trees of one level over all entries."""
    return rounded(_stumps(spark, sf).nodes.drop("left"))


@query
def boosted_stump_scores(spark, sf):
    """Scores of all entries by the three trees."""
    return rounded(_stumps(spark, sf).score(_few(spark, sf), [ORDINAL, "label"]))


def _held_out(spark, sf, moved=None):
    """AUC and interval of every account under the shallow forest of all other accounts."""
    sample = inputs.sample(spark, sf)
    accounts = sample.select(KEY).distinct().count()
    scores = holdout.holdout_forests(sample, accounts, moved, trees=5, mtry=2, min_n=13, features=FEW, max_depth=2)
    # Leaves add up in another order elsewhere; scores that differ by that only are ties.
    return rounded(holdout.holdout_auc(rounded(scores, 9)))


@query
def group_to_individual(spark, sf):
    """Every account held out alone: AUC and interval by five trees of two levels."""
    return _held_out(spark, sf)


@query
def hybrid_to_individual(spark, sf):
    """The same with a fifth of the account's own entries among the training rows."""
    return _held_out(spark, sf, 0.2)
