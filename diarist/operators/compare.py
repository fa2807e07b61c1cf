"""Comparison of models: summaries, the best one per account, and what it relies on."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from diarist.functions.labels import (
    METRIC_LABELS, MODEL_LABELS, clean_feature_label, feature_group, level_order, lookup,
)
from diarist.operators.describe import quantiles, ratio
from diarist.operators.filters import first_per_group
from diarist.schema import KEY, METRICS, MODELS


def complete_accounts(metrics: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """Accounts for which every model gave a result."""
    seen = metrics.groupBy(KEY).agg(*[F.max(F.col("model") == m).alias(m) for m in models])
    whole = F.lit(True)
    for m in models:
        whole = whole & F.coalesce(F.col(m), F.lit(False))
    return seen.filter(whole).select(KEY)


def metrics_wide(metrics: DataFrame, keys: Sequence[str] = (KEY, "model")) -> DataFrame:
    """One column per metric. Conditional maxima need one shuffle where a pivot has two."""
    return metrics.groupBy(*keys).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("estimate"))).alias(m) for m in METRICS]
    )


def metrics_unpivot(wide: DataFrame, keys: Sequence[str] = (KEY, "model")) -> DataFrame:
    return wide.unpivot(list(keys), METRICS, "metric", "value")


def _ranking(order: Sequence[str]) -> list:
    best = [F.col(m).desc_nulls_last() for m in ("roc_auc", "accuracy", "spec", "sens")]
    return best + [level_order(F.col("model"), order).asc_nulls_last()]


def rank_models(wide: DataFrame, order: Sequence[str] = ("xgb", "svm", "elnet", "rf")) -> DataFrame:
    """Rank of each model within its account: AUC, accuracy, spec, sens, then model order."""
    w = Window.partitionBy(KEY).orderBy(*_ranking(order))
    return wide.withColumn("model_rank", F.row_number().over(w))


def best_model_per_account(wide: DataFrame, order: Sequence[str] = MODELS) -> DataFrame:
    return first_per_group(wide, [KEY], _ranking(order))


def combine_algorithms(metrics: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """One row per account and metric with a column per model; null where a model is missing."""
    return metrics.groupBy(KEY, "metric").agg(
        *[F.max(F.when(F.col("model") == m, F.col("estimate"))).alias(m) for m in models]
    )


def metric_summary(metrics: DataFrame) -> DataFrame:
    """Mean, sd, median, min, max of each metric, per model and (model null) over all rows."""
    whole = F.lit("")  # stands for all models, since joins pass over null keys
    models = F.explode(F.array(F.col("model"), whole)).alias("model")
    long = metrics.select(models, "metric", "estimate")
    keys = ["model", "metric"]
    plain = long.groupBy(*keys).agg(F.avg("estimate").alias("mean"), F.stddev_samp("estimate").alias("sd"))
    ranked = quantiles(long, "estimate", {"min": 0, "median": 0.5, "max": 1}, keys)
    both = plain.join(ranked, keys, "left").withColumn("model", F.nullif("model", whole))
    return both.groupBy("model").agg(*[
        F.max(F.when(F.col("metric") == m, F.col(s))).alias(f"{s}_{m}")
        for m in METRICS for s in ("mean", "sd", "median", "min", "max")
    ])


def metric_median(long: DataFrame, value: str = "value") -> DataFrame:
    middle = quantiles(long, value, {"median": 0.5}, ["metric"])
    return middle.select("metric", "median")


def group_mean_column(long: DataFrame, value: str = "value", key: str = "metric") -> DataFrame:
    """The mean of each metric beside its rows."""
    means = long.groupBy(key).agg(F.avg(value).alias("mean"))
    return long.join(means, key, "left")


# The lowest acceptable value of each metric.
ACCEPTABLE = {"accuracy": 0.7, "sens": 0.7, "spec": 0.5, "roc_auc": 0.5}


def metric_thresholds(long: DataFrame, value: str = "value") -> DataFrame:
    """Acceptable value, observed median, and share of accounts at or above, per metric."""
    bar = F.lit(None)
    for metric, least in ACCEPTABLE.items():
        bar = F.when(F.col("metric") == metric, F.lit(least)).otherwise(bar)
    shares = long.withColumn("threshold", bar).groupBy("metric", "threshold").agg(
        ratio(F.count_if(F.col(value) >= F.col("threshold")), F.count(value)).alias("share_acceptable")
    )
    named = lookup(F.col("metric"), METRIC_LABELS).alias("label")
    return shares.join(metric_median(long, value), "metric", "left").select(
        "metric", named, "threshold", "median", "share_acceptable"
    )


def compare_to_group(best: DataFrame, group: DataFrame) -> DataFrame:
    """Own AUC beside the group model's, and whether the own model does at least as well."""
    own = best.select(KEY, "model", F.col("roc_auc").alias("model_auc"))
    theirs = group.select(KEY, F.col("auc").alias("group_auc"))
    return own.join(theirs, KEY, "left").withColumn(
        "individual_preferred", F.col("model_auc") >= F.col("group_auc")
    )


def preference_share(compared: DataFrame) -> DataFrame:
    """Percentage of accounts that prefer their own model, and that do not."""
    flag = F.col("individual_preferred")
    return compared.agg(
        F.count("*").alias("accounts"),
        ratio(F.count_if(flag) * 100, F.count("*")).alias("percent_preferred"),
        ratio(F.count_if(~flag) * 100, F.count("*")).alias("percent_not_preferred"),
    )


def top_features(importance: DataFrame, n: int = 10, keys: Sequence[str] = (KEY, "model")) -> DataFrame:
    """The ``n`` most important variables of each model; ties by name.

    Spark keeps at most ``n`` rows per group in each map task before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(F.col("importance").desc_nulls_last(), "variable")
    return importance.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def best_model_importance(best: DataFrame, importance: DataFrame) -> DataFrame:
    """The importance rows of each account's best model."""
    return best.select(KEY, "model").join(
        importance.select(KEY, "model", "variable", "importance"), [KEY, "model"], "left"
    )


def importance_prevalence(
    top: DataFrame, accounts: DataFrame, keys: Sequence[str] = ("variable", "model")
) -> DataFrame:
    """How many accounts list a variable, and their share of all ``accounts``, to 2 digits."""
    total = accounts.agg(F.count_distinct(KEY)).scalar()
    return top.groupBy(*keys).agg(F.count("*").alias("n")).withColumn(
        "prop_n", ratio(F.col("n"), total, 2)
    )


def labelled_prevalence(prevalence: DataFrame) -> DataFrame:
    """Readable label, feature group and display rank: by group, then falling share."""
    label = clean_feature_label(F.col("variable"))
    named = prevalence.withColumn("label", label).withColumn("feature_group", feature_group(F.col("label")))
    # One row per variable and model: the window sees an aggregate, not entries.
    w = Window.partitionBy("feature_group").orderBy(
        F.col("prop_n").desc_nulls_last(), "variable", *(["model"] if "model" in named.columns else [])
    )
    return named.withColumn("display_rank", F.row_number().over(w))


def combined_roc(curves: DataFrame) -> DataFrame:
    """Curves of several models for one plot, with display names and their order."""
    names = list(MODEL_LABELS)
    return curves.select(
        lookup(F.col("model"), MODEL_LABELS).alias("model"),
        level_order(F.col("model"), names).alias("model_order"),
        (1 - F.col("specificity")).alias("false_positive_rate"),
        "sensitivity",
    )
