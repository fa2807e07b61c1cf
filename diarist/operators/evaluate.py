"""Model evaluation from scored rows: ``label`` 0/1, ``score``, and any grouping keys."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diarist.operators.describe import ratio
from diarist.operators.filters import first_per_group
from diarist.operators.hot import HOT_ROWS, number_digits, running_total

Z_95 = 1.959964  # fixed value: normal quantile of a 95% interval


def class_metrics(
    df: DataFrame, keys: Sequence[str] = (), threshold: float = 0.5, label="label", score="score"
) -> DataFrame:
    """Sensitivity, specificity and accuracy of ``score >= threshold``."""
    positive, called = F.col(label) == 1, F.col(score) >= threshold
    return df.groupBy(*keys).agg(
        ratio(F.count_if(positive & called), F.count_if(positive)).alias("sens"),
        ratio(F.count_if(~positive & ~called), F.count_if(~positive)).alias("spec"),
        ratio(F.count_if(positive == called), F.count("*")).alias("accuracy"),
    )


def score_counts(df: DataFrame, keys: Sequence[str], label="label", score="score") -> DataFrame:
    """Positives ``p`` and negatives ``q`` per distinct score."""
    return df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q")
    )


def score_ranks(
    df: DataFrame, keys: Sequence[str], label="label", score="score", limit: int = HOT_ROWS
) -> DataFrame:
    """Positives ``p`` and negatives ``q`` per distinct score, with the totals below and overall."""
    return _count_ranks(score_counts(df, keys, label, score), keys, limit)


def _count_ranks(counts: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    return running_total(
        counts, keys, number_digits(F.col("score")), ["score"], {"p": F.col("p"), "q": F.col("q")}, limit
    )


def _class_median(n: str) -> Column:
    """Median score of one class, from the ranks of its rows among the distinct scores."""
    middle = (F.col(f"{n}_total") - 1) / 2

    def at(position: Column) -> Column:
        here = (F.col(f"{n}_before") <= position) & (position < F.col(f"{n}_before") + F.col(n))
        return F.max(F.when(here, F.col("score")))

    return (at(F.floor(middle)) + at(F.ceil(middle))) / 2


def auc_ci(
    df: DataFrame,
    keys: Sequence[str] = (),
    direction: str = "fixed",
    label="label",
    score="score",
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Area under the ROC curve and its DeLong 95% interval; null with one class only.

    ``direction="auto"`` flips a score whose median is lower among positives, so the curve may
    be read either way.
    """
    return auc_of_counts(score_counts(df, keys, label, score), keys, direction, limit)


def auc_of_counts(
    counts: DataFrame, keys: Sequence[str] = (), direction: str = "fixed", limit: int = HOT_ROWS
) -> DataFrame:
    """``auc_ci`` of counted scores. The counts are read several times: write them first if they are dear."""
    ranks = _count_ranks(counts, keys, limit)
    p, q = F.col("p").cast("double"), F.col("q").cast("double")
    below_neg, below_pos = F.col("q_before") + q / 2, F.col("p_before") + p / 2
    sums = ranks.groupBy(*keys).agg(
        F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"),
        F.sum(p * below_neg).alias("_a"), F.sum(p * below_neg * below_neg).alias("_aa"),
        F.sum(q * below_pos).alias("_b"), F.sum(q * below_pos * below_pos).alias("_bb"),
        _class_median("p").alias("_med_pos"), _class_median("q").alias("_med_neg"),
    )
    m, n = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    auc = F.try_divide("_a", m * n)
    if direction == "auto":
        auc = F.when(F.col("_med_pos") < F.col("_med_neg"), 1 - auc).otherwise(auc)
    spread_pos = F.try_divide(F.col("_aa") - F.try_divide(F.col("_a") * F.col("_a"), m), (m - 1) * n * n)
    spread_neg = F.try_divide(F.col("_bb") - F.try_divide(F.col("_b") * F.col("_b"), n), (n - 1) * m * m)
    variance = F.try_divide(spread_pos, m) + F.try_divide(spread_neg, n)
    half = Z_95 * F.sqrt(F.greatest(variance, F.lit(0.0)))
    half = F.when(variance.isNotNull(), half)
    clip = lambda x: F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)))
    return sums.select(
        *keys, "n_pos", "n_neg", auc.alias("auc"),
        clip(auc - half).alias("ci_lower"), clip(auc + half).alias("ci_upper"),
    )


def roc_auc(df: DataFrame, keys: Sequence[str] = (), direction: str = "fixed", **cols) -> DataFrame:
    """Chance that a random positive outscores a random negative, ties counting half."""
    return auc_ci(df, keys, direction, **cols).select(*keys, "auc")


def roc_curve(df: DataFrame, keys: Sequence[str] = (), limit: int = HOT_ROWS) -> DataFrame:
    """Specificity and sensitivity of ``score >= threshold`` at every distinct score, and both ends."""
    keys = list(keys)
    ranks = score_ranks(df, keys, limit=limit)
    point = lambda at, spec, sens: F.struct(
        at.alias("threshold"), spec.alias("specificity"), sens.alias("sensitivity")
    )
    here = point(
        F.col("score"), ratio(F.col("q_before"), F.col("q_total")),
        ratio(F.col("p_total") - F.col("p_before"), F.col("p_total")),
    )
    zero, one = F.lit(0.0), F.lit(1.0)
    low = point(F.lit(float("-inf")), zero, one)
    high = point(F.lit(float("inf")), one, zero)
    top = F.col("p_before") + F.col("p") + F.col("q_before") + F.col("q") == F.col("p_total") + F.col("q_total")
    bottom = F.col("p_before") + F.col("q_before") == 0
    points = F.concat(
        F.array(here), F.when(bottom, F.array(low)).otherwise(F.array().cast(_POINTS)),
        F.when(top, F.array(high)).otherwise(F.array().cast(_POINTS)),
    )
    return ranks.select(*keys, F.explode(points).alias("r")).select(*keys, "r.*")


_POINTS = "array<struct<threshold:double,specificity:double,sensitivity:double>>"


def metrics_long(df: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """(keys, metric, estimate) with sens, spec, accuracy and roc_auc."""
    keys = list(keys)
    wide = class_metrics(df, keys, threshold).join(
        roc_auc(df, keys).withColumnRenamed("auc", "roc_auc"), keys
    )
    return wide.unpivot(keys, ["sens", "spec", "accuracy", "roc_auc"], "metric", "estimate")


def collect_metrics(folds: DataFrame, keys: Sequence[str] = ("model", "param_id")) -> DataFrame:
    """Mean, number and standard error of each metric over the folds."""
    return folds.groupBy(*keys, "metric").agg(
        F.avg("estimate").alias("mean"), F.count("estimate").alias("n"),
        (F.stddev_samp("estimate") / F.sqrt(F.count("estimate"))).alias("std_err"),
    )


def select_best(
    collected: DataFrame, keys: Sequence[str] = ("model",), metric: str = "roc_auc"
) -> DataFrame:
    """The parameter row with the highest mean; ties go to the lowest ``param_id``."""
    rows = collected.filter(F.col("metric") == metric)
    return first_per_group(rows, keys, [F.col("mean").desc_nulls_last(), "param_id"])
