"""Inputs of the registered queries, all derived from the ``events`` table by Spark.

The clean diary, the predictions, the metrics and the importances are written once per session
and read back, as an analysis saves them between its steps.
"""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diarist.operators import compare, evaluate
from diarist.operators.features import dummies
from diarist.operators.resample import hex_digit
from diarist.plans.clean import Rules, clean_diary, cohort, intake
from diarist.schema import FLAGS, KEY, MODELS, ORDINAL, OUTCOME
from diarist.scratch import scratch_path
from diarist.sources.events_diary import ENTRY_FROM, QUIT_BEFORE, QUIT_FROM, events_diary

RULES = Rules(quit_from=QUIT_FROM, quit_before=QUIT_BEFORE, entry_from=ENTRY_FROM)


_SAVED: dict[tuple[str, str, str], str] = {}


def saved(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name``, written on first use in this session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key in _SAVED:
        try:
            return spark.read.parquet(_SAVED[key])
        except AnalysisException:  # the folder was cleaned
            del _SAVED[key]
    path = scratch_path(spark, name)
    build().write.parquet(path)
    _SAVED[key] = path
    return spark.read.parquet(path)


_KEPT: dict[tuple[str, str, str], object] = {}


def kept(spark: SparkSession, sf: str, name: str, build: Callable):
    """A training result, made on first use in this session. Its tables are in the scratch folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _KEPT:
        _KEPT[key] = build()
    return _KEPT[key]


def forget() -> None:
    """Make the next query write its inputs and train its models again."""
    _SAVED.clear()
    _KEPT.clear()


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return events_diary(spark, sf)


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that pass all row rules, duplicates included."""
    return intake(raw(spark, sf), RULES)


def live(spark: SparkSession, sf: str) -> DataFrame:
    """The clean diary, computed from the raw one."""
    return clean_diary(raw(spark, sf), RULES)


def clean(spark: SparkSession, sf: str) -> DataFrame:
    """The clean diary, saved."""
    return saved(spark, sf, "clean", lambda: live(spark, sf))


def sample(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts with at least 20 entries."""
    return cohort(clean(spark, sf))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return saved(spark, sf, "predictions", lambda: _predictions(spark, sf))


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of four stand-in models for every entry of the sample, without training.

    The constant "xgb" scores are missing for accounts with fewer than 25 entries, like a model
    that failed.
    """
    scores = {
        "rf": F.col("craving_severity") / 10,
        "elnet": F.when(F.col("craving_feeling_stressed") == "true", 0.5).otherwise(0.2),
        "svm": hex_digit(F.md5(F.col(ORDINAL).cast("string")), 1, 12) / F.lit(float(16**12)),
        "xgb": F.when(F.col("n_entries") >= 25, 0.5),
    }
    cells = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), scores[m].alias("score")) for m in MODELS
    ]))
    return sample(spark, sf).select(
        F.col(ORDINAL).alias("row_id"), KEY,
        (F.col(OUTCOME) == "true").cast("int").alias("label"), cells.alias("c"),
    ).select("row_id", KEY, "label", "c.*").filter(F.col("score").isNotNull())


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    """(account_id, model, metric, estimate) of the predictions."""
    return saved(
        spark, sf, "metrics",
        lambda: evaluate.metrics_long(predictions(spark, sf), [KEY, "model"]),
    )


def wide(spark: SparkSession, sf: str) -> DataFrame:
    return compare.metrics_wide(metrics(spark, sf))


def best(spark: SparkSession, sf: str) -> DataFrame:
    return compare.best_model_per_account(wide(spark, sf))


def best_long(spark: SparkSession, sf: str) -> DataFrame:
    return compare.metrics_unpivot(best(spark, sf))


def group_scores(spark: SparkSession, sf: str) -> DataFrame:
    """AUC of the "rf" scores for accounts with lapses and non-lapses; others have no row."""
    rf = predictions(spark, sf).filter("model = 'rf'")
    return evaluate.roc_auc(rf, [KEY]).filter("auc IS NOT NULL")


FEATURES = ["prior_event_lapse"] + FLAGS + ["time_to_first_cig", "wkday_craving", "time_of_day"]


def importance(spark: SparkSession, sf: str) -> DataFrame:
    return saved(spark, sf, "importance", lambda: _importance(spark, sf))


def _importance(spark: SparkSession, sf: str) -> DataFrame:
    """(account_id, model, variable, importance): how each indicator differs by outcome."""
    indicators = dummies(FEATURES) | {
        "craving_severity": F.col("craving_severity") / 10, "cigs_per_day": F.col("cigs_per_day") / 200,
        "days_since_qd": F.col("days_since_qd") / 100,
        "mins_since_prev_rep": F.coalesce(F.col("mins_since_prev_rep"), F.lit(0)) / 100000,
    }
    df = sample(spark, sf).select(KEY, OUTCOME, *[c.alias(n) for n, c in indicators.items()])
    # One average for each indicator and outcome; conditional averages are more code than Spark compiles.
    per = df.groupBy(KEY, (F.col(OUTCOME) == "true").alias("_lapse")).agg(
        F.array(*[F.avg(n) for n in indicators]).alias("_rates")
    )
    both = per.groupBy(KEY).agg(
        F.max(F.when(F.col("_lapse"), F.col("_rates"))).alias("_on"),
        F.max(F.when(~F.col("_lapse"), F.col("_rates"))).alias("_off"),
    )
    names = F.posexplode(F.array(*[F.lit(n) for n in indicators])).alias("_nr", "variable")
    zero = F.lit(0.0)
    rates = both.select("*", names).select(
        KEY, "variable", F.coalesce(F.get("_on", F.col("_nr")), zero).alias("on"),
        F.coalesce(F.get("_off", F.col("_nr")), zero).alias("off"),
    )
    by_model = {
        "rf": F.abs(F.col("on") - F.col("off")), "elnet": F.col("on"),
        "svm": F.col("off"), "xgb": (F.col("on") + F.col("off")) / 2,
    }
    models = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.bround(v, 6).alias("importance")) for m, v in by_model.items()
    ]))
    return rates.select(KEY, "variable", models.alias("m")).select(KEY, "variable", "m.*")


def tuning(spark: SparkSession, sf: str) -> DataFrame:
    return saved(spark, sf, "tuning", lambda: _tuning(spark, sf))


def _tuning(spark: SparkSession, sf: str) -> DataFrame:
    """(model, param_id, fold, metric, estimate): scores read at two cut-offs over ten folds."""
    from diarist.operators.resample import kfold

    scored = predictions(spark, sf)
    folds = kfold(sample(spark, sf).select(ORDINAL), 10).withColumnRenamed(ORDINAL, "row_id")
    scored = scored.join(folds, "row_id")
    params = F.explode(F.array(F.lit(0), F.lit(1))).alias("param_id")
    shifted = F.when(F.col("param_id") == 0, F.col("score")).otherwise(F.abs(F.col("score") - 0.5))
    scored = scored.select("model", "fold", "label", "score", params).withColumn("score", shifted)
    return evaluate.metrics_long(scored, ["model", "param_id", "fold"])
