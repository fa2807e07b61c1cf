"""Queries that have a SQL twin."""

from functools import wraps

from pyspark.sql import functions as F

from catalog import inputs
from catalog.rounding import rounded
from diarist.functions import labels, times
from diarist.operators import cohort, compare, describe, evaluate, features, filters, resample, sequence
from diarist.plans import clean as plan
from diarist.plans import holdout, pooled
from diarist.plans.clean import adjusted_times
from diarist.schema import FLAGS, KEY, LEVELS, ORDINAL, OUTCOME, RAW_COLUMNS, TIME
from diarist.scratch import scratch_path
from diarist.sources import tables

QUERIES = {}


def query(fn):
    """Register a query; its result is rounded, what it is computed from isn't."""
    QUERIES[fn.__name__] = wraps(fn)(lambda spark, sf: rounded(fn(spark, sf)))
    return fn


def _from(source, columns):
    """Input columns that identify an entry, then ``columns``."""
    return source.select(ORDINAL, KEY, *columns)


# Sources and sinks

@query
def scan_diary(spark, sf):
    """A diary as text, its columns in another order and one more, without ordinals."""
    path = scratch_path(spark, "csv")
    plain = inputs.raw(spark, sf).select(*reversed(RAW_COLUMNS), F.lit("x").alias("further"))
    plain.write.option("header", True).option("nullValue", "NA").option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS"
    ).csv(path)
    return tables.parse_times(tables.scan_diary(spark, path)).drop(ORDINAL)


@query
def write_if_absent(spark, sf):
    """The table behind a figure: the second write leaves the first one."""
    path = scratch_path(spark, "figure")
    counts = describe.entries_per_account(inputs.clean(spark, sf))
    tables.write_if_absent(counts, path)
    tables.write_if_absent(counts.limit(0), path)
    return tables.read_table(spark, path)


@query
def read_clean(spark, sf):
    path = scratch_path(spark, "clean")
    tables.write_table(inputs.live(spark, sf), path)
    return tables.read_table(spark, path).drop("next_event_lapse", "n_entries", "n_lapses")


@query
def read_clean_bucketed(spark, sf):
    """Entries numbered and joined to the totals of their accounts, from a table bucketed by account."""
    path = scratch_path(spark, "clean-bucketed")
    name = f"clean_{path[-32:]}"
    tables.write_clean(inputs.live(spark, sf), name, 8, path)
    return tables.numbered_entries(spark.table(name))


@query
def roc_panels(spark, sf):
    path = scratch_path(spark, "panels")
    scored = inputs.predictions(spark, sf)
    for analysis, keep in [("all", "score >= 0"), ("stressed", "score >= 0.2")]:
        curves = evaluate.roc_curve(scored.filter(keep), ["model"])
        tables.write_table(filters.tag(curves, "analysis", analysis), path, ["analysis"], "append")
    return tables.scan_roc_panels(spark, path).select(
        "analysis", "model", "threshold", "specificity", "sensitivity"
    )


# Projections and filters

@query
def eligible_entries(spark, sf):
    return filters.eligible_entries(inputs.raw(spark, sf))


@query
def project_by_list(spark, sf):
    return filters.project(inputs.raw(spark, sf), RAW_COLUMNS)


@query
def drop_columns(spark, sf):
    return filters.drop_columns(inputs.raw(spark, sf), FLAGS + ["did_someone_smoke"])


@query
def study_window(spark, sf):
    r = inputs.RULES
    df = adjusted_times(filters.eligible_entries(inputs.raw(spark, sf)))
    df = filters.study_window(df, r.quit_from, r.quit_before, r.entry_from)
    return _from(df, ["adjusted_quit_date", TIME])


@query
def relative_window(spark, sf):
    df = filters.relative_window(adjusted_times(inputs.raw(spark, sf)))
    return _from(df, ["adjusted_quit_date", TIME])


@query
def recall_window(spark, sf):
    df = filters.recall_window(adjusted_times(inputs.raw(spark, sf)))
    return _from(df, ["adjusted_craving_date", TIME])


@query
def dedup_entries(spark, sf):
    return _from(filters.dedup_entries(inputs.entries(spark, sf)), [TIME, OUTCOME, "craving_severity"])


@query
def min_entries(spark, sf):
    return _from(cohort.min_entries(inputs.clean(spark, sf)), [OUTCOME])


@query
def mixed_outcome_accounts(spark, sf):
    return _from(cohort.mixed_outcome_accounts(inputs.sample(spark, sf)), [OUTCOME])


@query
def any_lapse_accounts(spark, sf):
    return _from(cohort.any_lapse_accounts(inputs.sample(spark, sf)), [OUTCOME])


@query
def class_count_cutoff(spark, sf):
    return _from(cohort.class_count_cutoff(inputs.sample(spark, sf)), [OUTCOME])


@query
def class_cutoff_accounts(spark, sf):
    """Accounts that pass each of the three cut-offs, in samples of 1+, 10+ and 20+ entries."""
    counts = cohort.account_counts(inputs.clean(spark, sf))
    tests = {w: cohort.class_cutoff(5, w) for w in ("true", "false", "both")}
    parts = F.explode(F.array(*[F.lit(n) for n in (1, 10, 20)])).alias("at_least")
    return counts.select("*", parts).filter("n >= at_least").groupBy("at_least").agg(
        F.count("*").alias("accounts"), *[F.count_if(c).alias(f"over_5_{w}") for w, c in tests.items()]
    )


@query
def impute_zero(spark, sf):
    return _from(filters.impute_zero(inputs.sample(spark, sf)), ["mins_since_prev_rep"])


@query
def drop_null_keys(spark, sf):
    df = adjusted_times(inputs.raw(spark, sf))
    return _from(filters.drop_null_keys(df, ["timezone_offset", "adjusted_craving_date"]), ["timezone_offset"])


@query
def rename_cols(spark, sf):
    return filters.rename_cols(inputs.group_scores(spark, sf), {"auc": "group_auc"})


@query
def keep_metrics(spark, sf):
    return filters.keep_metrics(inputs.metrics(spark, sf))


@query
def tag_column(spark, sf):
    return filters.tag(inputs.group_scores(spark, sf), "model", labels.MODEL_LABELS["rf"])


@query
def complete_accounts(spark, sf):
    return compare.complete_accounts(inputs.metrics(spark, sf))


# Scalar and derived columns

@query
def parse_times(spark, sf):
    text = F.when(F.col(ORDINAL) % 10 == 3, F.lit("not a time")).when(
        F.col(ORDINAL) % 10 == 4, F.lit("")
    ).otherwise(F.col("craving_record_created").cast("string"))
    df = inputs.raw(spark, sf).withColumn("written", text)
    return _from(tables.parse_times(df, ["written"]), ["written"])


@query
def apply_offset(spark, sf):
    return _from(
        adjusted_times(inputs.raw(spark, sf)), ["adjusted_quit_date", TIME, "adjusted_craving_date"]
    )


@query
def time_diff(spark, sf):
    df = adjusted_times(inputs.raw(spark, sf))
    diffs = [
        times.time_diff(F.col(TIME), F.col("adjusted_quit_date"), unit).alias(unit)
        for unit in times.MICROS
    ]
    return _from(df, diffs)


@query
def calendar_fields(spark, sf):
    df = plan.calendar_fields(adjusted_times(inputs.raw(spark, sf)))
    return _from(df, ["wkday_craving", F.hour(TIME).alias("hour_craving"), "time_of_day"])


@query
def days_since_quit(spark, sf):
    return _from(inputs.live(spark, sf), ["days_since_qd"])


@query
def category_levels(spark, sf):
    """Position of each category in its declared level list; null outside the list."""
    df = inputs.raw(spark, sf)
    nr = labels.level_order(F.col("time_to_first_cig"), LEVELS["time_to_first_cig"])
    return _from(df, ["time_to_first_cig", nr.cast("int").alias("level_nr")])


@query
def cast_columns(spark, sf):
    df = inputs.raw(spark, sf)
    return _from(df, [
        F.col("time_to_first_cig").try_cast("int").alias("number"),
        F.col("cigs_per_day").cast("string").alias("text"),
    ])


@query
def feature_labels(spark, sf):
    """Accounts per variable, with the readable label of every kind of model."""
    counts = inputs.importance(spark, sf).groupBy("variable").agg(F.count_distinct(KEY).alias("accounts"))
    named = {f"label_{r}": labels.clean_feature_label(F.col("variable"), r) for r in labels.LABEL_RULES}
    return counts.withColumns(named)


@query
def feature_groups(spark, sf):
    counts = inputs.importance(spark, sf).groupBy("variable").agg(F.max("importance").alias("most"))
    label = labels.clean_feature_label(F.col("variable"))
    return counts.select(
        "variable", labels.name_suffix(F.col("variable")).alias("suffix"),
        labels.feature_group(label).alias("feature_group"), "most",
    )


@query
def model_names(spark, sf):
    """Models in capitals and metrics by display name."""
    return inputs.metrics(spark, sf).select(
        KEY, F.upper("model").alias("model"),
        labels.lookup(F.col("metric"), labels.METRIC_LABELS).alias("metric"), "estimate",
    )


# Joins

@query
def compare_to_group(spark, sf):
    return compare.compare_to_group(inputs.best(spark, sf), inputs.group_scores(spark, sf))


@query
def preference_share(spark, sf):
    return compare.preference_share(compare_to_group(spark, sf))


@query
def best_model_importance(spark, sf):
    top = compare.top_features(inputs.importance(spark, sf))
    return compare.best_model_importance(inputs.best(spark, sf), top)


@query
def restrict_to_accounts(spark, sf):
    ids = describe.entries_per_account(inputs.clean(spark, sf)).filter("count >= 30").select(KEY)
    return _from(cohort.restrict_to_accounts(inputs.entries(spark, sf), ids), [TIME])


@query
def remove_sampled_rows(spark, sf):
    df = inputs.sample(spark, sf)
    moved = resample.hybrid_split(df.select(ORDINAL, KEY)).filter("role = 'training'")
    return _from(resample.remove_sampled_rows(df, moved), [OUTCOME])


@query
def combine_algorithms(spark, sf):
    return compare.combine_algorithms(inputs.metrics(spark, sf))


@query
def leave_one_account_out(spark, sf):
    mixed = cohort.mixed_outcome_accounts(inputs.sample(spark, sf))
    return resample.holdout_sizes(mixed)


@query
def holdout_groups(spark, sf):
    """Testing rows and accounts of ten held-out groups of accounts."""
    held = resample.holdout_groups(inputs.sample(spark, sf).select(KEY), 10)
    return held.groupBy("holdout").agg(
        F.count("*").alias("testing"), F.count_distinct(KEY).alias("accounts")
    )


@query
def holdout_roles(spark, sf):
    """Rows each fit of ten held-out groups learns from and is tested on."""
    return holdout.holdout_roles(inputs.sample(spark, sf).select(ORDINAL, KEY, OUTCOME), 10)


@query
def holdout_roles_hybrid(spark, sf):
    """The same, with 20% of each held-out account's entries in training."""
    return holdout.holdout_roles(inputs.sample(spark, sf).select(ORDINAL, KEY, OUTCOME), 10, 0.2)


# Aggregations

@query
def entries_per_account(spark, sf):
    return describe.entries_per_account(inputs.clean(spark, sf))


@query
def attrition(spark, sf):
    return plan.attrition(inputs.raw(spark, sf), inputs.RULES)


@query
def coverage_thresholds(spark, sf):
    return plan.coverage_thresholds(inputs.raw(spark, sf), inputs.RULES)


@query
def tabulate_one(spark, sf):
    return describe.tabulate_one(sequence.first_entry(inputs.sample(spark, sf)), "time_to_first_cig")


@query
def tabulate_two(spark, sf):
    return describe.tabulate_two(inputs.sample(spark, sf), KEY, OUTCOME, LEVELS[OUTCOME])


@query
def relative_flags(spark, sf):
    df = adjusted_times(inputs.raw(spark, sf))
    return describe.flag_tabulation(df, filters.relative_flag())


@query
def recall_flags(spark, sf):
    df = adjusted_times(inputs.raw(spark, sf))
    return describe.flag_tabulation(df, filters.recall_flag())


@query
def mean_sd(spark, sf):
    return describe.mean_sd(sequence.first_entry(inputs.sample(spark, sf)), "cigs_per_day")


@query
def median_range(spark, sf):
    return describe.median_range(describe.entries_per_account(inputs.clean(spark, sf)), "count")


@query
def sample_characteristics(spark, sf):
    return describe.sample_characteristics(describe.account_baselines(inputs.clean(spark, sf)))


@query
def sample_levels(spark, sf):
    return describe.sample_levels(describe.account_baselines(inputs.clean(spark, sf)))


@query
def outcome_counts_wide(spark, sf):
    return describe.outcome_counts_wide(inputs.sample(spark, sf))


@query
def outcome_share(spark, sf):
    return describe.outcome_share(inputs.sample(spark, sf))


@query
def lapse_share_per_account(spark, sf):
    return describe.lapse_share_per_account(inputs.sample(spark, sf))


@query
def lapse_share_summary(spark, sf):
    return describe.lapse_share_summary(describe.lapse_share_per_account(inputs.sample(spark, sf)))


@query
def max_days_since_quit(spark, sf):
    return describe.max_days_since_quit(inputs.sample(spark, sf))


@query
def median_gap(spark, sf):
    return describe.median_gap(inputs.sample(spark, sf))


@query
def gap_range(spark, sf):
    return describe.median_range(filters.impute_zero(inputs.sample(spark, sf)), "mins_since_prev_rep")


@query
def last_entry(spark, sf):
    return _from(sequence.last_entry(inputs.sample(spark, sf)), [TIME, OUTCOME])


@query
def last_outcome(spark, sf):
    return describe.last_outcome(inputs.sample(spark, sf))


@query
def relapse_transition(spark, sf):
    return describe.relapse_transition(plan.cohort(inputs.live(spark, sf)))


@query
def endorsement_rates(spark, sf):
    return describe.endorsement_rates(inputs.sample(spark, sf), features.NOMINAL)


@query
def histogram_lapse_share(spark, sf):
    return describe.histogram(describe.lapse_share_per_account(inputs.sample(spark, sf)), "prop")


@query
def histogram_days(spark, sf):
    return describe.histogram(describe.max_days_since_quit(inputs.sample(spark, sf)), "days")


@query
def histogram_gap(spark, sf):
    return describe.histogram(describe.median_gap(inputs.sample(spark, sf)), "mins")


@query
def histogram_cigs_by_outcome(spark, sf):
    return describe.histogram(inputs.sample(spark, sf), "cigs_per_day", by=[OUTCOME])


@query
def histogram_severity_by_outcome(spark, sf):
    return describe.histogram(inputs.sample(spark, sf), "craving_severity", by=[OUTCOME])


@query
def histogram_days_by_outcome(spark, sf):
    return describe.histogram(inputs.sample(spark, sf), "days_since_qd", by=[OUTCOME])


@query
def histogram_by_model(spark, sf):
    kept = filters.keep_metrics(inputs.best_long(spark, sf))
    return describe.histogram(kept, "value", by=["metric", "model"], limits=(0, 1.1))


@query
def box_stats(spark, sf):
    box = describe.box_stats(inputs.wide(spark, sf), "roc_auc", ["model"])
    return box.select("model", "q1", "median", "q3", "whisker_low", "whisker_high", "outliers")


@query
def metric_summary(spark, sf):
    return compare.metric_summary(inputs.metrics(spark, sf))


@query
def best_metric_summary(spark, sf):
    long = inputs.best_long(spark, sf).withColumnRenamed("value", "estimate")
    return compare.metric_summary(long).filter("model IS NULL").drop("model")


@query
def metric_median(spark, sf):
    return compare.metric_median(inputs.best_long(spark, sf))


@query
def group_mean_column(spark, sf):
    return compare.group_mean_column(inputs.best_long(spark, sf))


@query
def importance_prevalence(spark, sf):
    top = compare.top_features(inputs.importance(spark, sf))
    return compare.labelled_prevalence(compare.importance_prevalence(top, top))


@query
def best_importance_prevalence(spark, sf):
    rows = best_model_importance(spark, sf)
    return compare.labelled_prevalence(compare.importance_prevalence(rows, rows, ["variable"]))


@query
def metrics_wide(spark, sf):
    return inputs.wide(spark, sf)


@query
def metrics_long(spark, sf):
    return inputs.best_long(spark, sf)


@query
def distinct_accounts(spark, sf):
    return inputs.clean(spark, sf).select(KEY).distinct()


@query
def metric_thresholds(spark, sf):
    return compare.metric_thresholds(inputs.best_long(spark, sf))


# Windows

@query
def clean_diary(spark, sf):
    return inputs.live(spark, sf)


@query
def event_nr(spark, sf):
    return _from(inputs.live(spark, sf), ["event_nr"])


@query
def prior_event_lapse(spark, sf):
    return _from(inputs.live(spark, sf), [OUTCOME, "prior_event_lapse"])


@query
def mins_since_prev(spark, sf):
    return _from(inputs.live(spark, sf), ["mins_since_prev_rep"])


@query
def next_event_lapse(spark, sf):
    return _from(inputs.live(spark, sf), [OUTCOME, "next_event_lapse"])


@query
def entries_window(spark, sf):
    return _from(inputs.live(spark, sf), ["n_entries", "n_lapses"])


@query
def lapse_rate_window(spark, sf):
    df = sequence.account_shares(filters.dedup_entries(inputs.entries(spark, sf)))
    return _from(df, ["n_entries", "prop_lapses", "prop_non_lapses"])


@query
def first_entry(spark, sf):
    return _from(sequence.first_entry(inputs.clean(spark, sf)), [TIME, "cigs_per_day"])


@query
def share_of_total(spark, sf):
    counts = inputs.clean(spark, sf).groupBy("time_of_day").agg(F.count("*").alias("n"))
    return describe.share_of_total(counts)


# Sorts and top-k

@query
def best_model_per_account(spark, sf):
    return inputs.best(spark, sf)


@query
def best_model_counts(spark, sf):
    return describe.tabulate_one(inputs.best(spark, sf), "model")


@query
def rank_models(spark, sf):
    return compare.rank_models(inputs.wide(spark, sf))


@query
def top_features(spark, sf):
    return compare.top_features(inputs.importance(spark, sf))


# Set operations

@query
def combine_curves(spark, sf):
    """Curves of the four models computed one by one and united."""
    scored = inputs.predictions(spark, sf)
    out = None
    for model in ("rf", "elnet", "svm", "xgb"):
        curve = evaluate.roc_curve(scored.filter(F.col("model") == model))
        curve = filters.tag(curve, "model", model)
        out = curve if out is None else out.unionByName(curve)
    return compare.combined_roc(out)


@query
def union_roles(spark, sf):
    """Kept and moved rows of the hybrid split, put together again."""
    df = inputs.sample(spark, sf).select(ORDINAL, KEY, OUTCOME)
    moved = resample.hybrid_split(df).filter("role = 'training'")
    kept = resample.remove_sampled_rows(df, moved)
    return moved.unionByName(kept, allowMissingColumns=True)


# Resampling

@query
def train_test_split(spark, sf):
    return _from(resample.train_test_split(inputs.sample(spark, sf).select(ORDINAL, KEY)), ["split"])


@query
def stratified_split(spark, sf):
    df = inputs.sample(spark, sf).select(ORDINAL, KEY, OUTCOME)
    return _from(resample.train_test_split(df, keys=[KEY, OUTCOME]), [OUTCOME, "split"])


@query
def kfold(spark, sf):
    df = resample.train_test_split(inputs.sample(spark, sf).select(ORDINAL, KEY))
    return _from(resample.kfold(df.filter("split = 'training'")), ["fold"])


@query
def downsample(spark, sf):
    return _from(resample.downsample(inputs.sample(spark, sf).select(ORDINAL, KEY, OUTCOME)), [OUTCOME])


@query
def upsample(spark, sf):
    return _from(resample.upsample(inputs.sample(spark, sf).select(ORDINAL, KEY, OUTCOME)), [OUTCOME, "draw"])


@query
def upsample_by_account(spark, sf):
    df = inputs.sample(spark, sf).select(ORDINAL, KEY, OUTCOME)
    return _from(resample.upsample(df, [KEY]), [OUTCOME, "draw"])


@query
def hybrid_split(spark, sf):
    return _from(resample.hybrid_split(inputs.sample(spark, sf).select(ORDINAL, KEY)), ["role"])


@query
def hybrid_split_40(spark, sf):
    return _from(resample.hybrid_split(inputs.sample(spark, sf).select(ORDINAL, KEY), 0.4), ["role"])


# Features

@query
def dummy_encode(spark, sf):
    df = inputs.sample(spark, sf).select(ORDINAL, KEY, *features.NOMINAL)
    return features.dummy_encode(df, features.NOMINAL)


@query
def poly_contrast(spark, sf):
    df = inputs.sample(spark, sf).select(ORDINAL, KEY, "wkday_craving")
    out = features.dummy_encode(df, ["wkday_craving"], ["wkday_craving"])
    names = list(features.poly_contrast("wkday_craving"))
    return _from(out, names)


@query
def normalize(spark, sf):
    df = filters.impute_zero(inputs.sample(spark, sf)).select(ORDINAL, KEY, *features.NUMERIC)
    split = resample.train_test_split(df)
    out = features.normalize(split, features.NUMERIC, split.filter("split = 'training'"))
    return _from(out, features.NUMERIC)


@query
def zero_variance(spark, sf):
    """Which indicators are constant within each account."""
    encoded = features.dummy_encode(inputs.sample(spark, sf), FLAGS)
    return features.zero_variance(encoded, [f"{c}_true" for c in FLAGS] + ["cigs_per_day"], [KEY])


@query
def drop_zero_variance(spark, sf):
    """The indicators that vary over the sample, beside those that can't."""
    df = inputs.sample(spark, sf).select(
        ORDINAL, KEY, *FLAGS, F.lit(1).alias("one"), F.lit(None).cast("int").alias("missing")
    )
    return features.drop_zero_variance(df, [*FLAGS, "one", "missing"])


@query
def recipe_statistics(spark, sf):
    """Means and standard deviations that the scalers of ten folds and of the final fit hold."""
    rows = pooled.prepare(inputs.sample(spark, sf), pooled.Design(), folds=10)
    return pooled.recipe_statistics(rows, pooled.Design(), 10)


# Evaluation

@query
def class_metrics(spark, sf):
    return evaluate.class_metrics(inputs.predictions(spark, sf), ["model"])


@query
def roc_auc(spark, sf):
    return evaluate.roc_auc(inputs.predictions(spark, sf), [KEY, "model"])


@query
def auc_ci(spark, sf):
    return evaluate.auc_ci(inputs.predictions(spark, sf), ["model"])


@query
def auc_ci_by_account(spark, sf):
    return evaluate.auc_ci(inputs.predictions(spark, sf), [KEY, "model"])


@query
def auc_auto_direction(spark, sf):
    return evaluate.auc_ci(inputs.predictions(spark, sf), [KEY, "model"], direction="auto").select(
        KEY, "model", "auc"
    )


@query
def roc_curve(spark, sf):
    return evaluate.roc_curve(inputs.predictions(spark, sf), ["model"])


@query
def auc_summary(spark, sf):
    """Median and range of the AUC over accounts."""
    auc = evaluate.roc_auc(inputs.predictions(spark, sf).filter("model = 'rf'"), [KEY])
    return describe.quantiles(auc, "auc", {"min": 0, "median": 0.5, "max": 1})


@query
def collect_metrics(spark, sf):
    return evaluate.collect_metrics(inputs.tuning(spark, sf))


@query
def select_best(spark, sf):
    return evaluate.select_best(evaluate.collect_metrics(inputs.tuning(spark, sf)))
