"""Shape of the physical plans."""

import re

from catalog import inputs
from diarist.operators import describe, filters, resample
from diarist.plans.clean import Rules, attrition, clean_diary, cohort, intake
from diarist.schema import KEY, ORDINAL, OUTCOME


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def details_of(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def exchanges(df):
    return re.findall(r"(?<!Broadcast)Exchange (\w+)\(([^)]*)", plan_of(df))


def stored(spark, sf, tmp_path):
    path = str(tmp_path / "raw")
    inputs.raw(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


def test_filters_and_columns_reach_the_scan(spark, sf, tmp_path):
    plan = details_of(intake(stored(spark, sf, tmp_path), inputs.RULES).select(KEY))
    assert "LessThanOrEqual(cigs_per_day,100)" in re.search(r"PushedFilters: (.*)", plan).group(1)
    assert "craving_env_alone" not in re.search(r"ReadSchema: (.*)", plan).group(1)


def test_duplicates_are_cut_before_the_shuffle(spark, sf, tmp_path):
    plan = plan_of(filters.dedup_entries(intake(stored(spark, sf, tmp_path), inputs.RULES)))
    limits = [plan.index(m.group()) for m in re.finditer(r"WindowGroupLimit .*Partial", plan)]
    assert limits and limits[0] > plan.index("Exchange")  # printed below it, so it runs before


def test_rows_are_shuffled_once_for_duplicates_and_sequence(spark, sf, tmp_path):
    """One shuffle by account; the others belong to hot accounts: their duplicates and parts."""
    df = clean_diary(stored(spark, sf, tmp_path), Rules())
    wide = [k for k in re.findall(r"Exchange hashpartitioning\((.*?), 8\)", plan_of(df))]
    names = [tuple(re.sub(r"#\d+L?", "", k).split(", ")) for k in wide]
    assert set(names) == {
        ("account_id",), ("account_id", "adjusted_craving_record_created"), ("account_id", "_d0"),
        ("account_id", "_slot"),
    }
    assert "REPARTITION_BY_COL" in plan_of(df)


def test_only_aggregates_go_to_one_task(spark, sf):
    sample = inputs.sample(spark, sf)
    for df in (
        resample.train_test_split(sample), resample.downsample(sample), resample.kfold(sample),
        resample.upsample(sample), describe.outcome_share(sample),
        attrition(inputs.raw(spark, sf), inputs.RULES),
    ):
        lines = plan_of(df).splitlines()
        for line, below in zip(lines, lines[1:]):
            if "SinglePartition" in line:
                assert "HashAggregate" in below or "Project" in below, (line, below)
                assert "Aggregate" in "".join(lines[lines.index(line):][:4]), line


def test_saved_cohort_needs_no_shuffle(spark, sf):
    assert exchanges(cohort(inputs.clean(spark, sf)).select(ORDINAL, OUTCOME)) == []
    assert "GreaterThanOrEqual(n_entries,20)" in details_of(cohort(inputs.clean(spark, sf)))


def test_shares_need_one_shuffle(spark, sf):
    assert len(exchanges(describe.lapse_share_per_account(inputs.sample(spark, sf)))) == 1
    assert len(exchanges(describe.endorsement_rates(inputs.sample(spark, sf), ["time_of_day"]))) == 1


def test_no_cross_joins(spark, sf):
    import __spark_entry__ as contract

    for name in ("upsample", "holdout_groups", "metric_summary", "importance_prevalence", "normalize"):
        plan = plan_of(contract.queries()[name](spark, sf))
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name
