"""Edges of the row rules, and the golden numbers of the fixture."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from catalog import inputs
from diarist.functions import labels, times
from diarist.operators import cohort, filters, sequence
from diarist.plans import clean as plan
from diarist.schema import CLEAN_COLUMNS, KEY, ORDINAL, OUTCOME, TIME

NOON = datetime(2024, 1, 1, 12)


def values(df, column):
    return [r[column] for r in df.collect()]


def test_relative_window_keeps_both_ends(spark):
    ends = [timedelta(weeks=12), timedelta(weeks=12, seconds=1), timedelta(seconds=-1), timedelta(0)]
    df = spark.createDataFrame(
        [(NOON, NOON + d) for d in ends], f"adjusted_quit_date timestamp_ntz, {TIME} timestamp_ntz"
    )
    assert values(df.select(filters.relative_flag().alias("f")), "f") == [
        "include", "exclude", "exclude", "include",
    ]


def test_recall_window_rounds_to_hundredths_and_keeps_null(spark):
    hours = [24.004, 24.006, -0.004, None]
    df = spark.createDataFrame(
        [(NOON, NOON - timedelta(hours=h) if h is not None else None) for h in hours],
        f"{TIME} timestamp_ntz, adjusted_craving_date timestamp_ntz",
    )
    assert values(df.select(filters.recall_flag().alias("f")), "f") == [
        "include", "exclude", "include", "include",
    ]


def test_half_days_round_to_even(spark):
    df = spark.createDataFrame([(NOON, NOON + timedelta(days=d)) for d in (0.5, 1.5, 2.5)], "a timestamp_ntz, b timestamp_ntz")
    assert values(df.select(times.days_since(F.col("b"), F.col("a")).alias("d")), "d") == [0, 2, 2]


def test_parts_of_the_day(spark):
    want = {4: "night", 5: "morning", 10: "morning", 11: "midday", 16: "midday", 17: "evening",
            21: "evening", 22: "night", 0: "night"}
    df = spark.createDataFrame([(h, datetime(2024, 1, 1, h, 59)) for h in want], "h int, t timestamp_ntz")
    got = {r["h"]: r["p"] for r in df.select("h", times.time_of_day(F.col("t")).alias("p")).collect()}
    assert got == want


def test_null_time(spark):
    df = spark.createDataFrame([(None,)], "t timestamp_ntz")
    row = df.select(times.weekday_label(F.col("t")).alias("w"), times.time_of_day(F.col("t")).alias("p")).first()
    assert tuple(row) == ("NA", "night")


def test_text_times(spark):
    texts = ["2024-01-02 03:04:05", "2024-01-02", "junk", "", None, "2024-13-02 03:04:05"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = values(df.select(times.parse_time(F.col("t")).alias("t")), "t")
    assert got == [datetime(2024, 1, 2, 3, 4, 5)] + [None] * 5


def test_null_offset_moves_nothing(spark):
    df = spark.createDataFrame([(NOON, None), (NOON, -3600)], "t timestamp_ntz, o int")
    got = values(df.select(times.apply_offset(F.col("t"), F.col("o")).alias("t")), "t")
    assert got == [NOON, NOON - timedelta(hours=1)]


def test_dedup_keeps_the_first_and_is_idempotent(spark):
    rows = [("a", NOON, 2, "true"), ("a", NOON, 1, "false"), ("b", NOON, 3, "true")]
    df = spark.createDataFrame(rows, f"{KEY} string, {TIME} timestamp_ntz, {ORDINAL} bigint, {OUTCOME} string")
    once = filters.dedup_entries(df)
    assert sorted(values(once, ORDINAL)) == [1, 3]
    assert sorted(values(filters.dedup_entries(once), ORDINAL)) == [1, 3]


def test_strict_column_lists(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        filters.project(df, ["a", "c"])
    with pytest.raises(ValueError):
        filters.drop_columns(df, ["c"])
    assert filters.drop_columns(df, ["b", "c"], strict=False).columns == ["a"]


def test_sequence_of_a_single_entry(spark):
    df = spark.createDataFrame([("a", NOON, 1, "true")], f"{KEY} string, {TIME} timestamp_ntz, {ORDINAL} bigint, {OUTCOME} string")
    row = sequence.sequence_features(df).first()
    assert (row["event_nr"], row["prior_event_lapse"], row["mins_since_prev_rep"]) == (1, "no", None)
    assert (row["next_event_lapse"], row["n_entries"], row["n_lapses"]) == ("no", 1, 1)


@pytest.mark.parametrize("scale,entries,accounts,lapses,again,days,gaps", [
    ("0.001", 490, 12, 104, 46, 6328, 421893),
    ("0.01", 3769, 97, 758, 225, 52160, 3213454),
])
def test_golden_numbers(spark, scale, entries, accounts, lapses, again, days, gaps):
    df = plan.cohort(inputs.live(spark, f"/root/testdata/sf{scale}"))
    lapse = F.col(OUTCOME) == "true"
    row = df.agg(
        F.count("*"), F.count_distinct(KEY), F.count_if(lapse),
        F.count_if(lapse & (F.col("next_event_lapse") == "yes")),
        F.sum("days_since_qd"), F.sum("mins_since_prev_rep"),
    ).first()
    assert tuple(row) == (entries, accounts, lapses, again, days, gaps)


def test_cohort_totals_agree_with_counting(spark, sf):
    clean = inputs.clean(spark, sf)
    for fast, slow in [
        (plan.cohort(clean), cohort.min_entries(clean)),
        (plan.cohort(clean, 1, "mixed"), cohort.mixed_outcome_accounts(clean)),
        (plan.cohort(clean, 1, "any_lapse"), cohort.any_lapse_accounts(clean)),
        (plan.cohort(clean, 1, more_than=5), cohort.class_count_cutoff(clean)),
    ]:
        assert sorted(values(fast, ORDINAL)) == sorted(values(slow, ORDINAL))


def test_clean_columns(spark, sf):
    assert inputs.live(spark, sf).columns[1:44] == CLEAN_COLUMNS
    assert len(CLEAN_COLUMNS) == 43


def test_intake_runs_on_a_stream(spark, sf, tmp_path):
    raw = inputs.raw(spark, sf)
    raw.write.parquet(str(tmp_path / "raw"))
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "raw"))
    query = (
        plan.intake(stream, inputs.RULES).writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 513


def test_labels(spark):
    names = {
        "craving_feeling_down_true": ("Feeling down: true", "Feeling state"),
        "craving_env_alone_true": ("Alone: true", "Social context"),
        "craving_occupation_working_true": ("Activity working: true", "Activity"),
        "prior_event_lapse_yes": ("Prior event lapse: yes", "Temporal"),
        "time_of_day_night": ("Time of day: night", "Temporal"),
        "craving_severity": ("Craving severity", "Feeling state"),
    }
    df = spark.createDataFrame([(n,) for n in names], "v string")
    label = labels.clean_feature_label(F.col("v"))
    got = df.select("v", label.alias("l"), labels.feature_group(label).alias("g")).collect()
    assert {r["v"]: (r["l"], r["g"]) for r in got} == names
    forest = labels.clean_feature_label(F.lit("craving_occupation_working_true"), "rf")
    baseline = labels.clean_feature_label(F.lit("time_to_first_cig_X6_30"), "rf")
    row = spark.range(1).select(forest.alias("a"), baseline.alias("b")).first()
    assert tuple(row) == ("Activity: working", "Time to first cigarette: 6-30 minutes")
