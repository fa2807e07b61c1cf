"""Raw diary to clean diary, and the attrition report beside it."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diarist.functions.times import apply_offset, days_since, time_of_day, weekday_label
from diarist.operators import filters
from diarist.operators.hot import HOT_ROWS, hot_keys, split_hot
from diarist.operators.sequence import sequence_features
from diarist.schema import CLEAN_COLUMNS, KEY, ORDINAL, TIME
from diarist.sources.tables import parse_times


@dataclass(frozen=True)
class Rules:
    """Thresholds of the cleaning; the defaults are the study's."""

    max_cigs: int = 100
    quit_from: str = "2020-01-01 00:00:00"
    quit_before: str = "2021-03-18 00:00:00"
    entry_from: str = "2020-01-01 00:00:00"
    max_weeks: float = 12
    max_hours: float = 24
    hot_rows: int = HOT_ROWS


def adjusted_times(df: DataFrame) -> DataFrame:
    """Add the three times moved to local time."""
    offset = F.col("timezone_offset")
    return parse_times(df).withColumns({
        "adjusted_quit_date": apply_offset(F.col("quit_date"), offset),
        "adjusted_craving_record_created": apply_offset(F.col("craving_record_created"), offset),
        "adjusted_craving_date": apply_offset(F.col("craving_date"), offset),
    })


def intake(raw: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """All row-by-row rules. Stateless, so it also runs on a streaming DataFrame."""
    df = adjusted_times(filters.eligible_entries(raw, rules.max_cigs))
    df = filters.study_window(df, rules.quit_from, rules.quit_before, rules.entry_from)
    df = filters.relative_window(df, rules.max_weeks)
    return filters.recall_window(df, rules.max_hours)


def calendar_fields(df: DataFrame, time: str = TIME) -> DataFrame:
    return df.withColumns({
        "wkday_craving": weekday_label(F.col(time)),
        "time_of_day": time_of_day(F.col(time)),
    })


def clean_diary(raw: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The clean diary with ``entry_ordinal``, ``next_event_lapse``, ``n_entries``, ``n_lapses``.

    Entries of an account that one task can hold are shuffled once, by account, for duplicates
    and sequence features alike. Hot accounts go apart: there duplicates are cut in the map tasks,
    and the sequence runs over parts of the account. They are found by counting raw entries,
    which reads one column and can only count more.
    """
    hot = hot_keys(raw, [KEY], rules.hot_rows)
    ordinary, large = split_hot(intake(raw, rules), [KEY], hot)
    df = sequence_features(
        filters.dedup_entries(ordinary.repartition(KEY)), filters.dedup_entries(large), rules.hot_rows
    )
    df = calendar_fields(df).withColumn(
        "days_since_qd", days_since(F.col(TIME), F.col("adjusted_quit_date"))
    )
    extras = ["next_event_lapse", "n_entries", "n_lapses"]
    return filters.project(df, [ORDINAL] + CLEAN_COLUMNS + extras)


def cohort(
    clean: DataFrame,
    at_least: int = 20,
    outcomes: str = "all",
    more_than: int | None = None,
) -> DataFrame:
    """Accounts with enough entries, by the totals ``clean_diary`` put on each row: no shuffle.

    ``outcomes``: "all", "any_lapse" or "mixed"; ``more_than``: that many lapses and non-lapses.
    """
    n, lapses = F.col("n_entries"), F.col("n_lapses")
    keep = n >= at_least
    if outcomes == "any_lapse":
        keep = keep & (lapses > 0)
    elif outcomes == "mixed":
        keep = keep & (lapses > 0) & (lapses < n)
    if more_than is not None:
        keep = keep & (lapses > more_than) & (n - lapses > more_than)
    return clean.filter(keep)


STAGES = ["raw", "eligible", "study_window", "relative_window", "recall_window", "dedup"]


def account_stages(raw: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per account, the entries left after each stage, from one pass over the raw diary.

    Rows are first counted per (account, depth, time of a kept row) in the map tasks, so neither
    a hot account nor a hot duplicate is gathered.
    """
    df = adjusted_times(raw)
    passed = [
        filters.is_eligible(df, rules.max_cigs),
        filters.in_study(rules.quit_from, rules.quit_before, rules.entry_from),
        filters.relative_flag(rules.max_weeks) == "include",
        filters.recall_flag(rules.max_hours) == "include",
    ]
    depth, so_far = F.lit(0), F.lit(True)
    for condition in passed:
        so_far = so_far & F.coalesce(condition, F.lit(False))
        depth = depth + so_far.cast("int")
    marked = df.select(KEY, TIME, depth.alias("depth"))
    groups = marked.groupBy(
        KEY, "depth", F.when(F.col("depth") == len(passed), F.col(TIME)).alias("kept")
    ).agg(F.count("*").alias("n"))
    reached = lambda d: F.sum(F.when(F.col("depth") >= d, F.col("n")).otherwise(0))
    unique = F.count_if(F.col("depth") == len(passed))
    return groups.groupBy(KEY).agg(
        *[reached(i).alias(s) for i, s in enumerate(STAGES[:-1])], unique.alias(STAGES[-1])
    )


def attrition(raw: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Entries and accounts left after each stage, and accounts lost since the stage before."""
    totals = account_stages(raw, rules).agg(
        *[F.sum(s).alias(f"entries_{s}") for s in STAGES],
        *[F.count_if(F.col(s) > 0).alias(f"accounts_{s}") for s in STAGES],
    )
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(i).alias("stage_nr"), F.lit(s).alias("stage"),
            F.coalesce(f"entries_{s}", F.lit(0)).alias("entries"),
            F.col(f"accounts_{s}").alias("accounts"),
            (F.col(f"accounts_{STAGES[max(i - 1, 0)]}") - F.col(f"accounts_{s}")).alias("accounts_lost"),
        )
        for i, s in enumerate(STAGES)
    ]))
    return totals.select(rows.alias("r")).select("r.*")


def coverage_thresholds(
    raw: DataFrame, rules: Rules = Rules(), thresholds=(1, 5, 10, 20, 30, 50)
) -> DataFrame:
    """Accounts with at least so many entries before and after duplicates go, and their share of
    all accounts in the raw diary."""
    at = lambda stage: [F.count_if(F.col(stage) >= k).alias(f"{stage}_{k}") for k in thresholds]
    totals = account_stages(raw, rules).agg(F.count("*").alias("all"), *at("recall_window"), *at("dedup"))
    share = lambda c: F.try_divide(F.col(c) * 100, "all")
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(k).alias("at_least"),
            F.col(f"recall_window_{k}").alias("accounts_before"),
            share(f"recall_window_{k}").alias("percent_before"),
            F.col(f"dedup_{k}").alias("accounts_after"),
            share(f"dedup_{k}").alias("percent_after"),
        )
        for k in thresholds
    ]))
    return totals.select(rows.alias("r")).select("r.*")
