"""Projections, row filters and include/exclude flags."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from diarist.functions.times import time_diff
from diarist.schema import KEY, ORDINAL, TIME


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns in order; an absent one is an error."""
    require(df, columns)
    return df.select(*columns)


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")


def drop_columns(df: DataFrame, columns: Sequence[str], strict: bool = True) -> DataFrame:
    """Drop columns; ``strict`` makes an absent one an error."""
    if strict:
        require(df, columns)
    return df.drop(*columns)


def eligible_entries(
    df: DataFrame,
    max_cigs: int = 100,
    filled: Sequence[str] = ("time_to_first_cig", "craving_did_smoke", "craving_record_created"),
) -> DataFrame:
    """Entries with a plausible baseline count and no blank in ``filled``."""
    return df.filter(is_eligible(df, max_cigs, filled))


def is_eligible(
    df: DataFrame,
    max_cigs: int = 100,
    filled: Sequence[str] = ("time_to_first_cig", "craving_did_smoke", "craving_record_created"),
) -> Column:
    keep = F.col("cigs_per_day") <= max_cigs
    for name in filled:
        c = F.col(name)
        keep = keep & ((c != "") if df.schema[name].dataType.typeName() == "string" else c.isNotNull())
    return keep


def in_study(
    quit_from: str, quit_before: str, entry_from: str,
    quit: str = "adjusted_quit_date", time: str = TIME,
) -> Column:
    """Start date in [quit_from, quit_before) and an entry from ``entry_from`` on."""
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    return (
        (F.col(quit) >= at(quit_from)) & (F.col(quit) < at(quit_before))
        & (F.col(time) >= at(entry_from))
    )


def study_window(
    df: DataFrame,
    quit_from: str = "2020-01-01 00:00:00",
    quit_before: str = "2021-03-18 00:00:00",
    entry_from: str = "2020-01-01 00:00:00",
) -> DataFrame:
    return df.filter(in_study(quit_from, quit_before, entry_from))


def range_flag(value: Column, low: float, high: float) -> Column:
    """"exclude" outside the closed range; null counts as inside."""
    return F.when((value > high) | (value < low), "exclude").otherwise("include")


def relative_flag(max_weeks: float = 12, time: str = TIME, quit: str = "adjusted_quit_date") -> Column:
    """Flag by the weeks between the start date and the entry."""
    return range_flag(time_diff(F.col(time), F.col(quit), "weeks"), 0, max_weeks)


def recall_flag(max_hours: float = 24, time: str = TIME, about: str = "adjusted_craving_date") -> Column:
    """Flag by the hours between the moment an entry describes and its writing, to 2 digits."""
    return range_flag(F.bround(time_diff(F.col(time), F.col(about), "hours"), 2), 0, max_hours)


def relative_window(df: DataFrame, max_weeks: float = 12) -> DataFrame:
    return df.filter(relative_flag(max_weeks) == "include")


def recall_window(df: DataFrame, max_hours: float = 24) -> DataFrame:
    return df.filter(recall_flag(max_hours) == "include")


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of every group.

    Spark limits each map task to one row per group before the shuffle (``WindowGroupLimit``), so
    a group holding a large part of the table reaches the reducer as one row per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def dedup_entries(df: DataFrame, keys: Sequence[str] = (KEY, TIME), order: str = ORDINAL) -> DataFrame:
    """One entry per account and time: the first in input order, with all its columns."""
    return first_per_group(df, keys, [order])


def impute_zero(df: DataFrame, columns: Sequence[str] = ("mins_since_prev_rep",)) -> DataFrame:
    return df.fillna({c: 0 for c in columns})


def drop_null_keys(df: DataFrame, keys: Sequence[str] = (KEY,)) -> DataFrame:
    return df.na.drop(subset=list(keys))


def rename_cols(df: DataFrame, names: dict[str, str]) -> DataFrame:
    require(df, list(names))
    return df.withColumnsRenamed(names)


def keep_metrics(df: DataFrame, pattern: str = "roc_auc|accuracy", metric: str = "metric") -> DataFrame:
    return df.filter(F.col(metric).rlike(pattern))


def tag(df: DataFrame, name: str, value: str) -> DataFrame:
    """A constant column naming the source of the rows."""
    return df.withColumn(name, F.lit(value))
