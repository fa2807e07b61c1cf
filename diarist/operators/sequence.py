"""Per-account sequence features of a de-duplicated diary."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diarist.functions.times import time_diff
from diarist.operators.filters import first_per_group
from diarist.operators.hot import HOT_ROWS, hot_keys, join_same, neighbours, split_hot
from diarist.schema import KEY, ORDINAL, OUTCOME, TIME

SLOT_SECONDS = 3600  # a hot account is cut into one part per hour, and a hot hour into one per second


def time_slot(time: str = TIME, seconds: int = SLOT_SECONDS) -> Column:
    """Slot of a time, as the second it begins with."""
    start = F.lit("1900-01-01 00:00:00").cast("timestamp_ntz")
    return (F.floor(F.timestamp_diff("SECOND", start, F.col(time)) / seconds) * seconds).cast("bigint")


def with_slots(rows: DataFrame, key: str, time: str, limit: int) -> DataFrame:
    """Rows of hot accounts with ``_slot``: the hour, or the second where an hour has over ``limit`` rows."""
    hourly = rows.withColumn("_slot", time_slot(time))
    busy = hourly.groupBy(key, "_slot").agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
    busy = busy.select(key, "_slot", F.lit(True).alias("_busy"))
    slot = F.when(F.col("_busy"), time_slot(time, 1)).otherwise(F.col("_slot"))
    return join_same(hourly, busy, [key, "_slot"], "left").withColumn("_slot", slot).drop("_busy")


def sequence_features(
    df: DataFrame,
    hot_rows: DataFrame | None = None,
    limit: int = HOT_ROWS,
    key: str = KEY,
    time: str = TIME,
    outcome: str = OUTCOME,
    positive: str = "true",
) -> DataFrame:
    """Add ``event_nr``, ``prior_event_lapse``, ``mins_since_prev_rep``, ``next_event_lapse`` and
    the account totals ``n_entries`` and ``n_lapses``, in one pass over the accounts.

    Hot accounts are found here, unless their entries come apart as ``hot_rows``.
    """
    if hot_rows is None:
        df, hot_rows = split_hot(df, [key], hot_keys(df, [key], limit))
    out = neighbours(
        df, with_slots(hot_rows, key, time, limit), [key], time, "_slot",
        previous={"_prev_time": time, "_prev_outcome": outcome},
        following={"_next_outcome": outcome},
        counts={"n_entries": F.lit(1), "n_lapses": F.when(F.col(outcome) == positive, 1).otherwise(0)},
        number="event_nr",
    )
    after_lapse = (F.col(time) > F.col("_prev_time")) & (F.col("_prev_outcome") == positive)
    return out.withColumns({
        "prior_event_lapse": F.when(after_lapse, "yes").otherwise("no"),
        "mins_since_prev_rep": F.bround(time_diff(F.col(time), F.col("_prev_time"), "mins")),
        "next_event_lapse": F.when(F.col("_next_outcome") == positive, "yes").otherwise("no"),
    }).drop("_prev_time", "_prev_outcome", "_next_outcome")


def first_entry(df: DataFrame, key: str = KEY, order: str = TIME) -> DataFrame:
    """Each account's first entry."""
    return first_per_group(df, [key], [order, ORDINAL])


def last_entry(df: DataFrame, key: str = KEY, order: str = TIME) -> DataFrame:
    """Each account's last entry."""
    return first_per_group(df, [key], [F.col(order).desc(), F.col(ORDINAL).desc()])


def account_shares(df: DataFrame, key: str = KEY, outcome: str = OUTCOME) -> DataFrame:
    """Put each account's entry count and outcome shares on every row.

    The counts are aggregated first and joined back, so a hot account is split by the join and
    never gathered.
    """
    counts = df.groupBy(key).agg(
        F.count("*").alias("n_entries"),
        F.count_if(F.col(outcome) == "true").alias("_true"),
        F.count_if(F.col(outcome) == "false").alias("_false"),
    )
    shares = counts.select(
        key, "n_entries",
        F.try_divide("_true", "n_entries").alias("prop_lapses"),
        F.try_divide("_false", "n_entries").alias("prop_non_lapses"),
    )
    return df.join(shares, key, "left")
