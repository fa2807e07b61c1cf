"""Cohorts: whole accounts kept or dropped by their entry and outcome counts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diarist.schema import KEY, OUTCOME


def restrict_to_accounts(df: DataFrame, accounts: DataFrame, key: str = KEY) -> DataFrame:
    """Rows whose account occurs in ``accounts``."""
    return df.join(accounts.select(key), key, "left_semi")


def account_counts(df: DataFrame, key: str = KEY, outcome: str = OUTCOME) -> DataFrame:
    """Entries, lapses and non-lapses per account."""
    return df.groupBy(key).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(outcome) == "true").alias("n_true"),
        F.count_if(F.col(outcome) == "false").alias("n_false"),
    )


def keep_accounts(df: DataFrame, condition: Column, key: str = KEY) -> DataFrame:
    """Rows of the accounts whose counts ``n``, ``n_true``, ``n_false`` meet ``condition``."""
    return restrict_to_accounts(df, account_counts(df, key).filter(condition), key)


def min_entries(df: DataFrame, n: int = 20) -> DataFrame:
    return keep_accounts(df, F.col("n") >= n)


def mixed_outcome_accounts(df: DataFrame) -> DataFrame:
    return keep_accounts(df, (F.col("n_true") > 0) & (F.col("n_false") > 0))


def any_lapse_accounts(df: DataFrame) -> DataFrame:
    return keep_accounts(df, F.col("n_true") > 0)


def class_cutoff(more_than: int = 5, which: str = "both") -> Column:
    """Condition: more than ``more_than`` lapses ("true"), non-lapses ("false") or both."""
    lapses, others = F.col("n_true") > more_than, F.col("n_false") > more_than
    return {"true": lapses, "false": others, "both": lapses & others}[which]


def class_count_cutoff(df: DataFrame, more_than: int = 5, which: str = "both") -> DataFrame:
    return keep_accounts(df, class_cutoff(more_than, which))
