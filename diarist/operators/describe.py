"""Counts, shares, quantiles, histograms and rates of a cohort."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from diarist.functions.labels import name_suffix, sentence_case
from diarist.operators.hot import HOT_ROWS, number_digits, running_total
from diarist.operators.sequence import last_entry
from diarist.schema import KEY, LEVELS, OUTCOME, TIME


def ratio(part, whole, digits: int | None = None) -> Column:
    """Quotient; null where ``whole`` is 0. ``digits`` rounds it half to even, as some reports do."""
    quotient = F.try_divide(part, whole)
    return quotient if digits is None else F.bround(quotient, digits)


def share_of_total(counts: DataFrame, n: str = "n", share: str = "prop") -> DataFrame:
    """Each row's share of the sum. ``counts`` is an aggregate with one row per level."""
    return counts.withColumn(share, ratio(F.col(n), F.sum(n).over(Window.partitionBy())))


def entries_per_account(df: DataFrame, key: str = KEY) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("count"))


def tabulate_one(df: DataFrame, column: str) -> DataFrame:
    """Level, n, percent."""
    return share_of_total(df.groupBy(column).agg(F.count("*").alias("n")), share="percent")


def tabulate_two(df: DataFrame, rows: str, column: str, levels: Sequence[str]) -> DataFrame:
    """Counts of each level of ``column`` per value of ``rows``; absent pairs are 0."""
    return df.groupBy(rows).agg(*[F.count_if(F.col(column) == v).alias(v) for v in levels])


def flag_tabulation(df: DataFrame, flag: Column, key: str = KEY) -> DataFrame:
    """Rows per flag value, per account and (with a null account) overall."""
    per_account = df.groupBy(key, flag.alias("flag")).agg(F.count("*").alias("n"))
    return per_account.groupingSets([[F.col(key), F.col("flag")], [F.col("flag")]], key, "flag").agg(
        F.sum("n").alias("n")
    )


def mean_sd(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"))


def quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    keys: Sequence[str] = (),
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Exact quantiles with linear interpolation, named by ``probs``; nulls are skipped.

    Rows become counts per distinct value before anything is ordered, and the ordering itself is
    a running total that cuts large groups, so no group is held in one task.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_x")).agg(
        F.count("*").alias("_n")
    )
    ranked = running_total(counts, keys, number_digits(F.col("_x")), ["_x"], {"_r": F.col("_n")}, limit)

    def at(position: Column) -> Column:
        here = (F.col("_r_before") <= position) & (position < F.col("_r_before") + F.col("_n"))
        return F.max(F.when(here, F.col("_x").cast("double")))

    parts, result = [], []
    for name, p in probs.items():
        position = (F.col("_r_total") - 1) * F.lit(float(p))
        low, high = F.floor(position), F.ceil(position)
        parts += [
            at(low).alias(f"{name}_low"), at(high).alias(f"{name}_high"),
            F.max(position - low).alias(f"{name}_step"),
        ]
        low, high, step = (F.col(f"{name}_{x}") for x in ("low", "high", "step"))
        result.append((low + (high - low) * step).alias(name))
    return ranked.groupBy(*keys).agg(*parts).select(*keys, *result)


def median_range(df: DataFrame, column: str) -> DataFrame:
    """Median, minimum, maximum of a column; null without values."""
    kind = df.schema[column].dataType
    found = quantiles(df, column, {"min": 0, "median": 0.5, "max": 1})
    return found.select("median", F.col("min").cast(kind).alias("min"), F.col("max").cast(kind).alias("max"))


def account_baselines(df: DataFrame, key: str = KEY, time: str = TIME) -> DataFrame:
    """Entries per account, and what its first entry says of the time before quitting."""
    return df.groupBy(key).agg(
        F.count("*").alias("n"),
        F.min_by("cigs_per_day", time).alias("cigs_per_day"),
        F.min_by("time_to_first_cig", time).alias("time_to_first_cig"),
    )


def by_sample(baselines: DataFrame, at_least: Sequence[int] = (1, 10, 20)) -> DataFrame:
    """Accounts once for each sample they belong to, named by its least number of entries."""
    sizes = F.explode(F.array(*[F.lit(n) for n in at_least])).alias("at_least")
    return baselines.select("*", sizes).filter(F.col("n") >= F.col("at_least"))


def sample_characteristics(baselines: DataFrame) -> DataFrame:
    """Accounts, entries per account and cigarettes per day of each sample.

    The entry counts have few distinct values (their sum is the number of entries), so the exact
    median stays small.
    """
    return by_sample(baselines).groupBy("at_least").agg(
        F.count("*").alias("accounts"), F.sum("n").alias("entries"),
        F.median("n").alias("median_entries"),
        F.min("n").alias("min_entries"), F.max("n").alias("max_entries"),
        F.avg("cigs_per_day").alias("mean_cigs"), F.stddev_samp("cigs_per_day").alias("sd_cigs"),
    )


def sample_levels(baselines: DataFrame, column: str = "time_to_first_cig") -> DataFrame:
    """Level, n and share of a baseline category within each sample."""
    counts = by_sample(baselines).groupBy("at_least", column).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("at_least"))  # one row per level
    return counts.withColumn("percent", ratio(F.col("n"), total))


def outcome_counts_wide(df: DataFrame, key: str = KEY, outcome: str = OUTCOME) -> DataFrame:
    """Non-lapses and lapses per account; null where an account has none."""
    seen = tabulate_two(df, key, outcome, LEVELS[OUTCOME])
    return seen.select(key, *[F.nullif(v, F.lit(0)).alias(f"n_{v}") for v in LEVELS[OUTCOME]])


def outcome_share(df: DataFrame, outcome: str = OUTCOME) -> DataFrame:
    """Outcome, n and share of all entries."""
    return share_of_total(df.groupBy(outcome).agg(F.count("*").alias("n")))


def lapse_share_per_account(df: DataFrame, key: str = KEY, outcome: str = OUTCOME) -> DataFrame:
    """Lapses over all entries per account, to 2 digits."""
    counts = tabulate_two(df, key, outcome, LEVELS[OUTCOME])
    true, false = F.col("true"), F.col("false")
    return counts.select(key, "false", "true", ratio(true, false + true, 2).alias("prop"))


def lapse_share_summary(shares: DataFrame) -> DataFrame:
    """Percentage of accounts without, with only, and with more than .7, .6, .5 lapses."""
    prop = F.col("prop")
    tests = {
        "none": prop == 0, "all": prop == 1,
        "over_70": prop > 0.7, "over_60": prop > 0.6, "over_50": prop > 0.5,
    }
    return shares.agg(
        F.count("*").alias("accounts"),
        *[ratio(F.count_if(c) * 100, F.count("*")).alias(f"percent_{n}") for n, c in tests.items()],
    )


def max_days_since_quit(df: DataFrame, key: str = KEY) -> DataFrame:
    return df.groupBy(key).agg(F.max("days_since_qd").alias("days"))


def median_gap(df: DataFrame, key: str = KEY) -> DataFrame:
    """Median minutes since the previous entry per account, 0 for its first one."""
    gaps = df.select(key, F.coalesce(F.col("mins_since_prev_rep"), F.lit(0.0)).alias("mins"))
    return quantiles(gaps, "mins", {"mins": 0.5}, [key])


def last_outcome(df: DataFrame, outcome: str = OUTCOME) -> DataFrame:
    """Outcome of each account's last entry, tabulated."""
    return tabulate_one(last_entry(df), outcome)


def relapse_transition(df: DataFrame, outcome: str = OUTCOME) -> DataFrame:
    """Lapses, and how many of them are followed by a lapse."""
    lapse = F.col(outcome) == "true"
    again = F.count_if(lapse & (F.col("next_event_lapse") == "yes"))
    return df.agg(
        F.count_if(lapse).alias("lapses"), again.alias("followed_by_lapse"),
        ratio(again * 100, F.count_if(lapse)).alias("percent"),
    )


def endorsement_rates(df: DataFrame, predictors: Sequence[str], outcome: str = OUTCOME) -> DataFrame:
    """Per predictor and outcome, the share of each declared level, with axis and legend labels.

    One conditional count per predictor and level keeps the pass at one row per entry; unpivoting
    the entries would multiply them by the number of predictors.
    """
    cells = [(p, level) for p in predictors for level in LEVELS[p]]
    wide = df.groupBy(outcome).agg(
        F.count("*").alias("_all"),
        *[F.count_if(F.col(p) == level).alias(f"_c{i}") for i, (p, level) in enumerate(cells)],
    )
    rows = F.explode(F.array(*[
        F.struct(F.lit(p).alias("predictor"), F.lit(level).alias("level"), F.col(f"_c{i}").alias("n"))
        for i, (p, level) in enumerate(cells)
    ]))
    long = wide.select(outcome, "_all", rows.alias("r")).select(outcome, "_all", "r.*").filter("n > 0")
    shown = Window.partitionBy("predictor", outcome)
    return long.select(
        "predictor", name_suffix(F.col("predictor")).alias("legend"), outcome,
        count_label(F.col(outcome), F.col("_all")).alias("outcome_label"),
        "level", "n", ratio(F.col("n"), F.sum("n").over(shown)).alias("prop"),
    )


def count_label(level: Column, n: Column) -> Column:
    return F.concat(sentence_case(level), F.lit("\n(N="), n.cast("string"), F.lit(")"))


def histogram(
    df: DataFrame,
    value: str,
    bins: int = 30,
    by: Sequence[str] = (),
    limits: tuple[float, float] | None = None,
) -> DataFrame:
    """Equal-width bin counts, empty bins included, over the common range of all groups.

    Bin centres lie on multiples of the width (range / (bins - 1)); bins are closed on the right.
    """
    by = list(by)
    known = df.filter(F.col(value).isNotNull())
    if limits is not None:
        known = known.filter(F.col(value).between(*limits))
        low, high = (F.lit(float(x)) for x in limits)
    else:
        ends = known.agg(
            F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
        ).scalar()
        low, high = ends["lo"], ends["hi"]
    width = F.when(high > low, (high - low) / (bins - 1)).otherwise(F.lit(0.1))
    known = known.select(*by, F.col(value).cast("double").alias("_x"), width.alias("_w"), low.alias("_lo"))
    origin = F.col("_w") / 2 + F.floor((F.col("_lo") - F.col("_w") / 2) / F.col("_w")) * F.col("_w")
    bin_nr = F.greatest(F.ceil((F.col("_x") - origin) / F.col("_w") - 1e-8), F.lit(1)).cast("int")
    counts = known.groupBy(*by, bin_nr.alias("bin_nr"), F.col("_w"), origin.alias("_o")).agg(
        F.count("*").alias("count")
    )
    # Fill the empty bins from the counts themselves: at most ``bins`` rows per group.
    filled = counts.groupBy(*by, "_w", "_o").agg(
        F.map_from_entries(F.collect_list(F.struct("bin_nr", "count"))).alias("_counts")
    ).select(*by, "_w", "_o", "_counts", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin_nr"))
    return filled.select(
        *by, "bin_nr",
        (F.col("_o") + (F.col("bin_nr") - 1) * F.col("_w")).alias("x_min"),
        (F.col("_o") + F.col("bin_nr") * F.col("_w")).alias("x_max"),
        F.coalesce(F.try_element_at("_counts", F.col("bin_nr")), F.lit(0)).alias("count"),
    )


def box_stats(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Quartiles, and whiskers at the last values within 1.5 interquartile ranges of the box."""
    keys = list(keys)
    box = quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, keys)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    x = F.col(value)
    inside = (x >= F.col("q1") - reach) & (x <= F.col("q3") + reach)
    rows = df.filter(x.isNotNull()).join(box, keys)
    return rows.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )
