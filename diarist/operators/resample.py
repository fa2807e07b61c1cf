"""Exact, reproducible resamples: rows are drawn in the order of a hash of their ordinal."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diarist.operators.hot import HOT_ROWS, running_total
from diarist.schema import KEY, ORDINAL, OUTCOME


def draw_key(seed, row: str = ORDINAL) -> Column:
    """Hash that orders rows at random: the same text in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(row).cast("string")))


def hex_digit(text: Column, start: int, size: int = 4) -> Column:
    return F.conv(F.substring(text, start, size), 16, 10).cast("bigint")


def draw_ranks(
    df: DataFrame, keys: Sequence[str] = (), seed=555, row: str = ORDINAL, limit: int = HOT_ROWS
) -> DataFrame:
    """Add ``draw_rank`` (1..n in draw order) and ``draw_n`` within each group, or the table."""
    df = df.withColumn("_draw", draw_key(seed, row))
    out = running_total(df, keys, [hex_digit(F.col("_draw"), 1)], ["_draw", row], {"_one": F.lit(1)}, limit)
    return out.withColumns({
        "draw_rank": F.col("_one_before") + 1, "draw_n": F.col("_one_total"),
    }).drop("_draw", "_one_before", "_one_total")


def train_test_split(
    df: DataFrame, prop: float = 0.8, keys: Sequence[str] = (), seed=555, row: str = ORDINAL
) -> DataFrame:
    """Add ``split``: the first floor(prop * n) rows in draw order are training.

    ``keys`` splits inside each account, or inside each account and outcome (stratified).
    """
    ranked = draw_ranks(df, keys, seed, row)
    training = F.col("draw_rank") <= F.floor(F.lit(float(prop)) * F.col("draw_n"))
    return ranked.withColumn("split", F.when(training, "training").otherwise("testing")).drop(
        "draw_rank", "draw_n"
    )


def kfold(df: DataFrame, v: int = 10, keys: Sequence[str] = (), seed=555, row: str = ORDINAL) -> DataFrame:
    """Add ``fold`` in 0..v-1; sizes differ by at most one row per group."""
    ranked = draw_ranks(df, keys, f"{seed}:fold", row)
    return ranked.withColumn("fold", ((F.col("draw_rank") - 1) % v).cast("int")).drop("draw_rank", "draw_n")


def downsample(
    df: DataFrame, keys: Sequence[str] = (), outcome: str = OUTCOME, seed=555, row: str = ORDINAL
) -> DataFrame:
    """Cut each class to the size of the smallest one."""
    keys = list(keys)
    ranked = draw_ranks(df, keys + [outcome], f"{seed}:down", row)
    sizes = df.groupBy(*keys, outcome).agg(F.count("*").alias("_n"))
    if keys:
        ranked = ranked.join(sizes.groupBy(*keys).agg(F.min("_n").alias("_least")), keys)
        ranked = ranked.filter(F.col("draw_rank") <= F.col("_least")).drop("_least")
    else:
        ranked = ranked.filter(F.col("draw_rank") <= sizes.agg(F.min("_n")).scalar())
    return ranked.drop("draw_rank", "draw_n")


def downsample_parts(
    df: DataFrame, folds: int, outcome: str = OUTCOME, seed=555, row: str = ORDINAL
) -> DataFrame:
    """Add ``parts``: the numbers of the parts in which ``downsample`` keeps the row, and drop rows that none keeps.

    Part f holds the rows of all folds but f; part ``folds`` holds all rows. Running totals rank the rows
    inside every part at once.
    """
    inside = [F.coalesce(F.col("fold") != f, F.lit(False)) for f in range(folds)] + [F.lit(True)]
    counts = {f"_in{f}": c.cast("int") for f, c in enumerate(inside)}
    drawn = df.withColumn("_draw", draw_key(f"{seed}:down", row))
    ranked = running_total(drawn, [outcome], [hex_digit(F.col("_draw"), 1)], ["_draw", row], counts)
    sizes = df.groupBy(outcome).agg(*[F.sum(c).alias(n) for n, c in counts.items()])
    least = sizes.agg(F.array(*[F.min(F.when(F.col(n) > 0, F.col(n))) for n in counts])).scalar()
    ranked = ranked.withColumn("_least", least)
    kept = [
        F.when(c & (F.col(f"_in{f}_before") < F.get("_least", F.lit(f))), F.lit(f)) for f, c in enumerate(inside)
    ]
    parts = F.array_compact(F.array(*kept))
    return ranked.select(*df.columns, parts.alias("parts")).filter(F.size("parts") > 0)


def upsample(
    df: DataFrame, keys: Sequence[str] = (), outcome: str = OUTCOME, seed=555, row: str = ORDINAL
) -> DataFrame:
    """Redraw each smaller class with replacement up to the size of the largest; adds ``draw``.

    The rows of the largest class number the draws, so nothing is generated on the driver.
    """
    keys = list(keys)
    ranked = draw_ranks(df, keys + [outcome], f"{seed}:up", row)
    # One entry per class: a short list beside each row, from the group or for the whole table.
    sizes = df.groupBy(*keys, F.col(outcome).alias("_class")).agg(F.count("*").alias("_n"))
    listed = F.sort_array(F.collect_list(F.struct("_class", "_n")))
    if keys:
        ranked = ranked.join(sizes.groupBy(*keys).agg(listed.alias("_classes")), keys)
    else:
        ranked = ranked.withColumn("_classes", sizes.agg(listed).scalar())
    most = F.array_max(F.transform("_classes", lambda c: c["_n"]))
    ranked = ranked.withColumn("_most", most)
    largest = F.filter("_classes", lambda c: c["_n"] == F.col("_most"))  # by name: the first draws
    smaller = F.filter("_classes", lambda c: c["_n"] < F.col("_most"))

    kept = ranked.filter(F.col("draw_n") == F.col("_most")).withColumn("draw", F.col("draw_rank"))
    draws = ranked.filter(F.col(outcome) == F.get(largest, F.lit(0))["_class"]).select(
        *keys, F.col("draw_rank").alias("draw"), F.explode(smaller).alias("c")
    )
    text = F.concat_ws(":", F.lit(f"{seed}:pick"), *keys, F.col("c._class"), F.col("draw").cast("string"))
    pick = (hex_digit(F.md5(text), 1, 12) % F.col("c._n") + 1).alias("draw_rank")
    picks = draws.select(*keys, F.col("c._class").alias(outcome), "draw", pick)
    redrawn = ranked.join(picks, keys + [outcome, "draw_rank"])
    columns = [*df.columns, "draw"]
    return kept.select(*columns).unionByName(redrawn.select(*columns))


def hybrid_split(
    df: DataFrame, fraction: float = 0.2, key: str = KEY, seed=555, row: str = ORDINAL
) -> DataFrame:
    """Add ``role``: round(fraction * n) rows of each account move to "training", when that account
    is the held-out one; the others stay "testing"."""
    ranked = draw_ranks(df, [key], f"{seed}:hybrid", row)
    moved = F.col("draw_rank") <= F.bround(F.lit(float(fraction)) * F.col("draw_n"))
    return ranked.withColumn("role", F.when(moved, "training").otherwise("testing")).drop(
        "draw_rank", "draw_n"
    )


def remove_sampled_rows(df: DataFrame, sampled: DataFrame, row: str = ORDINAL) -> DataFrame:
    """Rows of ``df`` that were not sampled."""
    return df.join(sampled.select(row), row, "left_anti")


def leave_one_account_out(df: DataFrame, holdout: Column, key: str = KEY) -> DataFrame:
    """Add ``role`` for one held-out account (or group of accounts): its rows are "testing"."""
    return df.withColumn("role", F.when(holdout, "testing").otherwise("training"))


def holdout_sizes(df: DataFrame, key: str = KEY) -> DataFrame:
    """Training and testing rows of every leave-one-account-out split, without building them."""
    per_account = df.groupBy(key).agg(F.count("*").alias("testing"))
    total = df.agg(F.count("*")).scalar()
    return per_account.withColumn("training", total - F.col("testing"))


def holdout_groups(df: DataFrame, groups: int, key: str = KEY, seed=555) -> DataFrame:
    """Add ``holdout`` in 0..groups-1, one number per account, accounts spread evenly.

    With as many groups as accounts this is leave-one-account-out.
    """
    accounts = df.select(key).distinct()
    ranked = draw_ranks(accounts, (), f"{seed}:holdout", key)
    number = ((F.col("draw_rank") - 1) % groups).cast("int").alias("holdout")
    return df.join(ranked.select(key, number), key)
