"""Ordered work inside groups of any size: running totals, ranks and neighbours.

A window over one key sends each group to one task. Here a group with more than ``limit`` rows is
cut into parts that follow its order, the window runs inside (group, part), and small per-part
totals carry what lies before and after. Groups below the limit are one part, so ordinary data
pays one shuffle and one sort. Rows without a key are a group like any other.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

HOT_ROWS = 1_000_000
_WHOLE = -1  # part number of a group that is not cut


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``limit`` rows: at most rows / limit of them. Spark broadcasts them if they are few."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).select(*keys)


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null; the keys of ``left`` stay."""
    named = {k: f"_same_{k}" for k in keys}
    equal = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()])
    return left.join(right.withColumnsRenamed(named), equal, how).drop(*named.values())


def never_null(key: str) -> Column:
    """A text that tells keys apart, and null from all of them."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


def mark_parts(
    df: DataFrame, keys: Sequence[str], digits: Sequence[Column], hot: DataFrame | None
) -> tuple[DataFrame, list[str]]:
    """Add part columns ``_d0``, ``_d1``, ...: the digits in hot groups, one constant elsewhere."""
    names = [f"_d{i}" for i in range(len(digits))]
    if hot is None:  # the whole table is one group
        return df.withColumns(dict(zip(names, digits))), names
    flag = hot.withColumn("_hot", F.lit(True))
    out = join_same(df, flag, keys, "left")
    out = out.withColumns({
        n: F.when(F.col("_hot"), d).otherwise(F.lit(_WHOLE)) for n, d in zip(names, digits)
    })
    return out.drop("_hot"), names


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    digits: Sequence[Column],
    order: Sequence,
    values: dict[str, Column],
    limit: int = HOT_ROWS,
) -> DataFrame:
    """For each value add ``<name>_before`` (sum over earlier rows) and ``<name>_total``.

    ``digits`` are integers of 0 or more, most significant first, that never fall as ``order``
    rises, so rows of one part follow those of the part before. ``order`` must have no ties inside
    a group. With no ``keys`` the table is one group and is always cut.
    """
    given = df.columns
    # Keys that are never null, so that plain joins below use the windows' partitioning.
    plain = {f"_k{i}": never_null(k) for i, k in enumerate(keys)}
    df = df.withColumns({**plain, **{f"_v_{n}": v for n, v in values.items()}})
    keys = list(plain)
    hot = hot_keys(df, keys, limit) if keys else None
    rows, parts = mark_parts(df, keys, digits, hot)

    # Per-part totals of the hot groups, from the finest part up to the whole group.
    hot_rows = rows if hot is None else rows.filter(F.col(parts[0]) != _WHOLE)
    levels, table = [], hot_rows.select(*keys, *parts, *[f"_v_{n}" for n in values])
    for depth in range(len(parts), 0, -1):
        table = table.groupBy(*keys, *parts[:depth]).agg(
            *[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in values]
        )
        levels.insert(0, table)
    carry = None
    for depth, level in enumerate(levels):
        inside = Window.partitionBy(*keys, *parts[:depth]).orderBy(parts[depth])
        before = inside.rowsBetween(Window.unboundedPreceding, -1)
        out = [F.coalesce(F.sum(f"_v_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in values]
        if carry is None:
            whole = Window.partitionBy(*keys)
            out += [F.sum(f"_v_{n}").over(whole).alias(f"_t_{n}") for n in values]
            carry = level.select(*keys, parts[0], *out)
            continue
        step = level.select(*keys, *parts[: depth + 1], *out)
        upper = carry.withColumnsRenamed({f"_b_{n}": f"_u_{n}" for n in values})
        carry = step.join(upper, keys + parts[:depth]).select(
            *keys, *parts[: depth + 1],
            *[(F.col(f"_b_{n}") + F.col(f"_u_{n}")).alias(f"_b_{n}") for n in values],
            *[f"_t_{n}" for n in values],
        )

    # Windows inside (group, part), then the carried totals.
    inside = Window.partitionBy(*keys, *parts)
    before = inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_in_{n}": F.sum(f"_v_{n}").over(before) for n in values})
    if hot is not None:
        rows = rows.withColumns({f"_all_{n}": F.sum(f"_v_{n}").over(inside) for n in values})
    rows = rows.join(carry, keys + parts, "left" if hot is not None else "inner")
    result = {}
    for n in values:
        zero = F.lit(0)
        result[f"{n}_before"] = F.coalesce(F.col(f"_in_{n}"), zero) + F.coalesce(F.col(f"_b_{n}"), zero)
        total = F.col(f"_t_{n}")
        result[f"{n}_total"] = total if hot is None else F.coalesce(total, F.col(f"_all_{n}"))
    return rows.withColumns(result).select(*given, *result)


def number_digits(value: Column) -> list[Column]:
    """Digits of a finite double that never fall as it rises: exponent, then 16 + 16 bits."""
    size = F.abs(value.cast("double"))
    exponent = F.floor(F.log2(size))
    rest = size / F.pow(F.lit(2.0), exponent)  # about [1, 2)
    first = F.floor(rest * 65536)
    second = F.floor((rest * 65536 - first) * 65536)

    def signed(digit: Column, zero: int, top: int) -> Column:
        up = F.when(value > 0, digit + top).when(value < 0, F.lit(top) - digit)
        return up.otherwise(F.lit(zero)).cast("bigint")

    # 4096 keeps exponents positive on both sides of zero; 1 << 18 does so for the bits.
    return [
        F.when(value > 0, exponent + 12288).when(value < 0, F.lit(4096) - exponent)
        .otherwise(F.lit(8192)).cast("bigint"),
        signed(first, 0, 1 << 18),
        signed(second, 0, 1 << 18),
    ]


def split_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the groups that one task can hold, and rows of the hot ones."""
    return join_same(df, hot, keys, "left_anti"), join_same(df, hot, keys, "left_semi")


def neighbours(
    ordinary: DataFrame,
    hot_rows: DataFrame,
    keys: Sequence[str],
    order: str,
    digit: str,
    previous: dict[str, str],
    following: dict[str, str],
    counts: dict[str, Column],
    number: str,
) -> DataFrame:
    """Number the rows of each group and add neighbours' columns and group totals.

    ``previous`` and ``following`` map a new column to the column taken from the row before or
    after; ``counts`` maps a new column to a value summed over the group. ``order`` has no ties
    inside a group. The two inputs come from ``split_hot``; hot rows also have a column ``digit``
    that never falls as ``order`` rises and says which part a row belongs to.
    """
    keys = list(keys)

    def windows(rows: DataFrame, within: list[str]) -> DataFrame:
        inside = Window.partitionBy(*within)
        ordered = inside.orderBy(order)
        return rows.withColumns({
            number: F.row_number().over(ordered).cast("bigint"),
            **{n: F.lag(c).over(ordered) for n, c in previous.items()},
            **{n: F.lead(c).over(ordered) for n, c in following.items()},
            **{n: F.sum(v).over(inside) for n, v in counts.items()},
        })

    # Inside (group, part), marking the rows whose neighbour is in another part.
    cut = hot_rows.withColumn("_d0", F.col(digit)).drop(digit)
    ordered = Window.partitionBy(*keys, "_d0").orderBy(order)
    parts = windows(cut, keys + ["_d0"]).withColumn("_last", F.lead(F.lit(1)).over(ordered).isNull())

    # One row per part: its size, its sums, and its first and last row.
    edge = lambda names: F.struct(*[F.col(c).alias(f"e_{n}") for n, c in names.items()])
    edges = []
    if previous:
        edges.append(F.max_by(edge(previous), F.col(order)).alias("_before"))
    if following:
        edges.append(F.min_by(edge(following), F.col(order)).alias("_after"))
    per_part = cut.groupBy(*keys, "_d0").agg(
        F.count("*").alias("_n"), *[F.sum(v).alias(f"_s_{n}") for n, v in counts.items()], *edges
    )
    across = Window.partitionBy(*keys)
    along = across.orderBy("_d0")
    carry = per_part.select(
        *keys, "_d0",
        F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_n_before"),
        *([F.lag("_before").over(along).alias("_before")] if previous else []),
        *([F.lead("_after").over(along).alias("_after")] if following else []),
        *[F.sum(f"_s_{n}").over(across).alias(f"_s_{n}") for n in counts],
    )
    parts = join_same(parts, carry, keys + ["_d0"])
    first = F.col(number) == 1
    parts = parts.withColumns({
        **{n: F.when(first, F.col(f"_before.e_{n}")).otherwise(F.col(n)) for n in previous},
        **{n: F.when(F.col("_last"), F.col(f"_after.e_{n}")).otherwise(F.col(n)) for n in following},
        **{n: F.col(f"_s_{n}") for n in counts},
        number: F.col(number) + F.coalesce(F.col("_n_before"), F.lit(0)),
    })
    whole = windows(ordinary, keys)
    return whole.unionByName(parts.select(*whole.columns))
