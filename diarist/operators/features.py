"""Feature columns for models."""

import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diarist.schema import FLAGS, LEVELS

NUMERIC = ["cigs_per_day", "craving_severity", "days_since_qd", "mins_since_prev_rep"]
NOMINAL = ["prior_event_lapse"] + FLAGS + ["time_to_first_cig", "wkday_craving", "time_of_day"]
# Account-level and time columns that individual models leave out.
INDIVIDUAL_DROPS = ["cigs_per_day", "time_to_first_cig", "days_since_qd", "mins_since_prev_rep"]


def dummy_name(column: str, nr: int, level: str) -> str:
    if column == "wkday_craving":
        return f"{column}_{nr}"  # 1 = Mon ... 6 = Sat, base Sun
    if column == "time_to_first_cig":
        return f"{column}_X{re.sub('[^0-9]+', '_', level)}"
    return f"{column}_{level}"


def dummies(columns: Sequence[str]) -> dict[str, Column]:
    """An indicator for each declared level but the first, named after it."""
    return {
        dummy_name(c, nr, level): F.when(F.col(c) == level, 1.0).otherwise(0.0)
        for c in columns
        for nr, level in enumerate(LEVELS[c])
        if nr > 0
    }


def contrast_matrix(k: int) -> np.ndarray:
    """Orthonormal polynomial contrasts of ``k`` ordered levels: one row per level."""
    steps = np.arange(k) - (k - 1) / 2
    q, r = np.linalg.qr(np.vander(steps, k, increasing=True))
    return (q * np.sign(np.diag(r)))[:, 1:]


def poly_contrast(column: str) -> dict[str, Column]:
    """Polynomial contrast columns of an ordered category, named by degree."""
    levels = LEVELS[column]
    matrix = contrast_matrix(len(levels))
    out = {}
    for degree in range(matrix.shape[1]):
        value = F
        for level, x in zip(levels, matrix[:, degree]):
            value = value.when(F.col(column) == level, F.lit(float(x)))
        out[f"{column}_{degree + 1}"] = value.otherwise(F.lit(None))
    return out


def dummy_encode(df: DataFrame, columns: Sequence[str], contrast: Sequence[str] = ()) -> DataFrame:
    """Replace nominal columns by indicators; those in ``contrast`` by polynomial contrasts."""
    out = dummies([c for c in columns if c not in contrast])
    for c in contrast:
        out |= poly_contrast(c)
    return df.withColumns(out).drop(*columns)


def normalize(df: DataFrame, columns: Sequence[str], training: DataFrame | None = None) -> DataFrame:
    """(x - mean) / sd with the statistics of ``training`` rows, computed in one aggregate."""
    source = df if training is None else training
    stats = source.agg(F.struct(*[
        f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_samp))
    ])).scalar()
    return df.withColumns({
        c: F.try_divide(F.col(c) - stats[f"mean_{c}"], stats[f"sd_{c}"]) for c in columns
    })


def zero_variance(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, variable, constant) per column: whether it has one value only in the group."""
    wide = df.groupBy(*keys).agg(*[(F.min(c) == F.max(c)).alias(c) for c in columns])
    return wide.unpivot(list(keys), list(columns), "variable", "constant")


def drop_zero_variance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop the constant columns. The one-row check runs now, since it decides the schema."""
    flags = df.agg(*[(F.min(c) == F.max(c)).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if flags[c] is not False])
