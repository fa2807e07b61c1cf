"""Rounding of query results, so that engines that add in another order agree. Operators don't round."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded half to even."""
    return df.withColumns({c: F.bround(c, digits) for c, t in df.dtypes if t == "double"})
