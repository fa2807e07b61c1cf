"""Readers and writers."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from diarist.functions.times import parse_time
from diarist.operators.filters import require
from diarist.schema import KEY, ORDINAL, OUTCOME, RAW_COLUMNS, RAW_INTS, RAW_TIMES, TIME


def scan_diary(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Read a raw diary. CSV text has a header, ``NA`` for missing numbers, and text times.

    Columns are taken by name and further ones ignored. A diary without ordinals gets them as it is
    read, distinct and rising along each file, without a sort.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("nullValue", "NA")
    df = reader.load(path)
    ordinal = F.col(ORDINAL).cast("bigint") if ORDINAL in df.columns else F.monotonically_increasing_id()
    columns = [F.col(c).cast("int").alias(c) if c in RAW_INTS else F.col(c) for c in RAW_COLUMNS]
    return df.select(ordinal.alias(ORDINAL), *columns)


def parse_times(df: DataFrame, columns=tuple(RAW_TIMES)) -> DataFrame:
    """Text times to timestamps; columns that are timestamps already stay as they are."""
    require(df, columns)
    text = [c for c in columns if df.schema[c].dataType.typeName() == "string"]
    return df.withColumns({c: parse_time(F.col(c)) for c in text}) if text else df


def write_table(df: DataFrame, path: str, partition_by=(), mode: str = "overwrite") -> None:
    """Write Parquet, for instance results partitioned by ``model`` or ``analysis``."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_if_absent(df: DataFrame, path: str) -> None:
    """Write the table behind a figure unless it is there already."""
    df.write.mode("ignore").parquet(path)


def write_clean(df: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Save the clean diary bucketed by account, so later grouping by account needs no shuffle.

    ``path`` is the folder of the table, if it is not to lie in the warehouse.

    Choose ``buckets`` so that one bucket is about 1 GB; accounts too large for that belong in a
    plain ``write_table``.
    """
    writer = df.write.mode("overwrite").bucketBy(buckets, "account_id").sortBy("account_id")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def numbered_entries(clean: DataFrame) -> DataFrame:
    """Number of each entry within its account, and the account's size and lapses, joined by account.

    Over a table that ``write_clean`` saved, neither the window nor the totals nor the join shuffle.
    """
    by = Window.partitionBy(KEY)
    totals = clean.groupBy(KEY).agg(F.count("*").alias("entries"), F.count_if(F.col(OUTCOME) == "true").alias("lapses"))
    rows = clean.select(ORDINAL, KEY, TIME).withColumn("number", F.row_number().over(by.orderBy(TIME)).cast("bigint"))
    return rows.drop(TIME).join(totals.hint("merge"), KEY)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_roc_panels(spark: SparkSession, path: str) -> DataFrame:
    """Curves of several analyses from one table partitioned by ``analysis``."""
    return spark.read.parquet(path).select(
        "analysis", "model", "threshold", "specificity", "sensitivity"
    )
