"""Tables written to cut lineage, in the folder the cluster names for checkpoints."""

import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; on one machine, a temporary folder if that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    local = spark.sparkContext.master.startswith("local")
    if root and not local and ":" not in root:
        # A path without a file system means Hadoop's default one, which is shared only if it was set.
        default = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        if default.startswith("file:"):
            warnings.warn(f"spark.checkpoint.dir ({root}) names no file system; all executors must share it")
    if not root:
        if not local:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="diarist-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/diarist-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by=()) -> DataFrame:
    """Write ``df`` once as Parquet and return the table that was written."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables whose readers are done."""
    jvm = spark._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a scratch folder was written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
