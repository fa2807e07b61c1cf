"""Session settings that suit diaries."""

from pyspark.sql import SparkSession

# Rows of forty and more columns make generated methods that the JVM does not compile; above this
# size Spark falls back to smaller generated pieces, which it does. Skewed joins are split.
SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark
