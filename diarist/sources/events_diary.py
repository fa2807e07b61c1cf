"""A raw diary derived from an ``events`` table (event_id, ts, user_id, event_type, value, props)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diarist.schema import FLAGS, ORDINAL, RAW_COLUMNS

# The study dates that suit the events table.
QUIT_FROM, QUIT_BEFORE = "2023-10-01 00:00:00", "2024-01-16 00:00:00"
ENTRY_FROM = "2024-01-01 00:00:00"

_BASE = {
    ORDINAL: "event_id + nr * 1000000000000",
    "account_id": "concat('u', CAST(user_id AS STRING))",
    "quit_date": """CASE WHEN user_id % 11 = 0 THEN TIMESTAMP_NTZ'2023-10-20 00:00:00'
        ELSE TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(CAST(user_id % 20 - 3 AS INT)) END""",
    "timezone_offset": "CASE WHEN user_id % 4 = 0 THEN NULL ELSE CAST((user_id % 4 - 2) * 3600 AS INT) END",
    "cigs_per_day": "CAST(1 + (user_id * 7) % 110 AS INT)",
    "time_to_first_cig": """CASE CAST(user_id % 9 AS INT) WHEN 0 THEN '' WHEN 1 THEN '6-30'
        WHEN 2 THEN '31-60' WHEN 3 THEN '> 60' ELSE '<= 5' END""",
    "craving_record_created": "ts",
    "craving_date": """CASE WHEN k = 7 THEN NULL
        ELSE ts - make_dt_interval(0, 0, CAST(k * 20 - 30 AS INT)) END""",
    "craving_severity": "CAST(1 + (k + nr) % 10 AS INT)",
    "craving_did_smoke": """CASE WHEN k = 99 THEN '' WHEN nr = 1 THEN CASE WHEN value > 70 THEN 'true' ELSE 'false' END
        WHEN user_id % 13 = 0 THEN 'false'
        WHEN user_id % 29 = 5 THEN 'true'
        WHEN event_type = 'error' AND (value > 40 OR k % 10 >= 5) THEN 'true'
        WHEN value > 150 THEN 'true' ELSE 'false' END""",
    "did_someone_smoke": "CASE WHEN k % 5 = 0 THEN 'true' ELSE 'false' END",
}


def _flag(i: int, name: str) -> str:
    if name == "craving_feeling_stressed":
        return "CASE WHEN value > 60 THEN 'true' ELSE 'false' END"
    return f"CASE WHEN (event_id * {3 + 2 * i} + k * {i + 1}) % 7 < 2 THEN 'true' ELSE 'false' END"


def events_diary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw diary of FIXTURES.md: one entry per event, and every 50th event once more, later in
    order, with another severity and often another outcome."""
    exprs = _BASE | {name: _flag(i, name) for i, name in enumerate(FLAGS)}
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    # One generator makes the copies and carries ``k``, so the JSON is parsed once per event.
    k = F.get_json_object("props", "$.k").cast("int")
    twice = F.when(F.col("event_id") % 50 == 0, 1).otherwise(0)
    entry = F.transform(F.sequence(F.lit(0), twice), lambda nr: F.struct(k.alias("k"), nr.alias("nr")))
    events = events.select(
        "event_id", "user_id", "ts", "event_type", "value", F.explode(entry).alias("e")
    ).select("*", "e.k", "e.nr")
    return events.selectExpr(*[f"{exprs[c]} AS {c}" for c in [ORDINAL] + RAW_COLUMNS])
