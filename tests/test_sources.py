"""Reading and writing."""

from catalog import inputs
from diarist.schema import RAW_COLUMNS
from diarist.sources import tables


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "diary.csv"
    header = ",".join(RAW_COLUMNS + ["further"])
    flags = ",".join(["true"] * 31)
    path.write_text(
        f"{header}\n"
        f"u1,2024-01-01 00:00:00,NA,20,<= 5,2024-01-02 03:04:05,NA,4,true,{flags},x\n"
        f"u1,2024-01-01 00:00:00,3600,20,,2024-01-02 04:04:05,2024-01-02 04:00:00,4,,{flags},x\n"
    )
    rows = tables.parse_times(tables.scan_diary(spark, str(path))).orderBy("entry_ordinal").collect()
    assert rows[0]["timezone_offset"] is None and rows[0]["craving_date"] is None
    assert rows[1]["timezone_offset"] == 3600
    assert not rows[1]["craving_did_smoke"]
    assert rows[0].asDict().keys() == {"entry_ordinal", *RAW_COLUMNS}


def test_ordinals_are_distinct_and_may_be_given(spark, sf, tmp_path):
    path = str(tmp_path / "many")
    inputs.raw(spark, sf).select(*RAW_COLUMNS).repartition(7).write.option("header", True).option("nullValue", "NA").csv(path)
    read = tables.scan_diary(spark, path)
    assert read.count() == read.select("entry_ordinal").distinct().count() == inputs.raw(spark, sf).count()
    own = str(tmp_path / "own")
    inputs.raw(spark, sf).write.parquet(own)
    assert tables.scan_diary(spark, own, "parquet").agg({"entry_ordinal": "min"}).first()[0] == 0


def test_write_if_absent_keeps_the_first(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_if_absent(spark.range(3), path)
    tables.write_if_absent(spark.range(5), path)
    assert tables.read_table(spark, path).count() == 3


def test_bucketed_clean_table(spark, sf):
    tables.write_clean(inputs.clean(spark, sf), "clean_bucketed", 4)
    plan = spark.table("clean_bucketed").groupBy("account_id").count()._jdf.queryExecution().executedPlan()
    assert "Exchange" not in plan.toString()
    numbered = tables.numbered_entries(spark.table("clean_bucketed"))
    assert "Exchange" not in numbered._jdf.queryExecution().executedPlan().toString()
    assert numbered.filter("number = entries").count() == spark.table("clean_bucketed").select("account_id").distinct().count()
    spark.sql("DROP TABLE clean_bucketed")


def test_partitioned_results(spark, tmp_path):
    path = str(tmp_path / "curves")
    row = [("rf", 0.5, 0.1, 0.2)]
    for analysis in ("main", "other"):
        df = spark.createDataFrame(row, "model string, threshold double, specificity double, sensitivity double")
        tables.write_table(df.selectExpr("*", f"'{analysis}' AS analysis"), path, ["analysis"], "append")
    assert tables.scan_roc_panels(spark, path).filter("analysis = 'main'").count() == 1
