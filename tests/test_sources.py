"""Catalogue tables, the SQL category function and exports whose files follow the data."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from riskweave import rules
from riskweave.operators import movements as mv
from riskweave.sources import tables as src


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_catalog_table_is_pruned(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS twice", "'x' AS text").write.parquet(str(tmp_path / "t.parquet"))
    for _ in range(2):  # a second registration of the same file changes nothing
        src.register_tables(spark, "rw_pruned", str(tmp_path), ["t"])
    rows = src.catalog_table(spark, src.SESSION_CATALOG, "rw_pruned", "t").where("id >= 90").select("twice")
    text = plan(rows)
    assert "GreaterThanOrEqual(id,90)" in text and "ReadSchema: struct<id:bigint,twice:bigint>" in text
    assert rows.count() == 10


def test_catalog_table_of_another_file_is_refused(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(3).write.parquet(str(tmp_path / name / "t.parquet"))
    src.register_tables(spark, "rw_other", str(tmp_path / "a"), ["t"])
    with pytest.raises(ValueError, match="is a table of"):
        src.register_tables(spark, "rw_other", str(tmp_path / "b"), ["t"])


def test_category_function_equals_the_column(spark):
    codes = sorted({c for rule in rules.CATEGORY_RULES for c in rule.codes})
    labels = [p for rule in rules.CATEGORY_RULES for p in rule.label_prefixes]
    rows = (
        spark.createDataFrame([(c,) for c in [*codes, -1, None]], "code long")
        .crossJoin(spark.createDataFrame([("credit",), ("debit",), (None,)], "side string"))
        .crossJoin(spark.createDataFrame([(f"{p} 7",) for p in labels] + [("other",), ("",), (None,)], "label string"))
    )
    spark.sql(mv.category_function_sql())
    both = rows.select(
        F.expr("movement_category(code, side, label)").alias("by_sql"), mv.category("code", "side", "label").alias("c")
    )
    assert both.where(~F.col("by_sql").eqNullSafe(F.col("c"))).isEmpty()
    assert "Python" not in plan(both)


def test_category_function_quotes_its_texts(spark):
    table = [rules.CategoryRule("it's", label_prefixes=("L'AN\\",))]
    spark.sql(mv.category_function_sql("quoted_category", table))
    rows = spark.createDataFrame([("L'AN\\NEE",), ("LAN",)], "label string")
    got = rows.select(F.expr("quoted_category(1L, 'debit', label)")).collect()
    assert [r[0] for r in got] == ["it's", None]


def test_export_files_follow_the_data(spark, tmp_path):
    """A hot day is cut by size, short days have a file each."""
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        day = F.when(F.col("id") < 190_000, 0).otherwise(F.col("id") % 20 + 1)
        rows = spark.range(0, 200_000, 1, 8).select(
            "id",
            F.timestamp_seconds(1_704_067_200 + day * 86_400).alias("ts"),
            F.sha2(F.col("id").cast("string"), 256).alias("text"),
        )
        folder = str(tmp_path / "export")
        src.export_by_period(rows, folder, "ts")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    first = dt.date(2024, 1, 1)
    files = {n: glob.glob(f"{folder}/day={first + dt.timedelta(days=n)}/*.parquet") for n in range(21)}
    assert len(files[0]) > 4
    assert all(1 <= len(files[n]) <= 2 for n in range(1, 21))
    assert spark.read.parquet(folder).count() == 200_000


def test_export_of_an_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([], "id long, ts timestamp")
    src.export_by_period(rows, str(tmp_path / "none"), "ts")
    assert spark.read.schema("id long, ts timestamp, day date").parquet(str(tmp_path / "none")).isEmpty()
