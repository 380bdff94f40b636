"""Readers and date-window scans."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskweave.functions.scalars import as_col, months_before
from riskweave.session import shared_folder

SESSION_CATALOG = "spark_catalog"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def register_tables(spark: SparkSession, schema: str, folder: str, names: Sequence[str]) -> None:
    """Make the files of ``folder`` tables of ``schema`` in the session's catalogue.

    A table points to its file and moves no row. The schema's own folder lies in the shared one. A
    table that is already there is kept if it points to the same file and refused if not.
    """
    home = os.path.join(shared_folder(spark), "schemas", schema)
    spark.sql("CREATE SCHEMA IF NOT EXISTS IDENTIFIER(:name) LOCATION " + _literal(home), {"name": schema})
    for name in names:
        path = os.path.join(folder, f"{name}.parquet")
        full = f"{SESSION_CATALOG}.{schema}.{name}"
        if not spark.catalog.tableExists(full):
            spark.catalog.createTable(full, path=path, source="parquet")
            continue
        rows = spark.sql("DESCRIBE TABLE EXTENDED IDENTIFIER(:name)", {"name": full})
        at = rows.where(F.col("col_name") == "Location").first()["data_type"]
        if _without_scheme(at) != _without_scheme(path):
            raise ValueError(f"{full} is a table of {at}, not of {path}")


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _without_scheme(path: str) -> str:
    return re.sub(r"^file:/+", "/", path).rstrip("/")


def catalog_table(spark: SparkSession, catalog: str, schema: str, name: str) -> DataFrame:
    return spark.table(f"{catalog}.{schema}.{name}")


# ------------------------------------------------------------------------ date windows
# The bounds are computed on the driver, so they reach the scan as literals and prune
# partitions and row groups.


def whole_months(day: Column | str, as_of: date, months: int = 6) -> Column:
    """The ``months`` whole months before the month of ``as_of``, as (last day, last day]."""
    first = months_before(as_of, months) - timedelta(days=1)
    last = months_before(as_of, 0) - timedelta(days=1)
    day = as_col(day)
    return (day > F.lit(first)) & (day < F.lit(last + timedelta(days=1)))


def month_window(day: Column | str, as_of: date, months: int = 6) -> Column:
    """The same window as a half-open range of month starts."""
    day = as_col(day)
    return (day >= F.lit(months_before(as_of, months))) & (
        day < F.lit(months_before(as_of, 0))
    )


def rolling_days(day: Column | str, as_of: date, days: int = 365) -> Column:
    day = as_col(day)
    return (day >= F.lit(as_of - timedelta(days=days))) & (
        day < F.lit(as_of + timedelta(days=1))
    )


def month_to_date(day: Column | str, as_of: date) -> Column:
    day = as_col(day)
    return (day >= F.lit(as_of.replace(day=1))) & (day < F.lit(as_of + timedelta(days=1)))


def look_back(
    closing: Column | str, updated: Column | str, as_of: date, months: int = 24
) -> Column:
    """Closings of the last ``months`` months that were already known on ``as_of``."""
    closing, updated = as_col(closing), as_col(updated)
    start = F.lit(as_of)
    return (
        closing.isNotNull()
        & (closing >= F.add_months(start, -months))
        & (updated < F.lit(as_of + timedelta(days=1)))
    )


def latest_snapshot(
    df: DataFrame, day: str, as_of: date, first_days: int = 5
) -> DataFrame:
    """Rows of the newest day among the first days of the month."""
    start = as_of.replace(day=1)
    early = df.where(
        (F.col(day) >= F.lit(start)) & (F.col(day) < F.lit(start + timedelta(days=first_days)))
    )
    newest = early.agg(F.max(F.to_date(day)))
    return early.where(F.to_date(day) == newest.scalar())


# ------------------------------------------------------------------------------- files


def semicolon_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """``;``-separated file without its incomplete rows; an empty result is an error."""
    rows = spark.read.csv(path, schema=schema, sep=";", header=True).na.drop()
    if rows.isEmpty():
        raise ValueError(f"no complete row in {path}")
    return rows


def bom_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Comma-separated UTF-8 file that may start with a byte order mark."""
    return spark.read.csv(
        path, schema=schema, header=True, encoding="UTF-8", enforceSchema=True
    )


def score_csv(
    spark: SparkSession, source: str, target: str, schema: StructType, score
) -> DataFrame:
    """Read feature rows, apply ``score`` (DataFrame to DataFrame), write and re-read."""
    scored = score(spark.read.csv(source, schema=schema, header=True))
    scored.write.mode("overwrite").csv(target, header=True)
    return spark.read.csv(target, schema=scored.schema, header=True)


def export_by_period(
    df: DataFrame, target: str, time: str, file_format: str = "parquet", period: str = "day"
) -> None:
    """Rewrite only the folders of the days, weeks or months present in ``df``.

    A folder is named ``<period>=<its first day>``. Rows are rebalanced by period: adaptive execution
    joins short periods into one task, which writes a file for each, and cuts a long one into tasks of
    the advisory size (``spark.sql.adaptive.advisoryPartitionSizeInBytes``), a file each.
    """
    (
        df.withColumn(period, F.to_date(F.date_trunc(period, time)))
        .hint("rebalance", F.col(period))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(period)
        .format(file_format)
        .save(target)
    )


def purge_periods(spark: SparkSession, target: str, as_of: date, months: int = 6, period: str = "day") -> list[str]:
    """Delete the folders of an export that lie wholly behind the retention; their names.

    A week or month that the limit cuts stays. Works on the names alone: no row is read, and folders
    of other names are left.
    """
    limit = F.to_date(F.date_trunc(period, F.add_months(F.lit(as_of), -months)))
    oldest = spark.range(1).select(limit).first()[0].isoformat()
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(target)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in store.listStatus(root)]
    old = sorted(n for n in names if re.fullmatch(rf"{period}=\d{{4}}-\d\d-\d\d", n) and n.split("=")[1] < oldest)
    for name in old:
        store.delete(path(root, name), True)
    return old


def retained(df: DataFrame, time: str, as_of: date, months: int = 6) -> DataFrame:
    """Rows to keep under a retention of ``months`` months."""
    return df.where(F.col(time) >= F.add_months(F.lit(as_of), -months))


def masked_checkpoint(
    df: DataFrame, target: str, masked: list[str], enabled: bool = False
) -> DataFrame:
    """Optional step dump; key columns are hashed, and nothing is written by default."""
    if enabled:
        out = df
        for name in masked:
            out = out.withColumn(name, F.sha2(F.col(name).cast("string"), 256))
        out.write.mode("overwrite").parquet(target)
    return df
