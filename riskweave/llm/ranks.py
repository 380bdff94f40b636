"""Names not in use, and gapless positions inside groups of any size without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unused(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that ``df`` has not, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    names = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        names.append(stem)
    return names


def named(value: Column) -> Column:
    """A join key that is never null and keeps a null apart from every text."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("?"))


def bucket_of(value: Column, digits: int) -> Column:
    """The first hexadecimal digits of the value's MD5; a null counts as the empty text."""
    return F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, digits)


def running_starts(
    rows: DataFrame, group: str, bucket: str, order: list[str], size: str, start: str
) -> DataFrame:
    """Add ``start``: the sum of ``size`` over all rows of ``group`` that come before.

    Rows are ordered by ``bucket`` and then by ``order``. Only the rows of one bucket meet in a
    task; the buckets of a group are shifted by a table of one row per group and bucket.
    ``group`` and ``bucket`` must not hold nulls.
    """
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    across = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        rows.groupBy(group, bucket)
        .agg(F.sum(size).alias("_bucket_size"))
        .select(group, bucket, F.coalesce(F.sum("_bucket_size").over(across), F.lit(0)).alias("_shift"))
    )
    local = rows.withColumn("_local", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return (
        local.join(shifts, [group, bucket])
        .withColumn(start, (F.col("_shift") + F.col("_local")).cast("bigint"))
        .drop("_shift", "_local")
    )
