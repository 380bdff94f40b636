"""Files that tasks write and read directly, in the folder all executors share."""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.session import shared_folder, written


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file named as a URI or a plain path."""
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def new_folder(spark: SparkSession, kind: str) -> str:
    """URI of a new folder below ``spark.checkpoint.dir``.

    Each attempt of a task writes a file with a name of its own, and the table of file names is
    what Spark commits. A file of a lost attempt is named by no table and is never read.
    """
    uri = posixpath.join(shared_folder(spark), "files", f"{kind}-{uuid.uuid4().hex}")
    store, path = open_store(uri)
    store.create_dir(path, recursive=True)
    return uri


def new_file(folder: str) -> str:
    return posixpath.join(folder, f"{uuid.uuid4().hex}.bin")


def with_file_rows(df: DataFrame, file: str, row: str) -> DataFrame:
    """Add the path of the file that a row was read from, and its number in that file.

    Both are null where ``df`` does not come straight from Parquet files.
    """
    try:
        metadata = df.metadataColumn("_metadata")
        return df.select("*", metadata["file_path"].alias(file), metadata["row_index"].alias(row))
    except AnalysisException:
        return df.select("*", F.lit(None).cast("string").alias(file), F.lit(None).cast("bigint").alias(row))


def file_starts(df: DataFrame, file: str, start: str) -> DataFrame:
    """The number of rows in all files before each: a row per file, in the order they were written.

    Spark numbers the files it writes; from 100,000 on the numbers are longer than before, so paths
    are ordered by length first. The window runs over one row per file.
    """
    sizes = df.where(F.col(file).isNotNull()).groupBy(file).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy(F.length(file), file).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(file, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias(start))
    return written(starts, "file-starts")
