"""Token counts of documents in flat token files, from a scan for end-of-document ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.files import new_file, new_folder, open_store
from riskweave.llm.tokenizers_local import rank_ids
from riskweave.session import written

#: Bytes of a block; a multiple of every id width.
BLOCK_BYTES = 4 << 20


def id_type(vocabulary: int) -> str:
    """Little-endian type of the ids of a flat file."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def write_flat(
    df: DataFrame, key: str, text: str, path: str, pattern: str, end_id: int, folder: str
) -> DataFrame:
    """Encode whole texts into flat files, each document followed by ``end_id``; one file a task.

    The files hold ids only. The rows returned say which document was written where: ``key``,
    ``file``, ``ordinal`` and ``file_bytes`` (on the last row of a file, else null). Null and empty
    texts are documents without ids; repeated rows are documents of their own.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(id_type(end_id + 1))
        out, file, ordinal, size = None, "", 0, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if out is None:
                file = new_file(folder)
                store, name = open_store(file)
                out = store.open_output_stream(name)
            for value in batch.column(1):
                size += out.write(np.array([*rank_ids(value.as_py(), path, pattern), end_id], kind).tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([file] * n, pa.string()), pa.array(np.arange(ordinal, ordinal + n)), pa.nulls(n, pa.int64())],
                [key, "file", "ordinal", "file_bytes"],
            )
            ordinal += n
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, key_type), pa.array([file]), pa.nulls(1, pa.int64()), pa.array([size], pa.int64())],
                [key, "file", "ordinal", "file_bytes"],
            )

    chosen = df.select(F.col(key), F.col(text).cast("string").alias("_text"))
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(chosen.schema[0].dataType)
    kind = chosen.schema[0].dataType.simpleString()
    return chosen.mapInArrow(work, f"`{key}` {kind}, file string, ordinal bigint, file_bytes bigint")


def scan_blocks(files: DataFrame, end_id: int, vocabulary: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of flat files (columns ``file``, ``file_bytes``) with the ids and the separators found.

    Columns: file, block, first_id, ids, ends (positions in the file, ascending). Blocks are read
    each for itself, by whichever task gets them.
    """
    kind = id_type(vocabulary)
    width = np.dtype(kind).itemsize

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(row["file"])
                with store.open_input_file(path) as data:
                    raw = data.read_at(min(block_bytes, row["file_bytes"] - row["at"]), row["at"])
                ids = np.frombuffer(raw, kind)
                first = row["at"] // width
                ends = np.flatnonzero(ids == end_id) + first
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["file"]]),
                        pa.array([row["at"] // block_bytes], pa.int64()),
                        pa.array([first], pa.int64()),
                        pa.array([len(ids)], pa.int64()),
                        pa.array([ends], pa.list_(pa.int64())),
                    ],
                    ["file", "block", "first_id", "ids", "ends"],
                )

    blocks = files.where("file_bytes > 0").select(
        "file", "file_bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("file_bytes") - 1, F.lit(block_bytes).cast("bigint"))).alias("at")
    )
    return blocks.repartition("file", "at").mapInArrow(
        work, "file string, block bigint, first_id bigint, ids bigint, ends array<bigint>"
    )


def count_tokens(files: DataFrame, end_id: int, vocabulary: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents of flat files: file, ordinal, start, n_tokens (without the end id), closed.

    A prefix scan over the blocks of a file carries in how many documents ended before a block and
    where the last of them ended, so a document may span any number of blocks. Ids behind the last
    end of a file are one more document that is not closed. The scan sees one narrow row per block;
    the separators join it afterwards. No files, or empty ones, give no rows.
    """
    blocks = written(scan_blocks(files, end_id, vocabulary, block_bytes), "token-blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    narrow = blocks.select(
        "file", "block", F.size("ends").cast("bigint").alias("n"), F.array_max("ends").alias("last"),
        (F.col("first_id") + F.col("ids")).alias("stop"),
    )
    carried = narrow.select(
        "file", "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ended"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carried"),
    )
    found = blocks.select("file", "block", "ends", F.posexplode("ends").alias("i", "end"))
    found = found.select(
        "file", "block", "i", "end", F.when(F.col("i") > 0, F.get("ends", F.col("i") - 1)).alias("previous")
    )
    closed = found.join(carried, ["file", "block"]).select(
        "file",
        (F.col("ended") + F.col("i")).alias("ordinal"),
        (F.coalesce("previous", "carried") + 1).alias("start"),
        F.col("end"),
        F.lit(True).alias("closed"),
    )
    tails = (
        narrow.groupBy("file")
        .agg(F.sum("n").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.max("stop").alias("end"))
        .where("start < end")
        .withColumn("closed", F.lit(False))
    )
    return closed.unionByName(tails).select(
        "file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "closed"
    )


def document_token_counts(df: DataFrame, key: str, text: str, path: str, pattern: str, end_id: int) -> DataFrame:
    """``key`` and ``n_tokens`` for every row of ``df``, counted in flat files written from it."""
    folder = new_folder(df.sparkSession, "flat-tokens")
    rows = written(write_flat(df, key, text, path, pattern, end_id, folder), "flat-tokens")
    counts = count_tokens(rows.where("file_bytes is not null").select("file", "file_bytes"), end_id, end_id + 1)
    return rows.where("ordinal is not null").join(counts, ["file", "ordinal"]).select(key, "n_tokens")
