"""Byte-level BPE with tiktoken: encoding of whole texts and decoding of ids to raw bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.tokenizers_local import rank_encoding, rank_ids


def encode(df: DataFrame, text: str, path: str, pattern: str, name: str = "ids") -> DataFrame:
    """All rows and columns of ``df`` with the ids of the whole text as ``array<int>``.

    Long texts are cut at safe boundaries, so no part of a text depends on its length. Null and
    empty texts have no ids; repeated rows stay; an empty table gives no rows; ``name`` replaces an
    older column. ``path`` is read on each executor.
    """

    @F.pandas_udf("array<int>")
    def ids(texts):
        return texts.map(lambda t: np.array(rank_ids(t, path, pattern), np.int32), na_action=None)

    return df.withColumn(name, ids(F.col(text).cast("string")))


def decode(df: DataFrame, ids: str, path: str, pattern: str, name: str = "bytes") -> DataFrame:
    """All rows and columns of ``df`` with the raw bytes of its ids; null ids give no bytes.

    The bytes are not checked to be UTF-8: a list of ids may end inside a character.
    """

    @F.pandas_udf("binary")
    def raw(lists):
        encoding = rank_encoding(path, pattern)
        return lists.map(lambda x: b"" if x is None else encoding.decode_bytes(x.tolist()), na_action=None)

    return df.withColumn(name, raw(F.col(ids)))


def round_trip(df: DataFrame, key: str, text: str, path: str, pattern: str, carried: Sequence[str] = ()) -> DataFrame:
    """``key``, number of ids, and SHA-256 of the decimal ids and of the bytes they decode to.

    The ids stay inside the task: they are encoded, joined by commas for the first digest, and
    decoded for the second. One row per row of ``df`` with its ``carried`` columns at the end; null
    and empty texts have no ids and the digests of the empty string.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(path, pattern)
        for batch in batches:
            sizes, ids_digests, byte_digests = [], [], []
            for value in batch.column(1):
                ids = rank_ids(value.as_py(), path, pattern)
                sizes.append(len(ids))
                ids_digests.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                byte_digests.append(hashlib.sha256(encoding.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(byte_digests, pa.string()), *batch.columns[2:]],
                [key, "n_tokens", "ids_sha256", "decoded_sha256", *carried],
            )

    chosen = df.select(F.col(key), F.col(text).cast("string").alias("_text"), *carried)
    kind = chosen.schema[0].dataType.simpleString()
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[2:])
    return chosen.mapInArrow(
        work, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}"
    )
