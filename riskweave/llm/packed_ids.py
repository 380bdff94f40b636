"""Token ids in files of fixed-width bit fields, with block offsets for random access.

A file holds ids in the fewest bits that the vocabulary needs, least significant bit first, in
blocks of ``BLOCK_IDS`` ids (a multiple of eight, so each block starts at a byte). Behind the
blocks lie the byte offset of each block, the first id and the key of each document, which
keys are null, and the trailer.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.files import new_file, new_folder, open_store
from riskweave.llm.tokenizers_local import json_encoder, json_vocabulary_size
from riskweave.session import written

BLOCK_IDS = 65_536
MAGIC = b"PACKIDS1"
#: Bits per id, ids, documents, blocks, magic.
TRAILER = struct.Struct("<QQQQ8s")


def width_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Bit fields of the ids, the last byte filled with zeros."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if width % 8 == 0:
        return octets[:, : width // 8].tobytes()
    return np.packbits(np.unpackbits(octets, axis=1, bitorder="little")[:, :width], bitorder="little").tobytes()


def unpack(data: bytes, width: int, count: int) -> np.ndarray:
    """The first ``count`` ids of bit fields that start at a byte."""
    octets = np.zeros((count, 4), np.uint8)
    raw = np.frombuffer(data, np.uint8)
    if width % 8 == 0:
        octets[:, : width // 8] = raw[: count * width // 8].reshape(count, width // 8)
    else:
        bits = np.unpackbits(raw, count=count * width, bitorder="little").reshape(count, width)
        packed = np.packbits(bits, axis=1, bitorder="little")
        octets[:, : packed.shape[1]] = packed
    return octets.view("<u4").reshape(count)


class PackedWriter:
    """Appends documents to one file; holds one block of ids at a time."""

    def __init__(self, uri: str, width: int):
        store, path = open_store(uri)
        self._out, self._width = store.open_output_stream(path), width
        self._waiting: list[np.ndarray] = []
        self._held = 0
        self._offsets: list[int] = []
        self._at = 0
        self._starts = [0]
        self._keys: list[int | None] = []

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self._width)
        self._offsets.append(self._at)
        self._out.write(data)
        self._at += len(data)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self._keys.append(key)
        self._starts.append(self._starts[-1] + len(ids))
        self._waiting.append(ids)
        self._held += len(ids)
        if self._held >= BLOCK_IDS:
            held = np.concatenate(self._waiting)
            full = len(held) // BLOCK_IDS * BLOCK_IDS
            for at in range(0, full, BLOCK_IDS):
                self._put(held[at : at + BLOCK_IDS])
            self._waiting, self._held = [held[full:]], len(held) - full

    def close(self) -> tuple[int, int]:
        """Numbers of documents and ids."""
        if self._held:
            self._put(np.concatenate(self._waiting))
        self._out.write(np.array(self._offsets, "<u8").tobytes())
        self._out.write(np.array(self._starts, "<u8").tobytes())
        self._out.write(np.array([k or 0 for k in self._keys], "<i8").tobytes())
        self._out.write(np.array([k is None for k in self._keys], np.uint8).tobytes())
        documents, total = len(self._starts) - 1, self._starts[-1]
        self._out.write(TRAILER.pack(self._width, total, documents, len(self._offsets), MAGIC))
        self._out.close()
        return documents, total


class PackedReader:
    """Random access to a file: any run of ids, or any document, from the blocks it lies in."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self._in = store.open_input_file(path)
        size = self._in.size()
        tail = self._in.read_at(TRAILER.size, size - TRAILER.size)
        self.width, self.total, self.documents, blocks, magic = TRAILER.unpack(tail)
        if magic != MAGIC:
            raise ValueError(f"{uri} is no packed id file")
        length = 8 * (blocks + 2 * self.documents + 1) + self.documents
        raw = self._in.read_at(length, size - TRAILER.size - length)
        index = np.frombuffer(raw[: length - self.documents], "<i8")
        self.offsets, self.starts = index[:blocks], index[blocks : blocks + self.documents + 1]
        self.keys = index[blocks + self.documents + 1 :]
        self.null_keys = np.frombuffer(raw[length - self.documents :], np.uint8).astype(bool)
        self._data_end = size - TRAILER.size - length

    def ids(self, start: int, stop: int) -> np.ndarray:
        if start >= stop:
            return np.empty(0, "<u4")
        first, last = start // BLOCK_IDS, (stop - 1) // BLOCK_IDS
        begin = int(self.offsets[first])
        end = int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else self._data_end
        held = min(self.total, (last + 1) * BLOCK_IDS) - first * BLOCK_IDS
        found = unpack(self._in.read_at(end - begin, begin), self.width, held)
        return found[start - first * BLOCK_IDS : stop - first * BLOCK_IDS]

    def document(self, n: int) -> np.ndarray:
        return self.ids(int(self.starts[n]), int(self.starts[n + 1]))

    def runs(self, blocks: int = 16) -> Iterator[tuple[int, int, np.ndarray]]:
        """Documents in order as (number, first id in the file, ids), a long one in several runs."""
        step, base, held = blocks * BLOCK_IDS, 0, np.empty(0, "<u4")
        for n in range(self.documents):
            at, stop = int(self.starts[n]), int(self.starts[n + 1])
            if at == stop:
                yield n, at, held[:0]
            while at < stop:
                if not base <= at < base + len(held):
                    base = at // step * step
                    held = self.ids(base, min(base + step, self.total))
                upto = min(stop, base + len(held))
                yield n, at, held[at - base : upto - base]
                at = upto

    def close(self) -> None:
        self._in.close()


def write_packed(
    df: DataFrame, key: str, text: str, path: str, end_id: int, folder: str
) -> DataFrame:
    """Encode whole texts and write them in ascending ``key`` order; one row per file.

    Rows are dealt by ranges of the key, so the files' order (``part``) and the order in each file
    make one global order, nulls first. Rows of one key are ordered by text; a key with very many
    rows spreads over several files. Null and empty texts are documents of the end id alone. An
    empty table gives no file. Columns: part, file, documents, ids.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, width = json_encoder(path), width_for(max(json_vocabulary_size(path), end_id + 1))
        end = np.array([end_id], "<u4")
        out, file = None, ""
        for batch in batches:
            for number, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None:
                    file = new_file(folder)
                    out = PackedWriter(file, width)
                out.add(number, np.concatenate([encoder.ids(value.as_py()), end]))
        if out is not None:
            documents, total = out.close()
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "file": [file], "documents": [documents], "ids": [total]},
                pa.schema([("part", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]),
            )

    rows = df.select(
        F.col(key).cast("bigint").alias("_key"), F.col(text).cast("string").alias("_text"), F.monotonically_increasing_id().alias("_row")
    ).withColumn("_hash", F.xxhash64("_text"))
    order = ["_key", "_hash", "_row"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select("_key", "_text").mapInArrow(work, "part int, file string, documents bigint, ids bigint")


def file_starts(files: DataFrame) -> DataFrame:
    """Files with the number of ids in all files before (one row per file meets in the window)."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_back(files: DataFrame, key: str) -> DataFrame:
    """One row per document, from the files alone: ``key``, start, n_tokens, ids_crc32.

    ``files`` is what ``write_packed`` gives, read again any number of times.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = PackedReader(row["file"])
                crcs = np.zeros(reader.documents, np.int64)
                for n, _, ids in reader.runs():
                    crcs[n] = zlib.crc32(np.ascontiguousarray(ids), int(crcs[n]))
                reader.close()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(reader.keys, pa.int64(), mask=reader.null_keys),
                        pa.array(reader.starts[:-1] + row["start"]),
                        pa.array(np.diff(reader.starts)),
                        pa.array(crcs),
                    ],
                    [key, "start", "n_tokens", "ids_crc32"],
                )

    spread = max(1, files.count())
    return file_starts(files).repartitionByRange(spread, "part").mapInArrow(
        work, f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def packed_round_trip(df: DataFrame, key: str, text: str, path: str, end_id: int) -> DataFrame:
    """Write all texts of ``df`` to packed files in the shared folder and describe what they hold."""
    folder = new_folder(df.sparkSession, "packed-ids")
    return read_back(written(write_packed(df, key, text, path, end_id, folder), "packed-files"), key)
