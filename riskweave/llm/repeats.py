"""Removal of long passages that repeat: level-wise doubling of repeated word windows.

Windows of the shortest length are looked at first. Only where two of them that repeat lie end to end
can a window of twice the length repeat, so each level looks at what the level before has left, until
the wanted length is reached or no candidate survives.
"""

from __future__ import annotations

import math
import posixpath
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.files import open_store
from riskweave.session import shared_folder, written

WINDOW_WORDS = 20
#: A level of this many words or fewer is not halved again.
SHORTEST_WORDS = 5
#: Bytes of text a chunk holds: the unit that is read, hashed and answered at once. A longer text
#: is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Hashes a bucket gets on average if there are up to MANY_BUCKETS, and beyond that number.
SMALL_BUCKET, LARGE_BUCKET, MANY_BUCKETS = 1 << 17, 1 << 24, 1 << 10
#: Chunks whose answers lie in one folder.
CHUNKS_PER_GROUP = 8
_BYTES_PER_WORD = 6
_NULL_KEY = -(2**63)
_OUTPUT = ("n_words", "n_removed", "kept_text")

_CHUNKS = "chunk string, bytes bigint, keys array<bigint>, missing array<boolean>, digests array<bigint>, texts array<binary>"


def level_lengths(words: int, shortest: int = SHORTEST_WORDS) -> list[int]:
    """Window lengths from the first level to ``words``; each is made of two windows of the one before.

    An odd length is made of two windows that share one word.
    """
    found = [words]
    while found[0] > shortest:
        found.insert(0, -(-found[0] // 2))
    return found


# ------------------------------------------------------------------------------ window hashes


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolled(words: np.ndarray, length: int, factor: int) -> np.ndarray:
    """Polynomial over ``length`` words from every start that has as many, modulo 2**64."""
    if length == 1:
        return words
    half = length // 2
    part = _rolled(words, half, factor)
    power = np.uint64(pow(factor, half, 1 << 64))
    both = part[: len(words) - 2 * half + 1] * power + part[half:]
    if length % 2:
        both = both[: len(words) - length + 1] * np.uint64(factor) + words[length - 1 :]
    return both


def _window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    return _mixed(_rolled(words, length, 0x9E3779B97F4A7C15))


def _second_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """32 more bits of the same windows, independent of the first 64."""
    other = _mixed(words ^ np.uint64(0xD1B54A32D192ED03))
    return (_mixed(_rolled(other, length, 0xA24BAED4963EE407)) >> np.uint64(32)).astype(np.uint32)


# ----------------------------------------------------------------------------------- one chunk


class _Chunk:
    """The words of a chunk's documents in a row, and the windows that may still repeat."""

    def __init__(self, row: dict):
        self.id = row["chunk"]
        self.keys = np.array(row["keys"], np.int64)
        self.missing, self.texts = row["missing"], row["texts"]
        self.digests = np.array(row["digests"], np.int64) if row["digests"] else None
        digest = xxhash.xxh3_64_intdigest
        hashed = [[digest(w) for w in text.split()] for text in self.texts]
        self.sizes = np.array([len(h) for h in hashed], np.int64)
        self.hashes = np.array([x for h in hashed for x in h], np.uint64)
        ends = np.cumsum(self.sizes)
        self.left = np.repeat(ends, self.sizes) - np.arange(len(self.hashes))
        self.document = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def candidates(self, length: int, half: int | None, repeated: np.ndarray | None) -> np.ndarray:
        """Starts of windows inside a document whose two halves both repeat."""
        fits = self.left >= length
        if half is not None:
            step = length - half
            fits[: max(0, len(fits) - step)] &= repeated[step:]
            fits &= repeated
        return np.flatnonzero(fits)

    def distinct(self, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct window hashes in order, how often each occurs, and the place of each start's hash."""
        values, inverse, counts = np.unique(
            _window_hashes(self.hashes, length)[starts], return_inverse=True, return_counts=True
        )
        return values, counts, inverse

    def distinct_exact(
        self, starts: np.ndarray, length: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``distinct`` over 96 bits: both hashes, the first start of each, the place of each start's."""
        a, b = _window_hashes(self.hashes, length)[starts], _second_hashes(self.hashes, length)[starts]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        inverse = np.empty(len(a), np.int64)
        inverse[order] = np.cumsum(new) - 1
        return a[new], b[new], starts[order[new]], inverse


def _cuts(values: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket of sorted hashes begins; a bucket holds those of equal first ``bits`` bits."""
    if bits == 0:
        return np.array([0, len(values)])
    firsts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(values, firsts), len(values))


def _answers(folder: str, level: int, groups: int, chunk: str, sizes: np.ndarray) -> np.ndarray:
    """The answer to every distinct hash of a chunk, in the order of the hashes."""
    store, path = open_store(posixpath.join(folder, f"level={level}", f"group={_group(chunk, groups)}"))
    found = pq.read_table(path, columns=["bucket", "flags"], filters=[("chunk", "=", chunk)], filesystem=store, partitioning=None)
    flags = dict(zip(found.column("bucket").to_pylist(), found.column("flags").to_pylist()))
    parts = [
        np.unpackbits(np.frombuffer(flags[bucket], np.uint8), count=int(n))
        for bucket, n in enumerate(sizes)
        if n
    ]
    return np.concatenate(parts).astype(bool)


def _group(chunk: str, groups: int) -> int:
    return zlib.crc32(chunk.encode()) % groups


class _Plan:
    """What every task needs to know: lengths, bucket bits, number of groups and the answers' folder."""

    def __init__(self, lengths: list[int], bits: int, groups: int, folder: str):
        self.lengths, self.bits, self.groups, self.folder = lengths, bits, groups, folder

    def repeated(self, chunk: _Chunk, level: int) -> np.ndarray | None:
        """For every start whether its window of ``level`` repeats, from the levels' answers in order."""
        marks = None
        for n in range(level + 1):
            length = self.lengths[n]
            starts = chunk.candidates(length, self.lengths[n - 1] if n else None, marks)
            marks = np.zeros(len(chunk.hashes), bool)
            if len(starts):
                values, counts, inverse = chunk.distinct(starts, length)
                told = _answers(self.folder, n, self.groups, chunk.id, np.diff(_cuts(values, self.bits)))
                marks[starts] = (told | (counts > 1))[inverse]
        return marks

    def last_candidates(self, chunk: _Chunk) -> np.ndarray:
        last = len(self.lengths) - 1
        if last == 0:
            return chunk.candidates(self.lengths[0], None, None)
        return chunk.candidates(self.lengths[last], self.lengths[last - 1], self.repeated(chunk, last - 1))


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for n in range(batch.num_rows):
            yield batch.slice(n, 1).to_pylist()[0]


# -------------------------------------------------------------------------------------- stages


def _packed(chunk_bytes: int):
    """Batches of (key, digest, text) to rows of whole documents, in the order of their keys."""

    def row(held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda d: (d[0] is not None, d[0] or 0, d[1] or 0))
        packed = {
            "chunk": uuid.uuid4().hex,
            "bytes": sum(len(d[2]) for d in held),
            "keys": [_NULL_KEY if d[0] is None else d[0] for d in held],
            "missing": [d[0] is None for d in held],
            "digests": [d[1] for d in held if d[1] is not None],
            "texts": [d[2] for d in held],
        }
        types = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(packed.values(), types)], list(packed))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for key, digest, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or b""
                if held and size + len(text) > chunk_bytes:
                    yield row(held)
                    held, size = [], 0
                held.append((key, digest, text))
                size += len(text)
        if held:
            yield row(held)

    return work


_BLOBS = "bucket int, chunk string, n int, hashes binary"
_FIRSTS = "bucket int, chunk string, n int, hashes binary, seconds binary, keys binary, digests binary"


def _asked(plan: _Plan, level: int):
    """The distinct candidate hashes of each chunk: 32 bits after those that name the bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = plan.lengths[level]
        for row in _chunk_rows(batches):
            chunk = _Chunk(row)
            before = plan.repeated(chunk, level - 1) if level else None
            starts = chunk.candidates(length, plan.lengths[level - 1] if level else None, before)
            if not len(starts):
                continue
            values, _, _ = chunk.distinct(starts, length)
            cuts = _cuts(values, plan.bits)
            short = (values >> np.uint64(32 - plan.bits)).astype(np.uint32)
            buckets = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(buckets, pa.int32()),
                    pa.array([chunk.id] * len(buckets), pa.string()),
                    pa.array(np.diff(cuts)[buckets], pa.int32()),
                    pa.array([short[cuts[b] : cuts[b + 1]].tobytes() for b in buckets], pa.binary()),
                ],
                ["bucket", "chunk", "n", "hashes"],
            )

    return work


def _asked_last(plan: _Plan):
    """The distinct candidates of the last level: 96 bits and the first document of the chunk that has it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _chunk_rows(batches):
            chunk = _Chunk(row)
            starts = plan.last_candidates(chunk)
            if not len(starts):
                continue
            a, b, firsts, _ = chunk.distinct_exact(starts, plan.lengths[-1])
            document = chunk.document[firsts]
            keys = chunk.keys[document]
            cuts = _cuts(a, plan.bits)
            buckets = np.flatnonzero(np.diff(cuts))
            digests = np.empty(0, np.int64) if chunk.digests is None else chunk.digests[document]

            def parts(values: np.ndarray) -> pa.Array:
                return pa.array([values[cuts[x] : cuts[x + 1]].tobytes() for x in buckets], pa.binary())

            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(buckets, pa.int32()), pa.array([chunk.id] * len(buckets), pa.string()),
                    pa.array(np.diff(cuts)[buckets], pa.int32()), parts(a), parts(b), parts(keys), parts(digests),
                ],
                ["bucket", "chunk", "n", "hashes", "seconds", "keys", "digests"],
            )

    return work


def _joined(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _flag_rows(found: pa.Table, flags: np.ndarray) -> pa.Table:
    """Answers as bits, cut into the rows that asked."""
    ends = np.cumsum(found.column("n").to_numpy())
    bits = [np.packbits(flags[end - n : end]).tobytes() for end, n in zip(ends, found.column("n").to_numpy())]
    return pa.table({"chunk": found.column("chunk"), "bucket": found.column("bucket"), "flags": pa.array(bits, pa.binary())})


def _seen_elsewhere(found: pa.Table) -> pa.Table:
    """A bucket's hashes that more than one chunk has asked about."""
    _, inverse, counts = np.unique(_joined(found.column("hashes"), np.uint32), return_inverse=True, return_counts=True)
    return _flag_rows(found, counts[inverse] > 1)


def _first_of_all(found: pa.Table) -> pa.Table:
    """For each window of a bucket the one chunk that has its first place in the corpus."""
    a, b = _joined(found.column("hashes"), np.uint64), _joined(found.column("seconds"), np.uint32)
    keys, digests = _joined(found.column("keys"), np.int64), _joined(found.column("digests"), np.int64)
    order = np.lexsort(([digests] if len(digests) else []) + [keys, b, a])
    sa, sb = a[order], b[order]
    new = np.ones(len(order), bool)
    new[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
    flags = np.zeros(len(order), bool)
    flags[order[new]] = True
    return _flag_rows(found, flags)


def _kept(plan: _Plan | None, words: int):
    """Documents without the words of later windows; without a plan nothing repeats."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _chunk_rows(batches):
            chunk = _Chunk(row)
            cover = np.zeros(len(chunk.hashes) + 1, np.int64)
            starts = plan.last_candidates(chunk) if plan else []
            if len(starts):
                a, _, firsts, inverse = chunk.distinct_exact(starts, words)
                sizes = np.diff(_cuts(a, plan.bits))
                told = _answers(plan.folder, len(plan.lengths) - 1, plan.groups, chunk.id, sizes)
                later = starts[~told[inverse] | (firsts[inverse] != starts)]
                cover[later] += 1
                cover[later + words] -= 1
            gone = np.cumsum(cover)[:-1] > 0
            kept, removed, at = [], [], 0
            for text, n in zip(chunk.texts, chunk.sizes.tolist()):
                out = gone[at : at + n]
                parts = text.split()
                kept.append(b" ".join([w for w, x in zip(parts, out.tolist()) if not x] if out.any() else parts))
                removed.append(int(out.sum()))
                at += n
            keys = [None if m else k for k, m in zip(chunk.keys.tolist(), chunk.missing)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(chunk.sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                ["key", *_OUTPUT],
            )

    return work


def _write_answers(asked: DataFrame, answer: Callable[[pa.Table], pa.Table], plan: _Plan, level: int) -> bool:
    """Answer a level's buckets, and write the answers by group of chunks. False: nothing was asked."""
    told = asked.groupBy("bucket").applyInArrow(answer, "chunk string, bucket int, flags binary")
    group = F.pmod(F.crc32(F.col("chunk").cast("binary")), F.lit(plan.groups)).cast("int").alias("group")
    path = posixpath.join(plan.folder, f"level={level}")
    told.select("*", group).repartition("group").write.partitionBy("group").parquet(path)
    return not asked.sparkSession.read.schema("chunk string, group int").parquet(path).isEmpty()


def without_repeats(
    df: DataFrame,
    key: str,
    text: str,
    words: int = WINDOW_WORDS,
    shortest: int = SHORTEST_WORDS,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per row of ``df``: ``key``, ``n_words``, ``n_removed``, ``kept_text``.

    Words are runs without ASCII white space. Every word goes that lies in a window of ``words`` words
    whose word sequence starts earlier too: in a row of smaller ``key``, or in the same text before.
    All windows are judged on the input. ``kept_text`` joins the other words by one space.

    Documents are packed into chunks of about ``chunk_bytes``, one row each, and written once; the
    texts are never shuffled. At each level a chunk sends its distinct candidate hashes, 4 bytes each,
    to buckets named by their first bits, and gets one bit for each back: seen in another chunk or not.
    A hash of any frequency comes once from each chunk, so no bucket grows with a frequent window.
    False alarms of the short hash are only candidates. The last level compares 96 bits besides the
    bucket's, and the answer names the one chunk that holds the first place. Answers are written
    between the levels: a lost executor repeats one stage of one level.

    Null and empty texts have no words. ``key`` is a whole number; a null key counts as smaller than all
    others. Rows that share a key are ordered by their text's digest, and equal rows count as separate
    documents, of which one is first. An empty table gives no rows. Other columns are left out;
    a key named like an output column is refused.
    """
    if key.lower() in _OUTPUT:
        raise ValueError(f"the key must not be named {key}")
    if words < 1 or shortest < 1:
        raise ValueError("windows have at least one word")
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    shared = rows.groupBy("key").count().where(F.col("count") > 1)
    digest = F.lit(None).cast("bigint") if shared.isEmpty() else F.xxhash64(F.coalesce("text", F.lit("")))
    chunks = written(
        rows.select("key", digest.alias("digest"), F.col("text").cast("binary").alias("text"))
        .mapInArrow(_packed(chunk_bytes), _CHUNKS),
        "repeat-chunks",
    )
    n_chunks, size = chunks.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    lengths = level_lengths(words, shortest)
    folder = posixpath.join(shared_folder(spark), "tables", f"repeat-answers-{uuid.uuid4().hex}")
    plan = _Plan(lengths, _bucket_bits(size), max(1, n_chunks // CHUNKS_PER_GROUP), folder)
    survive = True
    for level in range(len(lengths) - 1):
        asked = chunks.mapInArrow(_asked(plan, level), _BLOBS)
        if not (survive := _write_answers(asked, _seen_elsewhere, plan, level)):
            break
    if survive:
        survive = _write_answers(chunks.mapInArrow(_asked_last(plan), _FIRSTS), _first_of_all, plan, len(lengths) - 1)
    kept = chunks.mapInArrow(
        _kept(plan if survive else None, words), "key bigint, n_words bigint, n_removed bigint, kept_text binary"
    )
    return kept.select(F.col("key").alias(key), "n_words", "n_removed", F.col("kept_text").cast("string").alias("kept_text"))


def _bucket_bits(size: int) -> int:
    """Bits that name a bucket, so that its hashes fit in a task at any size of the corpus."""
    hashes = size / _BYTES_PER_WORD
    buckets = max(hashes / LARGE_BUCKET, min(MANY_BUCKETS, hashes / SMALL_BUCKET))
    return min(31, max(0, math.ceil(math.log2(max(1.0, buckets)))))
