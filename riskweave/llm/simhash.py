"""SimHash fingerprints of word shingles and their exact links within a Hamming radius."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.components import components
from riskweave.llm.ranks import unused
from riskweave.session import written

BITS = 64
#: Word n-grams hashed together, and the most differing bits of a link.
SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
#: The fingerprint is cut into this many parts of 16 bits; their bit counts name its tile.
PARTS = 4
#: Fingerprints of one tile that meet in one array (8 bytes each).
BLOCK_ROWS = 65_536
#: Rows of a block compared at a time, which bounds the memory of a task.
STRIP_ROWS = 512
_HASHES_AT_A_TIME = 8_192


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64 majority bits over the XXH64 values of all shingles, as an unsigned number.

    A-Z is lower-cased, words are runs without ASCII white space, shingles are ``words`` words
    joined by one space, repeats included. A shorter text is one shingle; no word gives zero.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(parts)
    if n == 0:
        return 0
    line = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if n <= words:
        return digest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - words])).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    total = n - words + 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, total, _HASHES_AT_A_TIME):
        hashes = [
            digest(line[i:j], SEED)
            for i, j in zip(starts[at : at + _HASHES_AT_A_TIME], stops[at : at + _HASHES_AT_A_TIME])
        ]
        octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """The fingerprint's bits as a signed bigint, made in Arrow batches."""

    @F.pandas_udf("bigint")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return made(text.cast("string"))


def part_counts(fp: Column) -> list[Column]:
    """Bit counts of the parts of a fingerprint."""
    width = BITS // PARTS
    mask = (1 << width) - 1
    return [F.bit_count(F.shiftrightunsigned(fp, p * width).bitwiseAND(F.lit(mask))) for p in range(PARTS)]


def _tile(counts: list[Column]) -> Column:
    """One number for a list of bit counts, each below 256."""
    number = F.lit(0).cast("bigint")
    for c in counts:
        number = number * 256 + c.cast("bigint")
    return number


def _near_counts(radius: int) -> list[list[int]]:
    """All differences of bit counts whose absolute values sum to the radius at most."""
    found: list[list[int]] = [[]]
    for _ in range(PARTS):
        found = [d + [x] for d in found for x in range(-radius, radius + 1)]
        found = [d for d in found if sum(map(abs, d)) <= radius]
    return found


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within the radius, by exclusive-or and bit counts of strips.

    Strips of the left side are taken in order of the whole bit count, and meet only the stretch of
    the right side whose bit counts lie within the radius of theirs.
    """
    lo, ro = np.argsort(np.bitwise_count(left), kind="stable"), np.argsort(np.bitwise_count(right), kind="stable")
    ls, rs = left[lo], right[ro]
    lc, rc = np.bitwise_count(ls).astype(np.int64), np.bitwise_count(rs).astype(np.int64)
    pairs_l, pairs_r = [], []
    for at in range(0, len(ls), STRIP_ROWS):
        strip = ls[at : at + STRIP_ROWS]
        first = np.searchsorted(rc, lc[at] - radius, "left")
        last = np.searchsorted(rc, lc[at + len(strip) - 1] + radius, "right")
        for to in range(first, last, BLOCK_ROWS // 16):
            stretch = rs[to : min(to + BLOCK_ROWS // 16, last)]
            i, j = np.nonzero(np.bitwise_count(strip[:, None] ^ stretch[None, :]) <= radius)
            pairs_l.append(lo[at + i])
            pairs_r.append(ro[to + j])
    if not pairs_l:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(pairs_l), np.concatenate(pairs_r)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the given links connect, one per node at most."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
    return [(root(x), x) for x in parent if root(x) != x]


def _compare(radius: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for left, right in zip(batch.column(0), batch.column(1)):
                x = np.asarray(left.values, np.int64).view(np.uint64)
                y = np.asarray(right.values, np.int64).view(np.uint64)
                i, j = near_pairs(x, y, radius)
                sx, sy = x[i].view(np.int64), y[j].view(np.int64)
                other = sx != sy
                if other.any():
                    found += _forest(sx[other], sy[other])
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())],
                ["a", "b"],
            )

    return work


def links(prints: DataFrame, radius: int = RADIUS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links ``a, b`` that connect exactly what all pairs within ``radius`` bits connect.

    ``prints`` has distinct values ``fp``. The bit counts of the four 16-bit parts name a tile. Two
    fingerprints differ in at least as many bits as their part counts differ in sum, so a tile
    meets only the tiles within the radius of its counts; all other tile pairs are skipped. Within
    a pair every fingerprint is compared. A tile over ``block_rows`` is dealt into blocks by hash.
    A pair of blocks sends out a spanning forest of its links, not all of them.
    """
    spread = prints.select("fp", *[c.alias(f"c{p}") for p, c in enumerate(part_counts(F.col("fp")))])
    counts = [F.col(f"c{p}") for p in range(PARTS)]
    tiled = spread.withColumn("tile", _tile(counts))
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
    dealt = tiled.join(sizes, "tile").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    blocks = written(
        dealt.groupBy("tile", "block", *[f"c{p}" for p in range(PARTS)])
        .agg(F.sort_array(F.collect_list("fp")).alias("fps")),
        "simhash-blocks",
    )
    steps = F.array(*[F.array(*[F.lit(x) for x in d]) for d in _near_counts(radius)])
    inside = F.filter(
        steps,
        lambda d: F.forall(
            F.zip_with(F.array(*[c.cast("int") for c in counts]), d, lambda c, x: c + x),
            lambda c: (c >= 0) & (c <= BITS // PARTS),
        ),
    )
    near = F.transform(inside, lambda d: _tile([c + d[p] for p, c in enumerate(counts)]))
    visits = blocks.select(
        F.col("tile").alias("from_tile"), F.col("block").alias("from_block"), F.explode(near).alias("tile")
    ).where("from_tile <= tile")
    keys = blocks.select("tile", "block")
    pairs = visits.join(keys, "tile").where("from_tile < tile or from_block <= block")
    left = blocks.select(
        F.col("tile").alias("from_tile"), F.col("block").alias("from_block"), F.col("fps").alias("left_fps")
    )
    right = blocks.select("tile", "block", F.col("fps").alias("right_fps"))
    met = (
        pairs.join(left, ["from_tile", "from_block"]).join(right, ["tile", "block"])
        .select("left_fps", "right_fps")
    )
    return met.mapInArrow(_compare(radius), "a bigint, b bigint")


def roots(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, root`` for distinct fingerprints ``fp``; equal roots are in one component."""
    found = components(written(links(nodes, radius), "simhash-links"))
    return nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(
    df: DataFrame, key: str, text: str, words: int = SHINGLE_WORDS, radius: int = RADIUS
) -> DataFrame:
    """One row per row of ``df``: ``key``, ``fp`` and ``component`` (smallest key reachable).

    Equal fingerprints are one node; nodes within ``radius`` bits are linked, and links carry on.
    Null and empty texts have fingerprint zero and link like any other. Repeated rows stay. A null
    key takes no part in the minimum; a component of null keys only has a null name. An empty table
    gives no rows.
    """
    prints = written(
        df.select(F.col(key).alias("key"), fingerprint_column(F.col(text), words).alias("fp")),
        "simhash-prints",
    )
    nodes = written(prints.groupBy("fp").agg(F.min("key").alias("first")), "simhash-nodes")
    rooted = written(nodes.join(roots(nodes.select("fp"), radius), "fp"), "simhash-roots")
    names = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = written(rooted.join(names, "root").select("fp", "component"), "simhash-names")
    return prints.join(named, "fp").select(F.col("key").alias(key), "fp", "component")


def kept_documents(
    df: DataFrame, key: str, text: str, words: int = SHINGLE_WORDS, radius: int = RADIUS
) -> DataFrame:
    """The rows of ``df`` that stay, with its columns: one row of each component.

    That is the row with the smallest key (null last); rows sharing it are settled by text and then
    all other columns, and equal rows leave one. Helper columns take names that ``df`` has not. An
    empty table gives no rows.
    """
    fp_, root_, place_ = unused(df, "_fp", "_root", "_place")
    marked = written(df.withColumn(fp_, fingerprint_column(F.col(text), words)), "simhash-documents")
    nodes = written(marked.select(F.col(fp_).alias("fp")).distinct(), "simhash-nodes")
    rooted = written(roots(nodes, radius), "simhash-roots").select(
        F.col("fp").alias(fp_), F.col("root").alias(root_)
    )
    others = [F.col(c) for c in df.columns if c not in (key, text)]
    order = Window.partitionBy(root_).orderBy(F.col(key).asc_nulls_last(), F.col(text), *others)
    first = marked.join(rooted, fp_).withColumn(place_, F.row_number().over(order))
    return first.where(F.col(place_) == 1).select(*df.columns)
