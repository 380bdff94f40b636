"""Exact nearest neighbours of stated queries by a join of blocks of quantised vectors."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of queries and of candidates, and candidates of one product tile.
QUERY_ROWS = 1_024
BLOCK_ROWS = 16_384
TILE_ROWS = 2_048
#: Above this many components an exact product of codes needs double precision.
_SINGLE_PRECISION = 1_000
#: Widens the bounds by more than the rounding of their own computation.
_SLACK = 1e-6
#: Squares below the square of this may vanish in double precision, so bounds leave it room.
_LEAST = 1e-150


def usable(vector: Column) -> Column:
    """True for vectors that take part: not null, some component not zero, all finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each row, and the length of what the codes leave out."""
    scale = np.abs(vectors).max(axis=1) / 127.0
    scale = np.where(scale > 0, scale, 1.0)
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    rest = vectors - codes * scale[:, None]
    return codes, scale, np.sqrt((rest * rest).sum(axis=1))


def exact(query: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, components added in order.

    Where squares leave the range of doubles, the steps are divided by the largest one first. A
    distance above the largest double is infinite.
    """
    with np.errstate(over="ignore"):
        total = np.zeros(len(candidates))
        for d in range(len(query)):
            step = candidates[:, d] - query[d]
            total += step * step
        found = np.sqrt(total)
        odd = np.flatnonzero((found < _LEAST) | (found == np.inf))
        if len(odd):
            steps = np.abs(candidates[odd] - query)
            most = steps.max(axis=1)
            shares = np.divide(steps, most[:, None], out=np.zeros_like(steps), where=(most[:, None] > 0) & np.isfinite(steps))
            found[odd] = np.where(np.isfinite(most), most * np.sqrt((shares * shares).sum(axis=1)), np.inf)
    return found


def search_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> list[tuple[int, int, float]]:
    """(row of the query, id, distance) of the k nearest in a block for each query.

    The distance of the codes' vectors differs from the true one by the two left-out lengths at
    most. Per tile, an integer product gives all code distances; pairs whose lower bound exceeds
    the k-th smallest upper bound (or what the heap holds already) are passed over; the rest are
    computed on the vectors themselves and kept in a heap of k. Bounds are taken on vectors divided by
    a power of two near their largest component, so that squares neither overflow nor count as zero
    unnoticed.
    """
    largest = max((float(np.abs(x).max()) for x in (queries, vectors) if x.size), default=0.0)
    shrink = int(np.frexp(largest)[1])
    original, queries = queries, np.ldexp(queries, -shrink)
    kind = np.float32 if queries.shape[1] <= _SINGLE_PRECISION else np.float64
    qc, qs, qe = quantise(queries)
    q_product, q_square = qc.astype(kind), (qc.astype(np.float64) ** 2).sum(axis=1) * qs**2
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    for at in range(0, len(ids), TILE_ROWS):
        tile, tile_ids = vectors[at : at + TILE_ROWS], ids[at : at + TILE_ROWS]
        c, s, e = quantise(np.ldexp(tile, -shrink))
        square = (c.astype(np.float64) ** 2).sum(axis=1) * s**2
        dots = (q_product @ c.astype(kind).T).astype(np.float64) * qs[:, None] * s[None, :]
        squares = q_square[:, None] + square[None, :]
        near = np.sqrt(np.maximum(squares - 2 * dots, 0))
        room = qe[:, None] + e[None, :] + _SLACK * np.sqrt(squares) + _LEAST
        own = tile_ids[None, :] == query_ids[:, None]
        upper = np.where(own, np.inf, near + room)
        lower = np.where(own, np.inf, near - room)
        if upper.shape[1] > k:
            bound = np.partition(upper, k - 1, axis=1)[:, k - 1]
        else:
            bound = np.full(len(query_ids), np.inf)
        for row, heap in enumerate(heaps):
            held = np.ldexp(-heap[0][0], -shrink) * (1 + _SLACK) if len(heap) == k else np.inf
            left = np.flatnonzero(~(lower[row] > min(bound[row], held)) & ~own[row])
            if not len(left):
                continue
            for distance, other in zip(exact(original[row], tile[left]).tolist(), tile_ids[left].tolist()):
                item = (-distance, -other)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
    return [(row, -other, -distance) for row, heap in enumerate(heaps) for distance, other in heap]


def nearest(
    df: DataFrame, key: str, vector: str, is_query: Column, k: int,
    query_rows: int = QUERY_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` nearest other rows of each query: query_id, rank (from 1), ``key``, score.

    Queries and candidates are dealt into blocks by a hash, as many as keep a block small, and each
    block of queries meets each block of candidates in one task (a cogroup on both block numbers).
    A block's heaps are merged by a ranked window that Spark limits to k rows before its shuffle.

    Nearness is the smallest Euclidean distance, ties to the smaller key. Vectors that are null,
    zero or hold a null or non-finite component take no part, nor do rows without key. Only vectors
    of one length are compared. A row that repeats key and vector counts once; rows with the key of
    the query are its own and no candidates. An id with several vectors is a candidate with each of
    them, and as a query gets the k nearest to any of them. Fewer than k candidates give them all.
    """
    rows = df.select(
        F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("is_query")
    )
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).dropDuplicates(["id", "v"])
    rows = rows.withColumn("dim", F.size("v"))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("q")).first()
    n_blocks = max(1, -(-sizes["n"] // block_rows))
    n_queries = max(1, -(-sizes["q"] // query_rows))
    spread = F.xxhash64("id", "v")
    queries = rows.where("is_query").select(
        "id", "v", "dim",
        F.pmod(spread, F.lit(n_queries)).alias("qb"),
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("cb"),
    )
    candidates = rows.select(
        "id", "v", "dim",
        F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("qb"),
        F.pmod(spread, F.lit(n_blocks)).cast("int").alias("cb"),
    )

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            ids, others = (t.column("id").to_numpy() for t in (left, right))
            a, b = (t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim) for t in (left, right))
            found = [(int(ids[r]), o, d) for r, o, d in search_block(ids, a, others, b, k)]
        return pa.table(
            {
                "query_id": pa.array([f[0] for f in found], pa.int64()),
                "id": pa.array([f[1] for f in found], pa.int64()),
                "score": pa.array([f[2] for f in found], pa.float64()),
            }
        )

    keys = ["dim", "qb", "cb"]
    met = (
        queries.withColumn("qb", F.col("qb").cast("int")).groupBy(*keys)
        .cogroup(candidates.groupBy(*keys))
        .applyInArrow(work, "query_id bigint, id bigint, score double")
    )
    best = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
