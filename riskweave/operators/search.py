"""Exact cosine search that skips blocks of vectors by pivots and the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.session import written

#: Bytes of vectors (in doubles) in a block of the corpus and in a block of queries, on average at most.
BLOCK_BYTES, QUERY_BYTES = 4 << 20, 8 << 20
#: Blocks of the corpus that meet a block of queries in one task, on average at most.
BLOCKS_PER_TASK = 16
#: Pairs of a block of queries and a slot of corpus blocks per core, where there are blocks enough.
TASKS_PER_CORE = 2
#: Pivots are fitted on a sample of at most this many bytes, and all pivots take at most PIVOT_BYTES.
SAMPLE_BYTES = 16 << 20
PIVOT_BYTES = 4 << 20
MOST_PIVOTS = 1_024
PIVOT_ROUNDS = 8
#: Vectors of a cell are cut into rings of this width by their distance to the pivot.
RING = 0.125
#: Scores computed at once inside a task, for this many queries at a time.
TILE_CELLS, TILE_QUERIES = 1 << 19, 512
#: With more pairs of a tile than one in this many left by the bounds, all are computed in doubles.
DENSE = 64
SCORE_DIGITS = 6
#: Scores are compared after rounding; bounds give way by more than rounding can add.
_SLACK = 2 * 10.0**-SCORE_DIGITS

_HITS = pa.schema([("block", pa.int64()), ("query_id", pa.int64()), ("corpus_id", pa.int64()), ("score", pa.float64())])


def _unit(vectors: pd.Series | np.ndarray) -> np.ndarray:
    """Rows of length one in doubles; a zero vector stays zero."""
    matrix = np.vstack(vectors.to_numpy() if isinstance(vectors, pd.Series) else vectors).astype(np.float64)
    length = np.sqrt((matrix * matrix).sum(axis=1))
    return matrix / np.where(length > 0, length, 1.0)[:, None]


def _true_cells(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the true cells, read eight cells at a time where most are false."""
    if mask.size % 8:
        return np.nonzero(mask)
    eights = mask.reshape(-1, 8)
    some = np.flatnonzero(eights.view(np.uint64).ravel())
    at, inner = np.nonzero(eights[some])
    return np.divmod(some[at] * 8 + inner, mask.shape[1])


class _Best:
    """The k best corpus ids per query seen so far, by rounded score, then smallest id.

    ``at_least`` also keeps every id of that score or more. A product in single precision bounds all
    scores of a tile; pairs that cannot be among the best of what is held are passed over, and the
    rest are computed in doubles, so the bounds decide the work and never the hits.
    """

    def __init__(
        self, query_ids: np.ndarray, matrix: np.ndarray, k: int, skip_self: bool, at_least: float | None
    ):
        self.query_ids, self.matrix, self.k, self.skip_self = query_ids, matrix, k, skip_self
        self.at_least, self.above = at_least, []
        self.single = matrix.astype(np.float32)
        self.scores = np.full((len(query_ids), k), -np.inf)
        self.ids = np.zeros((len(query_ids), k), dtype=np.int64)
        # A single-precision product of unit vectors is off by less than this.
        self.room = (matrix.shape[1] + 8) * 2.0**-23 + _SLACK

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        single = vectors.astype(np.float32)
        own_row, own_column = self._own(ids)
        for top in range(0, len(self.query_ids), TILE_QUERIES):
            rows = slice(top, min(top + TILE_QUERIES, len(self.query_ids)))
            width = max(1, TILE_CELLS // (rows.stop - top))
            here = (own_row >= top) & (own_row < rows.stop)
            row, column = own_row[here] - top, own_column[here]
            for at in range(0, len(ids), width):
                inside = (column >= at) & (column < at + width)
                columns = slice(at, min(at + width, len(ids)))
                self._add_tile(rows, ids[columns], vectors[columns], single[columns], row[inside], column[inside] - at)

    def _own(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of the query, column) of the pairs of one id with itself; ``ids`` are in order."""
        if not self.skip_self:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        first = np.searchsorted(ids, self.query_ids, "left")
        count = np.searchsorted(ids, self.query_ids, "right") - first
        row = np.repeat(np.arange(len(count)), count)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]

    def _add_tile(
        self, rows: slice, ids: np.ndarray, vectors: np.ndarray, single: np.ndarray,
        own_row: np.ndarray, own_column: np.ndarray,
    ) -> None:
        held = self.scores[rows]
        rough = self.single[rows] @ single.T
        rough[own_row, own_column] = -np.inf
        need = held[:, -1].copy()
        unfilled = np.flatnonzero(need == -np.inf)
        if len(unfilled) and len(ids) > self.k:
            need[unfilled] = np.partition(rough[unfilled], len(ids) - self.k, axis=1)[:, len(ids) - self.k] - self.room
        if self.at_least is not None:
            need = np.minimum(need, self.at_least)
        least = np.nextafter((need - self.room).astype(np.float32), np.float32(-np.inf))
        # A pair of one id with itself has a rough score below every bound.
        row, column = _true_cells(rough >= np.maximum(least, np.finfo(np.float32).min)[:, None])
        if len(row) * DENSE > rough.size:
            every = np.round(self.matrix[rows] @ vectors.T, SCORE_DIGITS)
            scores = every[row, column]
        else:
            scores = np.round(np.einsum("ij,ij->i", self.matrix[rows][row], vectors[column]), SCORE_DIGITS)
        if self.at_least is not None:
            passed = scores >= self.at_least
            self.above.append((self.query_ids[rows][row[passed]], ids[column[passed]], scores[passed]))
        last, last_id = held[row, -1], self.ids[rows][row, -1]
        better = (scores > last) | ((scores == last) & (ids[column] < last_id))
        if better.any():
            self._keep(rows.start + row[better], ids[column[better]], scores[better])

    def _keep(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge new hits into the k best of their rows."""
        touched = np.unique(row)
        row = np.concatenate([np.repeat(touched, self.k), row])
        ids = np.concatenate([self.ids[touched].ravel(), ids])
        scores = np.concatenate([self.scores[touched].ravel(), scores])
        order = np.lexsort((ids, -scores, row))
        row, ids, scores = row[order], ids[order], scores[order]
        starts = np.searchsorted(row, touched)
        place = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
        kept = place < self.k
        self.scores[touched] = scores[kept].reshape(-1, self.k)
        self.ids[touched] = ids[kept].reshape(-1, self.k)

    def frame(self) -> pd.DataFrame:
        kept = np.isfinite(self.scores)
        rows = np.broadcast_to(self.query_ids[:, None], self.scores.shape)
        found = [(rows[kept], self.ids[kept], self.scores[kept]), *self.above]
        frame = pd.DataFrame(
            {c: np.concatenate([f[i] for f in found]) for i, c in enumerate(("query_id", "corpus_id", "score"))}
        )
        return frame if self.at_least is None else frame.drop_duplicates(["query_id", "corpus_id"])


# --------------------------------------------------------------------------- pivots and blocks


def _sample(corpus: DataFrame, width: int) -> np.ndarray:
    """Unit vectors of a bounded sample of the corpus, the same ones on every run."""
    rows = max(MOST_PIVOTS, SAMPLE_BYTES // (8 * width))
    found = corpus.orderBy(F.xxhash64("id"), "id").limit(rows).select("v").toPandas()["v"]
    units = _unit(found) if len(found) else np.empty((0, width))
    return units[np.isfinite(units).all(axis=1)]


def _pivots(points: np.ndarray, most: int) -> np.ndarray:
    """Centres of a k-means fit on the sample; any centres give right results."""
    centres = points[:: max(1, len(points) // most)][:most].copy()
    for _ in range(PIVOT_ROUNDS):
        nearest = _distances(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _placed(df: DataFrame, pivots: np.ndarray, width: float) -> DataFrame:
    """Vectors with the nearest pivot of their unit vector, its distance and the ring of that distance.

    A vector with a component that is no finite number has no score with any other and is left out.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                vectors = _unit(frame["v"])
                usable = np.isfinite(vectors).all(axis=1)
                frame, vectors = frame[usable], vectors[usable]
                distances = _distances(vectors, pivots)
                cell = distances.argmin(axis=1)
                away = distances[np.arange(len(cell)), cell]
                yield pd.DataFrame(
                    {"id": frame["id"], "v": frame["v"], "cell": cell, "away": away, "ring": np.floor(away / width).astype(int)}
                )

    return df.mapInPandas(work, f"id long, v {df.schema['v'].dataType.simpleString()}, cell int, away double, ring int")


@dataclass
class _Side:
    """Blocks of one side, and for each cell and ring its number of blocks, rows and distances."""

    blocks: DataFrame
    rings: pd.DataFrame


def _side(df: DataFrame, pivots: np.ndarray, ring_width: float, block_rows: int, name: str) -> _Side:
    """Cut a side into blocks of one cell and ring; a large ring is dealt over several blocks.

    The table of rings has a row per pivot and ring at most, whatever the number of vectors.
    """
    placed = written(_placed(df, pivots, ring_width), f"{name}-placed")
    ring = ["cell", "ring"]
    sizes = placed.groupBy(*ring).agg(
        F.count(F.lit(1)).alias("n"), F.min("away").alias("near"), F.max("away").alias("far")
    ).withColumn("salts", F.ceil(F.col("n") / block_rows).cast("int"))
    rings = sizes.orderBy(*ring).toPandas()
    few = df.sparkSession.createDataFrame(
        list(zip(*(rings[c].tolist() for c in ("cell", "ring", "salts")))), "cell int, ring int, salts int"
    )
    salt = F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")
    blocks = written(
        placed.join(F.broadcast(few), ring)
        .groupBy(*ring, salt.alias("salt"))
        .agg(F.collect_list(F.struct("id", "v")).alias("rows"), F.min("away").alias("near"), F.max("away").alias("far"))
        .select(
            *ring, "salt", "near", "far", F.size("rows").alias("n"), F.col("rows.id").alias("ids"),
            F.flatten("rows.v").alias("values"), F.monotonically_increasing_id().alias("block"),
        ),
        f"{name}-blocks",
    )
    return _Side(blocks, rings)


# ------------------------------------------------------------------------------ pairs of blocks


class _Bounds:
    """Lower bounds of the distance between a block of queries and the rings of the corpus."""

    def __init__(self, asked: np.ndarray, pivots: np.ndarray, rings: pd.DataFrame, enough: int):
        self.apart = _distances(asked, pivots)
        self.cell, self.ring, self.salts = (rings[c].to_numpy() for c in ("cell", "ring", "salts"))
        self.near, self.far = rings["near"].to_numpy(), rings["far"].to_numpy()
        self.rows_of_block = rings["n"].to_numpy() // np.maximum(1, self.salts)
        self.enough = enough

    def lower(self, cell: int, near: float, far: float) -> np.ndarray:
        """For a query ``near`` to ``far`` away from pivot ``cell``, and each ring of the corpus.

        Both pivots give a bound: the query's distance to the ring's pivot differs from the pivots'
        distance by ``far`` at most, and so for the ring's vectors and the query's pivot.
        """
        apart = self.apart[cell, self.cell]
        bounds = (
            np.maximum(0.0, apart - far) - self.far, self.near - (apart + far),
            np.maximum(0.0, apart - self.far) - far, near - (apart + self.far),
        )
        return np.maximum(0.0, np.max(bounds, axis=0))

    def first(self, cell: int, near: float, far: float) -> np.ndarray:
        """The closest rings that together hold enough rows for each query to find its k best."""
        order = np.lexsort((self.apart[cell, self.cell], self.lower(cell, near, far)))
        have = np.cumsum(self.rows_of_block[order])
        return order[: int(np.searchsorted(have, self.enough)) + 1]

    def rest(self, cell: int, near: float, far: float, need: float) -> np.ndarray:
        """Rings that may hold a score of ``need`` or more."""
        return np.flatnonzero(1 - self.lower(cell, near, far) ** 2 / 2 + _SLACK >= need)


def _first_pairs(blocks: DataFrame, bounds: _Bounds) -> DataFrame:
    """Each query block with the first block of its closest rings."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                found = bounds.first(row.cell, row.near, row.far)
                yield pd.DataFrame({"block": row.block, "cell": bounds.cell[found], "ring": bounds.ring[found], "salt": 0})

    narrow = blocks.select("block", "cell", "near", "far")
    return narrow.mapInPandas(work, "block long, cell int, ring int, salt int")


def _further_pairs(blocks: DataFrame, need: DataFrame, bounds: _Bounds) -> DataFrame:
    """Each query block with all other blocks of the rings that its bounds cannot rule out."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                met = set(bounds.first(row.cell, row.near, row.far).tolist())
                for at in bounds.rest(row.cell, row.near, row.far, row.need):
                    salts = np.arange(int(at in met), bounds.salts[at])
                    yield pd.DataFrame({"block": row.block, "cell": bounds.cell[at], "ring": bounds.ring[at], "salt": salts})

    narrow = blocks.select("block", "cell", "near", "far").join(need, "block")
    return narrow.mapInPandas(work, "block long, cell int, ring int, salt int")


def _matrix(table: pa.Table, row: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and unit vectors of a block."""
    ids = table.column("ids")[row].values.to_numpy()
    values = table.column("values")[row].values.to_numpy().reshape(len(ids), -1)
    return ids, _unit(values)


def _met(
    pairs: DataFrame, queries: _Side, corpus: _Side, k: int, skip_self: bool, at_least: float | None
) -> DataFrame:
    """The k best of each block of queries and each slot of corpus blocks, and what reaches ``at_least``.

    The blocks that a block of queries meets are dealt over slots. The queries go once to each slot in
    use, where they meet its blocks one after the other; a block of the corpus goes once to each block
    of queries that it meets.
    """

    def work(asked: pa.Table, met: pa.Table) -> pa.Table:
        found = []
        for row in range(asked.num_rows):
            best = _Best(*_matrix(asked, row), k, skip_self, at_least)
            for other in range(met.num_rows):
                best.add(*_matrix(met, other))
            found.append(best.frame().assign(block=asked.column("block")[row].as_py()))
        every = pd.concat(found) if found else pd.DataFrame(columns=_HITS.names)
        return pa.Table.from_pandas(every[_HITS.names], _HITS, preserve_index=False)

    place = ["cell", "ring", "salt"]
    n_corpus, n_queries = (int(side.rings["salts"].sum()) for side in (corpus, queries))
    tasks = TASKS_PER_CORE * pairs.sparkSession.sparkContext.defaultParallelism
    slots = max(1, -(-n_corpus // BLOCKS_PER_TASK), min(n_corpus, -(-tasks // max(1, n_queries))))
    dealt = written(pairs.withColumn("slot", F.pmod(F.xxhash64(*place), F.lit(slots))), "search-pairs")
    asked = dealt.select("block", "slot").distinct().join(queries.blocks.select("block", "ids", "values"), "block")
    met = dealt.join(corpus.blocks.select(*place, "ids", "values"), place).select(
        F.col("block").alias("met_block"), F.col("slot").alias("met_slot"), "ids", "values"
    )
    groups = asked.groupBy("block", "slot").cogroup(met.groupBy("met_block", "met_slot"))
    return groups.applyInArrow(work, "block long, query_id long, corpus_id long, score double")


@dataclass
class Search:
    """The blocks of a search, its first hits and the pairs of blocks that are left."""

    queries: _Side
    corpus: _Side
    first: DataFrame
    first_hits: DataFrame
    further: DataFrame

    def pairs_met(self) -> int:
        return self.first.count() + self.further.count()

    def pairs_in_all(self) -> int:
        return int(self.queries.rings["salts"].sum() * self.corpus.rings["salts"].sum())


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    kind = df.select(vector).schema[0].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    chosen = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"))
    return chosen.where(F.col("id").isNotNull() & F.col("v").isNotNull())


def prepared(
    queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, skip_self: bool = False,
    at_least: float | None = None, block_rows: int | None = None,
) -> Search:
    """Blocks, first hits, and the pairs of blocks that the bounds leave.

    ``block_rows`` sets the size of the blocks of both sides instead of their bytes.
    """
    kept, asked = _vectors(corpus, key, vector), _vectors(queries, key, vector)
    rows, width = kept.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    asked_rows, asked_width = (rows, width) if queries is corpus else asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = max(1, width or asked_width or 1)
    sizes = [block_rows or max(1, size // (8 * width)) for size in (BLOCK_BYTES, QUERY_BYTES)]
    most = max(1, min(MOST_PIVOTS, PIVOT_BYTES // (8 * width)))
    wanted = [max(1, min(most, n // size)) for n, size in zip((rows, asked_rows), sizes)]
    points = _sample(kept, width) if max(wanted) > 1 else np.empty((0, width))
    pivots, centres = (_pivots(points, n) if n > 1 and len(points) else np.zeros((1, width)) for n in wanted)
    there = _side(kept, pivots, RING, sizes[0], "search-corpus")
    # Queries are cut by cells alone: fewer, larger blocks carry the corpus to fewer places.
    here = _side(asked, centres, np.inf, sizes[1], "search-queries")
    bounds = _Bounds(centres, pivots, there.rings, 2 * (k + 1))
    first = _first_pairs(here.blocks, bounds)
    hits = written(_met(first, here, there, k, skip_self, at_least), "search-hits")
    # A block needs what its worst query has so far; a query with fewer than k hits needs all.
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_id")
    reached = (
        hits.withColumn("place", F.row_number().over(best)).where(F.col("place") == k)
        .groupBy("block").agg(F.min("score").alias("worst"), F.count(F.lit(1)).alias("n_full"))
    )
    worst = F.when(F.col("n_full") == F.col("n"), F.col("worst")).otherwise(-2.0)
    least = worst if at_least is None else F.least(worst, F.lit(float(at_least)))
    need = here.blocks.select("block", "n").join(reached, "block", "left").select("block", least.alias("need"))
    further = _further_pairs(here.blocks, need, bounds)
    return Search(here, there, first, hits, further)


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    key: str,
    vector: str,
    k: int,
    skip_self: bool = False,
    at_least: float | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Exact cosine hits: (query_id, corpus_id, score, rank), equal scores by smallest id.

    A query gets its ``k`` best and, with ``at_least``, every hit of that score or more. Vectors of one
    pivot and one ring around it form blocks of bounded size. Each block of queries first meets the
    closest blocks, which gives the score it needs; a block whose distance bound rules that score out
    is skipped, all others meet as matrix products. Pivots are fitted on a
    bounded sample and decide the work, never the hits. Vectors without any close ones (such as
    independent noise) leave no bound to skip by, and every pair of blocks meets. The hits are written,
    so that plans which read them several times search once.

    Rows without a key or vector, or with a component that is no finite number, take no part; a zero vector has score 0 with all. Keys are distinct
    and all vectors have one length.
    """
    search = prepared(queries, corpus, key, vector, k, skip_self, at_least, block_rows)
    more = _met(search.further, search.queries, search.corpus, k, skip_self, at_least)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_id")
    wanted = F.col("rank") <= k
    if at_least is not None:
        wanted = wanted | (F.col("score") >= at_least)
    hits = search.first_hits.unionByName(more).drop("block")
    return written(hits.withColumn("rank", F.row_number().over(order)).where(wanted), "search-ranked")
