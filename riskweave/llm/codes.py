"""Compression of vectors to short codes: exact integer Lloyd rounds over resident members.

A vector is cut into parts; every part position has a codebook of its own. The parts live in files of
their owners, named by position, entry and salt. In a round the owners update the entries from the
members they hold, find each member's nearest entry, and only the members whose entry changes go
through the next shuffle.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from riskweave.llm.ranks import unused
from riskweave.session import shared_folder, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Components become whole multiples of one over this.
SCALE = 1024
#: Members of one owner; an entry with more is dealt over several salts.
OWNER_ROWS = 4_096
#: Members whose distances to all entries are held at a time.
_STRIP = 4_096
#: Larger components have no exact 64-bit form after scaling.
LARGEST = 2.0**52

#: One list of entries per part position; an entry is a list of whole numbers.
Codebooks = list[list[list[int]]]

_MEMBERS = "row bigint, position int, part array<bigint>"


# ---------------------------------------------------------------------------------- in a task


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties: the lowest) and its squared distance, both exact.

    While all terms stay below 2**53, sums in doubles are exact and the products run as a matrix
    product; beyond, the same sums are taken in Python's whole numbers.
    """
    most = max((int(abs(x).max()) for x in (parts, entries) if x.size), default=0)
    exact = 4 * most * most * max(1, parts.shape[1]) < 2**53
    index = np.empty(len(parts), np.int64)
    squares = np.empty(len(parts), np.int64 if exact else object)
    table = entries.astype(np.float64 if exact else object)
    norms = (table * table).sum(axis=1) if parts.shape[1] else np.zeros(len(entries))
    for at in range(0, len(parts), _STRIP):
        x = parts[at : at + _STRIP].astype(table.dtype)
        own = (x * x).sum(axis=1) if parts.shape[1] else np.zeros(len(x))
        apart = norms[None, :] - 2 * (x @ table.T) if parts.shape[1] else np.zeros((len(x), len(entries)))
        best = apart.argmin(axis=1)
        index[at : at + _STRIP] = best
        squares[at : at + _STRIP] = own + apart[np.arange(len(x)), best]
    return index, squares


def _numbers(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _assigned(codebooks: Codebooks):
    """Adds to each member its nearest entry and the squared distance."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.array(entries, np.int64) for entries in codebooks]
        for batch in batches:
            position = batch.column("position").to_numpy()
            parts = _numbers(batch.column("part"))
            entry, squares = np.empty(len(position), np.int32), np.empty(len(position), object)
            for n in np.unique(position):
                rows = np.flatnonzero(position == n)
                entry[rows], squares[rows] = nearest_entries(parts[rows], tables[n])
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "position", "part")), pa.array(entry, pa.int32()),
                 pa.array([int(s) for s in squares], kind), batch.column("held")],
                ["row", "position", "part", "entry", "square", "held"],
            )

    return work


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count and componentwise sums of the members of each entry that a task holds."""
    held: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        position, entry = batch.column("position").to_numpy(), batch.column("entry").to_numpy()
        parts = _numbers(batch.column("part"))
        most = int(abs(parts).max()) if parts.size else 0
        if most * len(parts) >= 2**62:
            parts = parts.astype(object)
        order = np.lexsort((entry, position))
        p, e = position[order], entry[order]
        starts = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (e[1:] != e[:-1])])
        sums = np.add.reduceat(parts[order], starts, axis=0) if parts.shape[1] else np.zeros((len(starts), 0), np.int64)
        for at, n, total in zip(starts, np.diff(np.r_[starts, len(p)]), sums):
            count, before = held.get((int(p[at]), int(e[at])), (0, 0))
            held[int(p[at]), int(e[at])] = count + int(n), before + total.astype(object)
    kind = pa.list_(pa.decimal128(38, 0))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32()),
            pa.array([v[0] for v in held.values()], pa.int64()), pa.array([[int(x) for x in v[1]] for v in held.values()], kind),
        ],
        ["position", "entry", "size", "sums"],
    )


# -------------------------------------------------------------------------------------- rounds


def _updated(members: DataFrame, codebooks: Codebooks) -> Codebooks:
    """Entries moved to the floor of their members' mean. The driver gets one row per entry."""
    sums = members.select("position", "entry", "part").mapInArrow(
        _summed, "position int, entry int, size bigint, sums array<decimal(38,0)>"
    )
    # Tasks that hold members of one entry meet here: a row per task, entry and component.
    spread = sums.select("position", "entry", "size", F.posexplode("sums").alias("at", "part_sum"))
    totals = (
        spread.groupBy("position", "entry", "at")
        .agg(F.sum("part_sum").alias("total"), F.sum("size").alias("size"))
        .groupBy("position", "entry")
        .agg(F.sort_array(F.collect_list(F.struct("at", "total"))).alias("totals"), F.max("size").alias("size"))
    )
    moved = [list(entries) for entries in codebooks]
    for row in totals.toLocalIterator():
        moved[row["position"]][row["entry"]] = [int(t["total"]) // row["size"] for t in row["totals"]]
    return moved


def _migrated(movers: DataFrame, owner_rows: int) -> DataFrame:
    """Members that changed entry, at their new owners' and written there.

    An entry's members are dealt over as many salts as its number needs. The table of salts has one
    row per position and entry.
    """
    spark = movers.sparkSession
    sizes = movers.groupBy("position", "entry").agg(F.count(F.lit(1)).alias("n")).collect()
    salts = spark.createDataFrame(
        [Row(position=r["position"], entry=r["entry"], salts=-(-r["n"] // owner_rows)) for r in sizes],
        "position int, entry int, salts int",
    )
    dealt = movers.join(F.broadcast(salts), ["position", "entry"]).withColumn(
        "salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")
    )
    owned = dealt.repartition("position", "entry", "salt").select("row", "position", "part", "entry")
    return written(owned, "code-members")


def _reassigned(members: DataFrame, codebooks: Codebooks) -> tuple[DataFrame, DataFrame]:
    """The members that stay, in the files of their owners' tasks, and those that go."""
    spark = members.sparkSession
    found = members.withColumn("held", F.col("entry")).select("row", "position", "part", "held").mapInArrow(
        _assigned(codebooks), _MEMBERS + ", entry int, square decimal(38,0), held int"
    )
    path = os.path.join(shared_folder(spark), "tables", f"code-round-{uuid.uuid4().hex}")
    kept = found.withColumn("moved", ~F.col("entry").eqNullSafe(F.col("held"))).drop("held", "square")
    kept.write.partitionBy("moved").parquet(path)
    everything = spark.read.schema(_MEMBERS + ", entry int, moved boolean").parquet(path)
    return everything.where("not moved").drop("moved"), everything.where("moved").drop("moved")


def fitted(members: DataFrame, codebooks: Codebooks, rounds: int, owner_rows: int = OWNER_ROWS) -> tuple[Codebooks, DataFrame]:
    """Codebooks after ``rounds`` Lloyd rounds, and all members with their last entry and square.

    ``members`` has ``row``, ``position`` and ``part``. The first assignment gives every member an
    owner; each further one moves only those whose nearest entry is another. Every round's members
    are files in the shared folder: a lost executor repeats tasks of one round.
    """
    unowned = members.withColumn("entry", F.lit(None).cast("int"))
    stay, movers = _reassigned(unowned, codebooks)
    for n in range(rounds):
        resident = stay.unionByName(_migrated(movers, owner_rows))
        codebooks = _updated(resident, codebooks)
        if n + 1 < rounds:
            stay, movers = _reassigned(resident, codebooks)
    if not rounds:
        resident = members
    final = resident.select("row", "position", "part", F.lit(None).cast("int").alias("held")).mapInArrow(
        _assigned(codebooks), _MEMBERS + ", entry int, square decimal(38,0), held int"
    )
    return codebooks, final.select("row", "position", "entry", "square")


def codebooks_digest(codebooks: Codebooks) -> str:
    """SHA-256 of all components by part, entry and place, in decimal and joined by commas."""
    return hashlib.sha256(",".join(str(x) for part in codebooks for entry in part for x in entry).encode()).hexdigest()


# ------------------------------------------------------------------------------------ the operator


def usable(vector: str):
    """Whether a vector is there and all its components are finite."""
    value = F.col(vector)
    return value.isNotNull() & F.forall(
        value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    )


def compressed(
    df: DataFrame,
    key: str,
    vector: str,
    label: str | None = None,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    owner_rows: int = OWNER_ROWS,
) -> tuple[DataFrame, Codebooks]:
    """All usable rows and columns of ``df`` but ``vector`` with ``code`` and ``error``, and the codebooks.

    Component ``x`` becomes ``floor(1024 * x)``. A codebook starts as that part of the ``entries``
    rows of smallest ``key`` (rows that share one by their vectors, a null key last), fewer if the table
    has fewer. ``code`` is an array of entry numbers in part order, ``error`` the squared distances of
    all parts. With ``label`` a column ``label_error`` has the errors summed over equal labels; nulls
    are one label. Distances and means are whole numbers and exact.

    Rows whose vector is null or holds a null or non-finite component are dropped. Repeated rows each
    count. All vectors must have one length that ``parts`` divides, and components below 2**52 in size:
    other tables are refused with an error. Columns named like the new ones are replaced, other columns
    stay. An empty table gives no rows and empty codebooks.
    """
    number, numbers = unused(df, "_row", "_numbers")
    scaled = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * SCALE).cast("bigint"))
    large = F.exists(F.col(vector), lambda x: F.abs(x.cast("double")) >= LARGEST)
    new = {"code", "error", "label_error"}
    kept = written(
        df.where(usable(vector))
        .withColumn(number, F.monotonically_increasing_id())
        .withColumn(
            numbers,
            F.when(large, F.raise_error(F.lit("a component of 2**52 or more cannot be scaled to a whole number"))).otherwise(scaled),
        )
        .drop(vector),
        "code-vectors",
    )
    shortest, longest = kept.agg(F.min(F.size(numbers)), F.max(F.size(numbers))).first()
    others = [c for c in kept.columns if c not in (number, numbers) and c.lower() not in new]
    if shortest is None:
        none = kept.select(*others, F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("decimal(38,0)").alias("error"))
        return (none.withColumn("label_error", F.col("error")) if label else none), [[] for _ in range(parts)]
    if shortest != longest or longest % parts:
        raise ValueError(f"vectors have {shortest} to {longest} components, not one length that {parts} divides")
    size = longest // parts
    first = kept.orderBy(F.col(key).asc_nulls_last(), numbers).limit(entries).select(numbers).collect()
    codebooks = [[r[0][p * size : (p + 1) * size] for r in first] for p in range(parts)]
    pieces = F.array(*[
        F.struct(F.lit(p).alias("position"), F.slice(F.col(numbers), p * size + 1, size).alias("part")) for p in range(parts)
    ])
    members = kept.select(F.col(number).alias("row"), F.inline(pieces))
    codebooks, final = fitted(members, codebooks, rounds, owner_rows)
    coded = final.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("position", "entry"))).alias("found"), F.sum("square").alias("error")
    ).select(F.col("row").alias(number), F.col("found.entry").alias("code"), "error")
    done = kept.select(number, *others).join(coded, number).drop(number)
    if label:
        done = written(done, "code-rows")
        totals = written(done.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error")), "code-labels")
        done = done.join(totals, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
    return done, codebooks
