"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.ranks import bucket_of, running_starts

#: Hexadecimal digits of a digest that make the hash of a key and a shard (52 bits: exact in a double).
HASH_DIGITS = 13


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest score ``-weight / ln(u)`` for this key, ``u`` being a hash of both.

    A shard's scores depend on nothing but the key, its own number and its own weight. A further
    shard therefore takes keys only into itself, and a changed weight moves keys only to or from
    that shard. Each shard gets keys in proportion to its weight. A null key hashes as the empty
    text; equal scores go to the smaller shard.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be a non-empty list of positive numbers")
    name = F.coalesce(key.cast("string"), F.lit(""))
    shards = F.array(
        *[F.struct(F.lit(n).alias("shard"), F.lit(float(w)).alias("weight")) for n, w in enumerate(weights)]
    )

    def score(s: Column) -> Column:
        digest = F.md5(F.concat_ws("#", name, s["shard"].cast("string")))
        whole = F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("double")
        u = (whole + 0.5) / float(16**HASH_DIGITS)
        return F.struct((-s["weight"] / F.ln(u)).alias("score"), (-s["shard"]).alias("other"))

    return (-F.array_max(F.transform(shards, score))["other"]).cast("int")


def with_shard(df: DataFrame, key: str, weights: Sequence[float], name: str = "shard") -> DataFrame:
    """All rows and columns of ``df`` with their shard; no shuffle. ``name`` replaces an older column."""
    return df.withColumn(name, shard_of(F.col(key), weights))


def shard_slots(
    df: DataFrame, key: str, weights: Sequence[float], describe: dict[str, Column], digits: int = 2
) -> DataFrame:
    """One row per row of ``df``: key, described columns, shard, and a gapless slot from 0 in its shard.

    ``describe`` names narrow columns to compute from a row (sizes, checksums); wider columns are
    not moved. Rows that agree in key and description are counted before the shuffle and spread
    out again afterwards, so a key repeated any number of times is one row on its way. Slots
    follow a digest of the key, then key and description; a shard's rows are ordered in
    ``16 ** digits`` parts. A null key is a key like any other. An empty table gives no rows.
    """
    taken = {key, *describe}
    if clash := taken & {"shard", "slot", "_bucket", "_copies", "_start"}:
        raise ValueError(f"names in use: {sorted(clash)}")
    distinct = (
        df.select(F.col(key), *[c.alias(n) for n, c in describe.items()])
        .groupBy(key, *describe)
        .agg(F.count(F.lit(1)).alias("_copies"))
    )
    placed = distinct.select(
        "*", shard_of(F.col(key), weights).alias("shard"), bucket_of(F.col(key), digits).alias("_bucket")
    )
    started = running_starts(placed, "shard", "_bucket", [key, *describe], "_copies", "_start")
    slots = F.explode(F.sequence("_start", F.col("_start") + F.col("_copies") - 1))
    return started.select(key, *describe, "shard", slots.alias("slot"))
