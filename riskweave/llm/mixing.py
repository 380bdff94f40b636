"""Mixing sources to target weights by Pfair windows and earliest deadline first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.ranks import bucket_of, named, running_starts, unused
from riskweave.session import written

#: Documents of a block, the unit that is scheduled.
BLOCK_ROWS = 16

#: Earliest deadline first over one period, as one expression. ``counts`` has the blocks of each
#: source, ``slots`` their sum C. Block j of n lies in the window [j*C div n, ceil((j+1)*C/n)); slot
#: t goes to the block with the earliest deadline among those released (then the first source).
_SCHEDULE = """
aggregate(
  sequence(0, slots - 1),
  named_struct(
    'taken', transform(counts, n -> 0),
    'picks', cast(array() as array<struct<source: int, j: int, release: int, deadline: int>>)
  ),
  (state, t) -> transform(
    array(array_min(transform(
      filter(
        sequence(0, size(counts) - 1),
        s -> state.taken[s] < counts[s] and state.taken[s] * slots div counts[s] <= t
      ),
      s -> named_struct(
        'deadline', cast(((state.taken[s] + 1) * slots + counts[s] - 1) div counts[s] as int),
        'source', s,
        'j', state.taken[s],
        'release', cast(state.taken[s] * slots div counts[s] as int)
      )
    ))),
    p -> named_struct(
      'taken', transform(state.taken, (n, s) -> n + if(s = p.source, 1, 0)),
      'picks', concat(state.picks, array(named_struct(
        'source', p.source, 'j', p.j, 'release', p.release, 'deadline', p.deadline)))
    )
  )[0],
  state -> state.picks
)
"""


def weight_of(source: Column, weights: dict[str, int], other: int) -> Column:
    """The target weight of a source: listed, or the weight of all others."""
    if other < 1 or any(w < 1 for w in weights.values()):
        raise ValueError("weights are whole numbers from 1")
    chosen = F.lit(other)
    for name, weight in weights.items():
        chosen = F.when(source == name, F.lit(weight)).otherwise(chosen)
    return F.coalesce(chosen, F.lit(other)).cast("bigint")


def spans(sources: DataFrame) -> DataFrame:
    """Stretches of equal periods: first, stop, slots of a period, counts by source, start slot.

    ``sources`` has ``name``, ``weight`` and ``blocks``, a row per source (the target table, which
    must fit a row). In period m a source brings its weight in blocks, the rest in its last period,
    and then nothing. Periods differ only where a source ends.
    """
    one = sources.agg(F.array_sort(F.collect_list(F.struct("name", "weight", "blocks"))).alias("all"))
    one = one.select("all", F.expr(
        "array_sort(array_distinct(flatten(transform(all, s -> array(0, s.blocks div s.weight, s.blocks div s.weight + 1)))))"
    ).alias("cuts"))
    cut = one.where("size(cuts) > 0").select("all", F.expr(
        "explode(transform(slice(cuts, 1, size(cuts) - 1), (c, i) -> struct(c as first, cuts[i + 1] as stop)))"
    ).alias("span"))
    counted = cut.select("span.first", "span.stop", "all", F.expr(
        "transform(all, s -> cast(greatest(0, least(s.weight, s.blocks - span.first * s.weight)) as int))"
    ).alias("counts"))
    return counted.select(
        "first", "stop", "counts", F.expr("transform(all, s -> s.name)").alias("names"),
        F.expr("aggregate(counts, 0, (a, n) -> a + n)").alias("slots"),
        F.expr("aggregate(all, 0L, (a, s) -> a + least(s.blocks, first * s.weight))").alias("start"),
    ).where("slots > 0")


def schedule(sources: DataFrame) -> DataFrame:
    """A row per block of one period of each stretch: name, first, stop, j, slot within the period."""
    picked = spans(sources).withColumn("picks", F.expr(_SCHEDULE))
    return picked.select("first", "stop", "slots", "start", "names", F.posexplode("picks").alias("t", "pick")).select(
        F.expr("names[pick.source]").alias("name"), "first", "stop", "slots", "start", "t",
        F.col("pick.j").alias("j"), F.col("pick.release").alias("release"), F.col("pick.deadline").alias("deadline"),
    )


def mixed(
    df: DataFrame, key: str, source: str, weights: dict[str, int], other: int = 1,
    block_rows: int = BLOCK_ROWS, digits: int = 2,
) -> DataFrame:
    """One row per distinct (key, source): copies, block, window, slot and place.

    A source's rows are taken in the order of a digest of the key and cut into blocks of
    ``block_rows``. Block i of a source with weight w lies in period i div w; within the period it
    has a release slot and a deadline slot, and earliest deadline first gives each block a slot in
    its window. After any number of slots of a period each source is less than one block away from
    its share, and at the end of a period it has exactly its share. When a source ends, the others
    keep their weights among themselves. Nothing is dropped or repeated.

    A source that is null is a source of its own with the weight of all others. Rows repeating key
    and source are one row with ``copies`` > 1 that takes as many places as it has copies, from
    ``slot`` and ``place`` on. An empty table gives no rows.
    """
    rows = (
        df.groupBy(F.col(key).alias("_key"), F.col(source).cast("string").alias("_source"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("_name", named(F.col("_source")))
        .withColumn("_bucket", bucket_of(F.col("_key"), digits))
    )
    ranked = written(running_starts(rows, "_name", "_bucket", ["_key"], "copies", "_rank"), "mixing-ranks")
    totals = ranked.groupBy("_name", "_source").agg(F.sum("copies").alias("rows"))
    sources = written(
        totals.select(
            F.col("_name").alias("name"),
            weight_of(F.col("_source"), weights, other).alias("weight"),
            F.ceil(F.col("rows") / block_rows).cast("bigint").alias("blocks"),
        ),
        "mixing-sources",
    )
    plan = written(schedule(sources), "mixing-schedule")
    ends = plan.groupBy("name").agg(F.array_sort(F.collect_set("first")).alias("firsts"))
    known = sources.join(ends, "name").select(F.col("name").alias("_name"), "weight", "firsts")
    placed = ranked.join(known, "_name").select(
        "_key", "_source", "copies", "_name",
        F.expr(f"_rank div {block_rows}").alias("block"),
        (F.col("_rank") % block_rows).cast("int").alias("place"),
        F.expr(f"_rank div {block_rows} div weight").alias("period"),
        F.expr(f"cast((_rank div {block_rows}) % weight as int)").alias("j"),
        "firsts",
    ).withColumn("first", F.expr("array_max(filter(firsts, f -> f <= period))"))
    steps = plan.select(F.col("name").alias("_name"), "first", "j", "slots", "start", "t", "release", "deadline")
    begin = F.col("start") + (F.col("period") - F.col("first")) * F.col("slots")
    return placed.join(steps, ["_name", "first", "j"]).select(
        F.col("_key").alias(key), F.col("_source").alias(source), "copies", "block",
        (begin + F.col("release")).alias("release"),
        (begin + F.col("deadline")).alias("deadline"),
        (begin + F.col("t")).alias("slot"),
        "place",
    )


def in_mixed_order(
    df: DataFrame, key: str, source: str, weights: dict[str, int], other: int = 1, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """All rows and columns of ``df``, dealt and sorted by slot and place.

    Written out, the files in order and the rows in each file are the mixed sequence. Copies of a
    row stand together. Helper columns take names that ``df`` has not, so no column is replaced.
    """
    key_, source_, *sequence = unused(df, "_key", "_source", "_slot", "_place", "_row")
    slot_, place_, row_ = sequence
    order = mixed(df, key, source, weights, other, block_rows).select(
        F.col(key).alias(key_), F.col(source).alias(source_), F.col("slot").alias(slot_), F.col("place").alias(place_)
    )
    same = df[key].eqNullSafe(order[key_]) & df[source].cast("string").eqNullSafe(order[source_])
    rows = df.join(order, same).withColumn(row_, F.monotonically_increasing_id())
    return rows.repartitionByRange(*sequence).sortWithinPartitions(*sequence).select(*[df[c] for c in df.columns])
