"""Running totals, exact quantiles and neighbours over a global order.

A plain window ordered by a value puts the whole feature into one task. Here the rows are
first summed per distinct value (so one hot value is one row), then cut into value ranges.
Each range is ordered on its own and shifted by the total of the ranges before it. The cut
points only balance the work; any cut points give the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def running_totals(
    df: DataFrame,
    value: str,
    totals: Sequence[str],
    by: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Add ``cum_<t>`` and ``all_<t>`` for each total, over ``value`` ascending within ``by``.

    ``df`` must hold one row per (by, value). The values are cut once for the whole table, into as
    many ranges as the session has shuffle partitions. The rows of a group in one range are no more
    than all rows of the range, so a hot group is spread like the table, and a small group costs no
    more than its rows.
    """
    by = list(by)
    if ranges is None:
        ranges = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10 * ranges))
    placed = df.withColumn("_cuts", cuts.scalar()).select(
        *df.columns, _cuts_below(F.col("_cuts"), value, ranges).alias("_range")
    )
    sums = placed.groupBy(*by, "_range").agg(*[F.sum(t).alias(f"_s_{t}") for t in totals])
    group = Window.partitionBy(*by)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *by,
        "_range",
        *[F.coalesce(F.sum(f"_s_{t}").over(before), F.lit(0)).alias(f"_b_{t}") for t in totals],
        *[F.sum(f"_s_{t}").over(group).alias(f"all_{t}") for t in totals],
    )
    inside = Window.partitionBy(*by, "_range").orderBy(value)
    joined = _null_safe_join(placed, offsets, [*by, "_range"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_b_{t}") + F.sum(t).over(inside)).alias(f"cum_{t}") for t in totals],
        *[f"all_{t}" for t in totals],
    )


def _cuts_below(cuts: Column, value: str, most: int) -> Column:
    """How many of the ascending ``cuts`` lie below ``value``, found by halving."""
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(most.bit_length()))])

    def halve(place: Column, step: Column) -> Column:
        further = place + step
        return F.when(F.get(cuts, further - 1) < F.col(value), further).otherwise(place)

    return F.aggregate(steps, F.lit(0), halve)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` where NULL matches NULL, keeping one copy of each key."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    on = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = test if on is None else on & test
    return left.join(renamed, on).drop(*[f"_r_{k}" for k in keys])


def value_counts(
    df: DataFrame, value: Column | str, by: Sequence[str] = (), weight: Column | None = None
) -> DataFrame:
    """One row per (by, value) with its count; the map side combines hot values."""
    value = F.col(value) if isinstance(value, str) else value
    weight = F.lit(1) if weight is None else weight
    return (
        df.withColumn("_value", value)
        .where(F.col("_value").isNotNull())
        .groupBy(*by, "_value")
        .agg(F.sum(weight).cast("long").alias("n"))
    )


def exact_quantiles(
    df: DataFrame, value: Column | str, quantiles: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolated quantiles per group, one column per name."""
    ranked = running_totals(value_counts(df, value, by), "_value", ["n"], by)
    aggs = []
    for name, q in quantiles.items():
        position = F.lit(float(q)) * (F.col("all_n") - 1)
        aggs += [
            F.min(F.when(F.col("cum_n") > F.floor(position), F.col("_value"))).alias(f"_l_{name}"),
            F.min(F.when(F.col("cum_n") > F.ceil(position), F.col("_value"))).alias(f"_h_{name}"),
        ]
    found = ranked.groupBy(*by).agg(F.max("all_n").alias("n_values"), *aggs)
    out = [*by, "n_values"]
    for name, q in quantiles.items():
        position = F.lit(float(q)) * (F.col("n_values") - 1)
        low, high = F.col(f"_l_{name}").cast("double"), F.col(f"_h_{name}").cast("double")
        out.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return found.select(*out)


def chains(
    df: DataFrame, by: Sequence[str], time: str, gap: float, slot: float, name: str = "chain"
) -> DataFrame:
    """Label runs of rows whose neighbours in ``time`` are at most ``gap`` apart.

    The label is the time the run starts. Neighbours are found inside fixed time slots and
    carried over slot borders through one small row per slot, so a long sequence is spread
    over many tasks.
    """
    by = list(by)
    slotted = df.withColumn("_slot", F.floor(F.col(time) / F.lit(slot)).cast("long"))
    inside = Window.partitionBy(*by, "_slot").orderBy(time)
    across = Window.partitionBy(*by).orderBy("_slot")
    last_of_slot = slotted.groupBy(*by, "_slot").agg(F.max(time).alias("_last"))
    carried = last_of_slot.select(*by, "_slot", F.lag("_last").over(across).alias("_carry"))
    marked = slotted.join(carried, [*by, "_slot"]).withColumn(
        "_previous", F.coalesce(F.lag(time).over(inside), F.col("_carry"))
    )
    starts = F.when(
        F.col("_previous").isNull() | (F.col(time) - F.col("_previous") > gap), F.col(time)
    )
    marked = marked.withColumn("_start", starts).drop("_carry")
    slot_start = marked.groupBy(*by, "_slot").agg(F.max("_start").alias("_slot_start"))
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    opened = slot_start.select(
        *by, "_slot", F.last("_slot_start", ignorenulls=True).over(earlier).alias("_open")
    )
    so_far = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.join(opened, [*by, "_slot"]).select(
        *df.columns,
        F.coalesce(F.max("_start").over(so_far), F.col("_open")).alias(name),
    )
