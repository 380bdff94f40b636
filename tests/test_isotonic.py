"""The fit by ranges against the formula of largest least means."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import isotonic


def by_hand(rows):
    """Fitted value per distinct score."""
    scores = sorted({x for x, _, w in rows if w > 0})
    y = [sum(w * y for x, y, w in rows if x == s) for s in scores]
    weight = [sum(w for x, _, w in rows if x == s) for s in scores]

    def mean(j, k):
        return sum(y[j : k + 1]) / sum(weight[j : k + 1])

    n = len(scores)
    return {s: max(min(mean(j, k) for k in range(i, n)) for j in range(i + 1)) for i, s in enumerate(scores)}


def random_rows(kind):
    rnd = random.Random(kind)
    x = [rnd.randint(0, 40) / 10 for _ in range(150)]
    chance = {"noise": lambda v: 0.5, "rising": lambda v: v / 4, "falling": lambda v: 1 - v / 4, "saw": lambda v: v % 1}[kind]
    rows = [(v, float(rnd.random() < chance(v)), rnd.choice([1.0, 2.0, 0.5])) for v in x]
    return rows + [(2.0, 1.0, 1.0)] * 60 + [(9.0, 0.0, 30.0)] * (kind == "saw")


@pytest.mark.parametrize("range_points", [1, 4, 200_000])
@pytest.mark.parametrize("kind", ["noise", "rising", "falling", "saw"])
def test_fit_by_ranges(spark, kind, range_points):
    rows = random_rows(kind)
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0), (1.0, None, 1.0), (1.0, 1.0, 0.0)], "x double, y double, w double")
    pools = isotonic.fitted(df, "y", "x", F.col("w"), range_points).toPandas().sort_values("low")
    want = by_hand(rows)
    got = {s: v for s in want for v in pools.loc[(pools.low <= s) & (s <= pools.high), "value"]}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)
    assert (np.diff(pools["value"]) > -1e-12).all()
    assert abs((pools["value"] * pools["weight"]).sum() - sum(y * w for _, y, w in rows)) < 1e-9


def test_a_large_pool_is_no_task_of_its_own(spark):
    falling = spark.range(2_000).select(F.col("id").cast("double").alias("x"), (1 - F.col("id") / 2_000).alias("y"))
    pools = isotonic.fitted(falling, "y", "x", range_points=50).collect()
    assert [(p["low"], p["high"]) for p in pools] == [(0.0, 1_999.0)]


def test_values_between_and_beyond_pools(spark):
    rows = random_rows("rising")
    df = spark.createDataFrame(rows, "x double, y double, w double")
    pools = isotonic.fitted(df, "y", "x", F.col("w"))
    asked = [(n, x) for n, x in enumerate([-5.0, 0.0, 0.05, 1.234, 2.0, 2.0, 3.999, 7.5, None, float("nan")])]
    got = {r["id"]: r["calibrated"] for r in isotonic.applied(pools, spark.createDataFrame(asked, "id int, s double"), "s").collect()}
    ends = sorted({(e, r["value"]) for r in pools.collect() for e in (r["low"], r["high"])})
    want = np.interp([x for _, x in asked[:-2]], *zip(*ends))
    assert len(got) == len(asked) and got[8] is None and got[9] is None
    assert np.allclose([got[n] for n in range(len(want))], want, atol=1e-12)


def test_no_rows_to_learn_from(spark):
    df = spark.createDataFrame([(None, 1.0)], "x double, y double")
    pools = isotonic.fitted(df, "y", "x")
    assert pools.collect() == []
    assert isotonic.applied(pools, spark.createDataFrame([(1, 0.5)], "id int, s double"), "s").first()["calibrated"] is None
