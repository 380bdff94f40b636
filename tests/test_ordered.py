import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskweave.functions import stats
from riskweave.operators import drift, evaluation, profiles
from riskweave.operators.ordered import chains, exact_quantiles, running_totals, value_counts

rng = np.random.default_rng(7)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value and one group."""
    n = 3000
    g = np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abc"), n))
    x = np.where(rng.random(n) < 0.33, 5.0, np.round(rng.normal(0, 10, n), 2))
    pdf = pd.DataFrame({"g": g, "x": x, "y": rng.integers(0, 2, n)})
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_running_totals(spark, skewed):
    pdf, df = skewed
    got = running_totals(value_counts(df, "x", ["g"]), "_value", ["n"], ["g"], ranges=7).toPandas()
    want = pdf.groupby(["g", "x"]).size().rename("n").reset_index()
    want["cum_n"] = want.groupby("g")["n"].cumsum()
    merged = got.merge(want, left_on=["g", "_value"], right_on=["g", "x"])
    assert len(merged) == len(want)
    assert (merged.cum_n_x == merged.cum_n_y).all()
    whole = running_totals(value_counts(df, "x"), "_value", ["n"], ranges=3)
    assert whole.agg(F.max("cum_n")).first()[0] == len(pdf) == whole.first().all_n


def test_running_totals_with_null_group(spark):
    df = spark.createDataFrame([(None, 1.0, 2), (None, 2.0, 3), ("a", 1.0, 1)], "g string, v double, n long")
    got = {(r.g, r.v): (r.cum_n, r.all_n) for r in running_totals(df, "v", ["n"], ["g"]).collect()}
    assert got == {(None, 1.0): (2, 5), (None, 2.0): (5, 5), ("a", 1.0): (1, 1)}


def test_quantiles(spark, skewed):
    pdf, df = skewed
    points = {"p5": 0.05, "p50": 0.5, "p95": 0.95}
    got = {r.g: r for r in exact_quantiles(df, "x", points, ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        for name, q in points.items():
            assert got[g][name] == pytest.approx(np.quantile(part.x, q))


def test_chains(spark):
    for seed in range(3):
        r = np.random.default_rng(seed)
        t = np.sort(np.round(r.uniform(0, 400, 300), 1))
        df = spark.createDataFrame(pd.DataFrame({"k": "a", "t": t})).repartition(4)
        got = chains(df, ["k"], "t", 1.0, slot=10.0).orderBy("t").toPandas()
        start, want = t[0], []
        for before, now in zip([t[0], *t], t):
            start = now if now - before > 1.0 else start
            want.append(start)
        assert got.chain.tolist() == want


def ks_by_hand(a, b):
    grid = np.unique(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), grid, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), grid, side="right") / len(b)
    return np.abs(fa - fb).max()


def test_ks_against_numpy(spark, skewed):
    pdf, df = skewed
    sides = drift.two_sides(df.where("y = 1"), df.where("y = 0"))
    row = drift.ks_drift(sides, ["x"]).first()
    assert row.statistic == pytest.approx(
        ks_by_hand(pdf.x[pdf.y == 1].to_numpy(), pdf.x[pdf.y == 0].to_numpy())
    )
    shifted = drift.two_sides(df, df.withColumn("x", F.col("x") + 5))
    assert drift.ks_drift(shifted, ["x"]).first().drift == 1


def test_tail_probabilities(spark):
    assert stats._chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert stats._chi2_tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert stats._chi2_tail(11.070497693516351, 5) == pytest.approx(0.05)
    assert stats._chi2_tail(18.307038053275146, 10) == pytest.approx(0.05)
    p = spark.range(1).select(
        stats.ks_p_value(F.lit(0.1), F.lit(200.0), F.lit(200.0)).alias("p")
    ).first().p
    assert p == pytest.approx(0.27, abs=0.01)


def test_two_by_two_chi_square_takes_the_correction(spark):
    cells = [("a", 1, 10), ("a", 0, 20), ("b", 1, 30), ("b", 0, 25)]
    rows = [(v, s) for v, s, n in cells for _ in range(n)]
    df = spark.createDataFrame(rows, "v string, is_ref int")
    row = drift.chi2_drift(df, ["v"]).first()
    expected = 30 * 40 / 85  # every cell is this far from its expected count
    gap = abs(10 - expected) - 0.5
    by_hand = gap**2 * sum(85 / (r * c) for r in (30, 55) for c in (40, 45))
    assert (row.statistic, row.dof) == (pytest.approx(by_hand), 1)


def test_performance_against_pairs(spark, skewed):
    pdf, df = skewed
    pdf = pdf.assign(p=1 / (1 + np.exp(-pdf.x / 10)))
    scored = df.withColumn("p", 1 / (1 + F.exp(-F.col("x") / 10)))
    row = evaluation.performance(scored, "y", "p").first()
    pos, neg = pdf.p[pdf.y == 1].to_numpy(), pdf.p[pdf.y == 0].to_numpy()
    wins = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert row.auc == pytest.approx(wins)
    assert row.brier == pytest.approx(((pdf.p - pdf.y) ** 2).mean())
    assert row.ks == pytest.approx(ks_by_hand(pos, neg))


def test_variance_inflation(spark):
    a, b = rng.normal(size=400), rng.normal(size=400)
    pdf = pd.DataFrame({"a": a, "b": b, "c": a + b + rng.normal(size=400) / 10})
    got = {r.feature: r.vif for r in profiles.variance_inflation(spark.createDataFrame(pdf), list("abc")).collect()}
    want = np.diag(np.linalg.inv(np.corrcoef(pdf.to_numpy().T)))
    assert [got[c] for c in "abc"] == pytest.approx(want, rel=1e-6)


def test_alert_level(spark):
    for n, level in ((0, "green"), (1, "orange"), (5, "orange"), (6, "red")):
        df = spark.createDataFrame([(1 if i < n else 0,) for i in range(8)], "drift int")
        assert drift.alert_level(df).first().level == level
