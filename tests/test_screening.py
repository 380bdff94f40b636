import datetime as dt

import numpy as np
import pytest

from riskweave.operators import profiles as pf
from riskweave.sources import tables as src


@pytest.mark.parametrize("seed", range(3))
def test_screening_against_numpy(spark, seed):
    random = np.random.default_rng(seed)
    base = random.normal(size=200)
    columns = {f"x{i}": base + random.normal(size=200) * scale for i, scale in enumerate((0.05, 0.2, 0.3, 0.4, 2))}
    columns["y"] = base + random.normal(size=200)
    rows = list(zip(*(v.tolist() for v in columns.values())))
    df = spark.createDataFrame(rows, list(columns)).selectExpr(
        "*", "if(x0 > 0.8, x0, null) AS sparse", "cast(null AS double) AS none", "1.0 AS same")
    names = [f"x{i}" for i in range(5)]
    r = np.corrcoef(np.array(list(columns.values())))
    kept = []
    for i in sorted(range(5), key=lambda i: (-abs(r[i, 5]), names[i])):
        if all(abs(r[i, j]) <= 0.95 for j in kept):
            kept.append(i)
    expected = {n: None if i in kept else "correlated" for i, n in enumerate(names)}
    expected |= {"sparse": "nulls", "none": "nulls", "same": "near constant"}
    found = pf.screening(df, [*names, "sparse", "none", "same"], "y").collect()
    assert {f.feature: f.reason for f in found} == expected
    assert pf.screening(df.where("x0 > 100"), names, "y").count() in (0, 5)


def test_purge_removes_whole_periods_only(spark, tmp_path):
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(days=n) for n in range(40)]
    df = spark.createDataFrame([(d,) for d in days], "ts timestamp")
    for period, kept in (("day", 25), ("week", 26), ("month", 40)):
        folder = str(tmp_path / period)
        src.export_by_period(df, folder, "ts", period=period)
        (tmp_path / period / "notes").mkdir()
        src.purge_periods(spark, folder, dt.date(2024, 7, 16), 6, period)
        assert spark.read.parquet(*[str(p) for p in (tmp_path / period).glob(f"{period}=*")]).count() == kept
        assert (tmp_path / period / "notes").is_dir()
