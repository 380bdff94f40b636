"""Monotone regression of a label on a score, fitted and applied by ranges of the score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.ordered import running_totals
from riskweave.session import written

#: Distinct scores that are pooled in one task.
RANGE_POINTS = 200_000
#: Two slopes closer than this, relative to the totals, count as one.
_CLOSE = 1e-13

_POOLS = "low double, high double, value double, weight double"


def _pooled(x: np.ndarray, weight: np.ndarray, total: np.ndarray) -> pd.DataFrame:
    """Pool adjacent violators over ascending scores."""
    first: list[int] = []
    sums: list[tuple[float, float]] = []
    for n in range(len(x)):
        first.append(n)
        sums.append((total[n], weight[n]))
        while len(sums) > 1 and sums[-2][0] * sums[-1][1] >= sums[-1][0] * sums[-2][1]:
            (s, w), _ = sums.pop(), first.pop()
            sums[-1] = (sums[-1][0] + s, sums[-1][1] + w)
    starts = np.array(first, dtype=int)
    last = np.append(starts[1:], len(x)) - 1
    s, w = np.array([p[0] for p in sums]), np.array([p[1] for p in sums])
    return pd.DataFrame({"low": x[starts], "high": x[last], "value": s / w, "weight": w})


def _lowest(corners: np.ndarray):
    """Of each range the number of points and the one furthest below the chord of its corners."""
    edges, heights = corners[:, 0], corners[:, 1]
    slopes = np.diff(heights) / np.diff(edges)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            place = np.searchsorted(edges, frame["cum_w"].to_numpy(), "left") - 1
            place = np.clip(place, 0, len(slopes) - 1)
            drop = frame["cum_s"] - heights[place] - slopes[place] * (frame["cum_w"] - edges[place])
            frame = frame.assign(place=place, drop=drop)
            best = frame.loc[frame.groupby("place")["drop"].idxmin(), ["place", "drop", "cum_w", "cum_s"]]
            yield best.assign(n=frame.groupby("place").size().reindex(best["place"]).to_numpy())

    return work


def _corners(points: DataFrame, range_points: int) -> tuple[np.ndarray, set[int]]:
    """Corners of the cumulative sums' lower hull that cut the scores into ranges, and flat ranges.

    The fitted values are the slopes of the lower hull of cumulative label sums over cumulative
    weights. The point furthest below a chord between two corners of the hull is a corner too, so a
    large range is cut there, and ranges between corners are fitted on their own without a merge. If no
    point lies below, the range is one pool, whatever its size. The driver gets a row per range.
    """
    end = points.agg(F.max(F.struct("cum_w", "cum_s")).alias("end")).first()["end"]
    corners = np.array([[0.0, 0.0], [end["cum_w"], end["cum_s"]]])
    scale = max(1.0, abs(end["cum_s"]), end["cum_w"])
    while True:
        best = points.mapInPandas(_lowest(corners), "place long, drop double, cum_w double, cum_s double, n long")
        found = best.groupBy("place").agg(
            F.sum("n").alias("n"), F.min(F.struct("drop", "cum_w", "cum_s")).alias("low")
        ).collect()
        large = [r for r in found if r["n"] > range_points]
        cut = [r["low"] for r in large if r["low"]["drop"] < -_CLOSE * scale]
        if not cut:
            return corners, {r["place"] for r in large}
        more = np.array([[c["cum_w"], c["cum_s"]] for c in cut])
        corners = np.vstack([corners, more])
        corners = corners[np.argsort(corners[:, 0], kind="stable")]


def fitted(
    df: DataFrame, label: str, score: str, weight: Column | None = None, range_points: int = RANGE_POINTS
) -> DataFrame:
    """``low, high, value, weight``: the pools of the ascending fit, each a stretch of scores.

    Labels and weights are summed per distinct score first. Rows without a score, a label or a
    positive weight take no part; no rows give no pools. No task holds more than ``range_points``
    distinct scores.
    """
    rows = df.select(
        F.col(score).cast("double").alias("x"), F.col(label).cast("double").alias("y"),
        (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"),
    ).where("x is not null and not isnan(x) and y is not null and w > 0")
    points = rows.groupBy("x").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("s"))
    points = written(running_totals(points, "x", ["w", "s"]).drop("all_w", "all_s"), "isotonic-points")
    if points.isEmpty():
        return points.sparkSession.createDataFrame([], _POOLS)
    corners, flat = _corners(points, range_points)
    edges = corners[:, 0]

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            place = np.clip(np.searchsorted(edges, frame["cum_w"].to_numpy(), "left") - 1, 0, len(edges) - 2)
            yield frame.assign(place=place, flat=np.isin(place, list(flat)))[["x", "w", "s", "place", "flat"]]

    placed = points.mapInPandas(numbered, "x double, w double, s double, place long, flat boolean")

    def pool(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("x")
        return _pooled(frame["x"].to_numpy(), frame["w"].to_numpy(), frame["s"].to_numpy())

    pools = placed.where("not flat").groupBy("place").applyInPandas(pool, _POOLS)
    whole = placed.where("flat").groupBy("place").agg(
        F.min("x").alias("low"), F.max("x").alias("high"), (F.sum("s") / F.sum("w")).alias("value"), F.sum("w").alias("weight")
    )
    return pools.unionByName(whole.drop("place"))


def applied(pools: DataFrame, df: DataFrame, score: str, name: str = "calibrated") -> DataFrame:
    """``df`` with the fitted value of each score, linear between pools and constant beyond them.

    Scores meet the pools' ends by ranges of the score, one row per distinct score, and the values join
    back. A null score, or an empty fit, gives null.
    """
    ends = written(
        pools.select(F.explode(F.array(F.struct(F.col("low").alias("x"), "value"), F.struct(F.col("high").alias("x"), "value"))).alias("e"))
        .select("e.x", "e.value").distinct(),
        "isotonic-ends",
    )
    x = F.col(score).cast("double")
    asked = written(df.select(x.alias("x")).where("x is not null and not isnan(x)").distinct(), "isotonic-scores")
    ranges = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = asked.unionByName(ends.select("x")).agg(F.percentile_approx("x", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    cuts = np.array(sorted(set(cuts)))

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(place=np.searchsorted(cuts, frame["x"].to_numpy(), "left"))

    by_range = ends.mapInPandas(numbered, "x double, value double, place long")
    # A range also needs the last end before it and the first one after it: a row or two per range.
    borders = sorted(
        (tuple(r[c]) for r in by_range.groupBy("place").agg(
            F.min(F.struct("x", "value")).alias("first"), F.max(F.struct("x", "value")).alias("last")
        ).collect() for c in ("first", "last"))
    )
    border_x = np.array([b[0] for b in borders])

    def value(key, mine: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or not borders:
            return pd.DataFrame({"x": mine["x"], "value": np.nan})[:0]
        around = [(a, b) for a, b in zip(known["x"], known["value"])]
        low = cuts[key[0] - 1] if key[0] else -np.inf
        high = cuts[key[0]] if key[0] < len(cuts) else np.inf
        before, after = np.searchsorted(border_x, low, "right") - 1, np.searchsorted(border_x, high, "right")
        around += [borders[i] for i in (before, after) if 0 <= i < len(borders)]
        at, to = map(np.array, zip(*sorted(set(around))))
        return pd.DataFrame({"x": mine["x"], "value": np.interp(mine["x"].to_numpy(), at, to)})

    found = (
        asked.mapInPandas(numbered, "x double, place long").groupBy("place")
        .cogroup(by_range.groupBy("place"))
        .applyInPandas(value, "x double, value double")
    )
    return df.join(found.select(F.col("x").alias("_x"), F.col("value").alias(name)), x == F.col("_x"), "left").drop("_x")
