"""Drift between a reference and a current population."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave import rules
from riskweave.functions import stats, vectors
from riskweave.functions.scalars import as_col
from riskweave.operators.ordered import exact_quantiles, running_totals


def two_sides(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Both populations in one table with ``is_ref`` 1 or 0."""
    return reference.withColumn("is_ref", F.lit(1)).unionByName(
        current.withColumn("is_ref", F.lit(0))
    )


def _long(sides: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """(feature, value, is_ref) without NULL, one row per observed cell."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("value")) for c in columns]
    )
    return (
        sides.select("is_ref", F.inline(cells))
        .where(F.col("value").isNotNull())
    )


def ks_drift(sides: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and asymptotic p-value per numeric column."""
    counts = (
        _long(sides, columns, "double")
        .groupBy("feature", "value")
        .agg(
            F.sum("is_ref").cast("long").alias("ref"),
            F.sum(1 - F.col("is_ref")).cast("long").alias("cur"),
        )
    )
    ranked = running_totals(counts, "value", ["ref", "cur"], ["feature"])
    gap = F.abs(
        F.col("cum_ref") / F.col("all_ref") - F.col("cum_cur") / F.col("all_cur")
    )
    found = ranked.groupBy("feature").agg(
        F.max(gap).alias("statistic"),
        F.max("all_ref").alias("n_ref"),
        F.max("all_cur").alias("n_cur"),
    )
    return found.withColumn(
        "p_value", stats.ks_p_value(F.col("statistic"), F.col("n_ref"), F.col("n_cur"))
    ).withColumn("drift", (F.col("p_value") < rules.DRIFT_P_VALUE).cast("int"))


def chi2_drift(sides: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Chi-square test of side against value per categorical column.

    A two-by-two table takes the continuity correction.
    """
    counts = (
        _long(sides, columns, "string")
        .groupBy("feature", "value")
        .agg(
            F.sum("is_ref").cast("long").alias("ref"),
            F.sum(1 - F.col("is_ref")).cast("long").alias("cur"),
        )
    )
    totals = counts.groupBy("feature").agg(
        F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur"), F.count("*").alias("n_values")
    )
    n = F.col("n_ref") + F.col("n_cur")
    row = F.col("ref") + F.col("cur")

    def cell(observed: str, side: str) -> Column:
        expected = row * F.col(side) / n
        gap = F.abs(F.col(observed) - expected)
        gap = F.when(F.col("n_values") == 2, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
        return F.try_divide(gap * gap, expected)

    return (
        counts.join(totals, "feature")
        .groupBy("feature")
        .agg(
            F.sum(cell("ref", "n_ref") + cell("cur", "n_cur")).alias("statistic"),
            (F.max("n_values") - 1).alias("dof"),
        )
        .withColumn("p_value", stats.chi2_p_value("statistic", "dof"))
        .withColumn("drift", (F.col("p_value") < rules.DRIFT_P_VALUE).cast("int"))
    )


def psi(
    reference: DataFrame, current: DataFrame, value: str, n_bins: int = 10, epsilon: float = 1e-4
) -> DataFrame:
    """Population stability index per bin of the reference quantiles (``psi_total`` sums them)."""
    inner = {f"q{i}": i / n_bins for i in range(1, n_bins)}
    edges = exact_quantiles(reference, value, inner).select(F.array(*inner).alias("edges"))
    bins = F.size(F.filter("edges", lambda e: e < F.col(value)))
    both = two_sides(reference.select(value), current.select(value)).where(
        F.col(value).isNotNull()
    )
    counts = (
        both.withColumn("edges", edges.scalar())
        .groupBy(bins.alias("bin"))
        .agg(
            F.sum("is_ref").cast("long").alias("n_ref"),
            F.sum(1 - F.col("is_ref")).cast("long").alias("n_cur"),
        )
    )
    totals = counts.agg(F.struct(F.sum("n_ref").alias("r"), F.sum("n_cur").alias("c")).alias("t"))
    shares = counts.withColumn("t", totals.scalar())
    ref = F.greatest(F.col("n_ref") / F.col("t.r"), F.lit(epsilon))
    cur = F.greatest(F.col("n_cur") / F.col("t.c"), F.lit(epsilon))
    return shares.select(
        "bin",
        "n_ref",
        "n_cur",
        ((cur - ref) * F.log(cur / ref)).alias("psi"),
    )


def psi_total(bins: DataFrame, moderate: float = 0.1, high: float = 0.25) -> DataFrame:
    """The index over all bins, with its alert: none, moderate or high (thresholds included)."""
    total = F.col("psi")
    return bins.agg(F.sum("psi").alias("psi"), F.count("*").alias("n_bins")).withColumn(
        "alert", F.when(total >= high, "high").when(total >= moderate, "moderate").otherwise("none")
    )


def moment_shift(sides: DataFrame, value: str) -> DataFrame:
    """Change of mean and of population deviation from reference to current."""
    ref = F.when(F.col("is_ref") == 1, F.col(value))
    cur = F.when(F.col("is_ref") == 0, F.col(value))
    return sides.agg(
        (F.avg(cur) - F.avg(ref)).alias("mean_shift"),
        (F.stddev_pop(cur) - F.stddev_pop(ref)).alias("std_shift"),
    )


def prediction_drift(sides: DataFrame, value: str) -> DataFrame:
    tested = ks_drift(sides, [value])
    return tested.withColumn("shift", moment_shift_struct(sides, value).scalar()).select(
        "statistic", "p_value", "drift", "shift.mean_shift", "shift.std_shift"
    )


def moment_shift_struct(sides: DataFrame, value: str) -> DataFrame:
    return moment_shift(sides, value).select(F.struct("mean_shift", "std_shift").alias("shift"))


def alert_level(report: DataFrame, drift: str = "drift") -> DataFrame:
    """Red above five drifted features, orange above none, else green."""
    n = F.count_if(F.col(drift) == 1)
    return report.agg(
        n.alias("n_drifted"),
        F.when(n > 5, "red").when(n > 0, "orange").otherwise("green").alias("level"),
    )


def degradation_severity(drop_pct: Column | str) -> Column:
    """Severity of a relative drop in percent; a bound belongs to the milder side."""
    drop = as_col(drop_pct)
    return (
        F.when(drop < 2, "info")
        .when(drop <= 5, "warning")
        .when(drop <= 10, "critical")
        .when(drop > 10, "urgent")
    )


# ----------------------------------------------------------------------- text, vectors


def words(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per word of letters or digits, lower case."""
    return df.select(
        *keep, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word")
    )


def vocabulary_drift(reference: DataFrame, current: DataFrame, text: str, by: str) -> DataFrame:
    """Per group of ``current``: tokens, distinct words, diversity, out-of-vocabulary rate."""
    known = words(reference, text).groupBy("word").agg(F.lit(1).alias("known"))
    counted = words(current, text, by).groupBy(by, "word").agg(F.count("*").alias("n"))
    joined = counted.join(known, "word", "left")
    return joined.groupBy(by).agg(
        F.sum("n").cast("long").alias("n_tokens"),
        F.count("*").alias("n_words"),
        (F.count("*") / F.sum("n")).alias("diversity"),
        (
            F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)) / F.sum("n")
        ).alias("oov_rate"),
    )


def centroid(df: DataFrame, vector: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean vector per group, summed per position before the shuffle."""
    means = (
        df.select(*by, F.posexplode(vector).alias("pos", "x"))
        .groupBy(*by, "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"])
    return means.groupBy(*by).agg(ordered.alias("centroid"))


def centroid_drift(
    reference: DataFrame, current: DataFrame, vector: str, by: Sequence[str]
) -> DataFrame:
    a = centroid(reference, vector, by).withColumnRenamed("centroid", "ref")
    b = centroid(current, vector, by).withColumnRenamed("centroid", "cur")
    return a.join(b, list(by)).select(*by, (1 - vectors.cosine("ref", "cur")).alias("distance"))


def version_change(df: DataFrame, version: str, order: str, metric: Column) -> DataFrame:
    """Metric per version and its change against the version before it."""
    from pyspark.sql import Window

    per_version = df.groupBy(version).agg(
        F.min(order).alias("first_seen"), F.count("*").alias("n"), metric.alias("metric")
    )
    # One row per released version reaches this window.
    before = F.lag("metric").over(Window.orderBy("first_seen", version))
    return per_version.withColumn("change", F.col("metric") - before)


def concept_drift(
    reference: DataFrame, current: DataFrame, bins: Column, target: str
) -> DataFrame:
    """Per bin: share of rows and target rate on both sides.

    Stable shares with moving rates mean the relation to the target changed.
    """
    both = two_sides(reference, current).withColumn("bin", bins)
    ref, cur = F.col("is_ref") == 1, F.col("is_ref") == 0
    per_bin = both.groupBy("bin").agg(
        F.count_if(ref).alias("n_ref"),
        F.count_if(cur).alias("n_cur"),
        F.avg(F.when(ref, F.col(target))).alias("rate_ref"),
        F.avg(F.when(cur, F.col(target))).alias("rate_cur"),
    )
    totals = per_bin.agg(
        F.struct(F.sum("n_ref").alias("r"), F.sum("n_cur").alias("c")).alias("t")
    )
    return per_bin.withColumn("t", totals.scalar()).select(
        "bin",
        "n_ref",
        "n_cur",
        (F.col("n_cur") / F.col("t.c") - F.col("n_ref") / F.col("t.r")).alias("share_change"),
        (F.col("rate_cur") - F.col("rate_ref")).alias("rate_change"),
    )
