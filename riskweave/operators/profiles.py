"""Rollups, knowledge-base audits, imputation and screening of feature tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from riskweave.functions.scalars import as_col, clip
from riskweave.operators.ordered import exact_quantiles
from riskweave.session import written

# ------------------------------------------------------------------------ distributions


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def score_summary(df: DataFrame, column: str) -> DataFrame:
    """Minimum, maximum, mean and exact median."""
    basic = df.agg(
        F.struct(
            F.min(column).alias("minimum"), F.max(column).alias("maximum"),
            F.avg(column).alias("mean"),
        ).alias("s")
    )
    median = exact_quantiles(df, column, {"median": 0.5})
    return median.withColumn("s", basic.scalar()).select(
        "s.minimum", "s.maximum", "s.mean", "median"
    )


def share_of_total(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per group and their share of all rows."""
    counted = df.groupBy(*by).agg(F.count("*").alias("n"))
    return counted.withColumn("total", counted.agg(F.sum("n")).scalar()).select(
        *by, "n", (F.col("n") / F.col("total")).alias("share")
    )


def daily_kpis(
    df: DataFrame, day: Column, by: Sequence[str], success: Column, latency: str
) -> DataFrame:
    """Volume, success rate, median and 95th percentile per day and segment."""
    keyed = df.withColumn("day", day).withColumn("_ok", success.cast("int"))
    keys = ["day", *by]
    rates = keyed.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_ok").alias("success_rate"))
    latencies = exact_quantiles(keyed, latency, {"median": 0.5, "p95": 0.95}, keys)
    return rates.join(latencies.drop("n_values"), keys, "left")


def moving_average(daily: DataFrame, day: str, total: str, count: str, days: int = 7) -> DataFrame:
    """Average over the last ``days`` calendar days of a table with one row per day."""
    number = F.datediff(F.col(day), F.lit("1970-01-01"))
    frame = Window.orderBy("_n").rangeBetween(-(days - 1), 0)
    return (
        daily.withColumn("_n", number)
        .withColumn("moving_average", F.sum(total).over(frame) / F.sum(count).over(frame))
        .drop("_n")
    )


# -------------------------------------------------------------------------- step control


def step_report(steps: DataFrame) -> DataFrame:
    """Duration share of each step and the three slowest, from a small table of step runs."""
    slowest = Window.partitionBy("run_id").orderBy(F.desc("seconds"), "step")
    whole = Window.partitionBy("run_id")
    return steps.select(
        "*",
        F.try_divide(F.col("seconds"), F.sum("seconds").over(whole)).alias("share"),
        (F.row_number().over(slowest) <= 3).cast("int").alias("is_slowest"),
    )


# ------------------------------------------------------------------------ knowledge base


def normalised_question(text: Column | str) -> Column:
    return F.lower(F.trim(as_col(text)))


def contradictions(df: DataFrame, text: str, target: str) -> DataFrame:
    """(question, target) pairs of questions that lead to more than one target.

    Questions are compared by their hash, so whole texts do not travel; a question with many
    copies is one row per target. Only the texts of the questions found are fetched.
    """
    question = normalised_question(text)
    hashed = df.select(F.sha2(question, 256).alias("hash"), target, question.alias("question"))
    pairs = hashed.select("hash", target).distinct()
    wrong = pairs.groupBy("hash").agg(F.count("*").alias("n_targets")).where("n_targets > 1")
    texts = (
        hashed.select("hash", "question")
        .join(wrong, "hash", "left_semi")
        .groupBy("hash")
        .agg(F.any_value("question").alias("question"))
    )
    return pairs.join(wrong, "hash").join(texts, "hash").select("question", target, "n_targets")


def duplicate_or_blank(df: DataFrame, key: str, text: str) -> DataFrame:
    """Questions that are blank or occur more than once: hash, rows and first id."""
    question = normalised_question(text)
    return (
        df.groupBy(F.sha2(question, 256).alias("hash"))
        .agg(
            F.count("*").alias("n"),
            F.min(key).alias("first_id"),
            F.max((question == "").cast("int")).alias("is_blank"),
        )
        .where((F.col("n") > 1) | (F.col("is_blank") == 1))
    )


# ---------------------------------------------------------------------------- imputation


def quality_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null rate, distinct values, range and count beyond three deviations per column.

    One aggregate over all columns, then one over the moments; the distinct counts are
    exact and spread over the values.
    """
    moments = []
    for c in columns:
        moments += [
            F.count(F.lit(1)).alias(f"{c}__rows"),
            F.count(c).alias(f"{c}__present"),
            F.min(F.col(c).cast("double")).alias(f"{c}__min"),
            F.max(F.col(c).cast("double")).alias(f"{c}__max"),
            F.avg(F.col(c).cast("double")).alias(f"{c}__mean"),
            F.stddev(F.col(c).cast("double")).alias(f"{c}__std"),
        ]
    fields = ("rows", "present", "min", "max", "mean", "std")
    summary = df.agg(*moments).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("feature"), *[F.col(f"{c}__{f}").alias(f) for f in fields])
                    for c in columns
                ]
            )
        )
    )
    cells = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                    for c in columns
                ]
            )
        )
    )
    values = cells.where("value IS NOT NULL").groupBy("feature", "value").agg(
        F.count("*").alias("n")
    )
    outlying = F.abs(F.col("value") - F.col("mean")) > 3 * F.col("std")
    counted = (
        values.join(summary.select("feature", "mean", "std"), "feature")
        .groupBy("feature")
        .agg(
            F.count("*").alias("n_distinct"),
            F.coalesce(F.sum(F.when(outlying, F.col("n"))), F.lit(0)).alias("n_outliers"),
            (F.max("n") / F.sum("n")).alias("top_share"),
        )
    )
    return summary.join(counted, "feature", "left").select(
        "feature",
        (1 - F.col("present") / F.col("rows")).alias("null_rate"),
        "n_distinct",
        F.col("min").alias("minimum"),
        F.col("max").alias("maximum"),
        "n_outliers",
        "top_share",
    )


def impute_by_segment(df: DataFrame, value: str, segment: str) -> DataFrame:
    """Missing values take the exact median of their segment.

    The medians are written first: Spark then knows how small they are and need not shuffle
    the rows by segment.
    """
    medians = written(
        exact_quantiles(df, value, {"_median": 0.5}, [segment]).drop("n_values"), "medians"
    )
    return (
        df.join(medians, segment, "left")
        .withColumn(value, F.coalesce(F.col(value), F.col("_median")))
        .drop("_median")
    )


def impute_with_flag(df: DataFrame, value: str) -> DataFrame:
    """Missing values are flagged and take the overall exact median."""
    median = exact_quantiles(df, value, {"m": 0.5}).select("m")
    return (
        df.withColumn("_m", median.scalar())
        .withColumn(f"{value}_missing", F.col(value).isNull().cast("int"))
        .withColumn(value, F.coalesce(F.col(value), F.col("_m")))
        .drop("_m")
    )


def impute_unknown(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit("UNKNOWN")))


def impute(
    df: DataFrame, numeric: Sequence[str], text: Sequence[str], segment: str
) -> DataFrame:
    """Choose per column by its null rate.

    Above one half: flag and overall median. Below: segment median. Text: "UNKNOWN". The
    null rates are one row with one number per column.
    """
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in numeric]).first()
    for c in numeric:
        df = impute_with_flag(df, c) if rates[c] > 0.5 else impute_by_segment(df, c, segment)
    for c in text:
        df = impute_unknown(df, c)
    return df


def outlier_forms(df: DataFrame, value: str) -> DataFrame:
    """Value cut at the 1st and 99th percentile, and scaled by median and quartile range."""
    points = {"p1": 0.01, "q1": 0.25, "q2": 0.5, "q3": 0.75, "p99": 0.99}
    found = exact_quantiles(df, value, points).select(F.struct(*points).alias("q"))
    x = F.col(value)
    return (
        df.withColumn("q", found.scalar())
        .withColumn("winsorised", clip(x, F.col("q.p1"), F.col("q.p99")))
        .withColumn(
            "scaled", F.try_divide(x - F.col("q.q2"), F.col("q.q3") - F.col("q.q1"))
        )
        .drop("q")
    )


# -------------------------------------------------------------------- encoders, screening


def out_of_fold_target(
    df: DataFrame, category: str, target: str, fold: Column
) -> DataFrame:
    """Mean target of the category over the other folds.

    A category seen in one fold only takes the overall mean. The caller names the fold, such
    as a hash of the key.
    """
    folded = df.withColumn("fold", fold.cast("int"))
    per_fold = folded.groupBy(category, "fold").agg(
        F.sum(target).alias("_s"), F.count(target).alias("_n")
    )
    # One row per fold and category reach this window.
    every = Window.partitionBy(category)
    others = per_fold.select(
        category,
        "fold",
        F.try_divide(
            F.sum("_s").over(every) - F.col("_s"), F.sum("_n").over(every) - F.col("_n")
        ).alias("_encoded"),
    )
    overall = df.agg(F.avg(target)).scalar()
    return (
        folded.join(others, [category, "fold"])
        .withColumn("_overall", overall)
        .withColumn("encoded", F.coalesce("_encoded", "_overall"))
        .drop("_encoded", "_overall")
    )


def correlation(a: str, b: str) -> Column:
    """Pearson correlation over the rows that hold both; null if either is constant or absent."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair from one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(
        *[correlation(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)]
    )
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("left"), F.lit(b).alias("right"),
                        F.col(f"_{i}").alias("correlation"),
                    )
                    for i, (a, b) in enumerate(pairs)
                ]
            )
        )
    )


def variance_inflation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance inflation factor per column: the diagonal of the inverse correlation matrix.

    The matrix is one row whose size is the square of the number of columns. A constant column is
    correlated with no other.
    """
    width = len(columns)

    @F.pandas_udf(ArrayType(DoubleType()))
    def inverse_diagonal(rows: pd.Series) -> pd.Series:
        return rows.map(
            lambda r: np.diag(np.linalg.pinv(np.array(r, dtype=float).reshape(width, width))).tolist()
        )

    cells = F.array(
        *[
            F.lit(1.0) if a == b else F.coalesce(correlation(a, b), F.lit(0.0))
            for a in columns
            for b in columns
        ]
    )
    return df.agg(cells.alias("m")).select(
        F.posexplode(inverse_diagonal("m")).alias("pos", "vif")
    ).select(F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("pos") + 1).alias("feature"), "vif")


def screening(
    df: DataFrame, columns: Sequence[str], target: str,
    max_null: float = 0.5, max_same: float = 0.95, max_correlation: float = 0.95,
) -> DataFrame:
    """Which features stay: feature, null_rate, top_share, relevance, reason (null: kept).

    A feature goes for too many nulls, then for one value in too many of its present rows, then
    for a correlation with a kept feature of higher relevance (absolute correlation with the
    target, unknown last, ties by name). Values are counted on the map side first; all else is one
    row per feature or pair.
    """
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("x")) for c in columns]))
    counts = df.select(cells).groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n"))
    shares = counts.groupBy("feature").agg(
        (F.coalesce(F.sum(F.when(F.col("x").isNull(), F.col("n"))), F.lit(0)) / F.sum("n")).alias("null_rate"),
        F.try_divide(F.max(F.when(F.col("x").isNotNull(), F.col("n"))), F.sum(F.when(F.col("x").isNotNull(), F.col("n")))).alias("top_share"),
    )
    pairs = written(correlation_pairs(df, [*columns, target]), "screening-pairs")
    relevance = pairs.where(F.col("right") == target).select(
        F.col("left").alias("feature"), F.abs("correlation").alias("relevance")
    )
    basic = (
        F.when(F.col("null_rate") > max_null, "nulls")
        .when(F.col("top_share").isNull() | (F.col("top_share") > max_same), "near constant")
    )
    rows = written(shares.join(relevance, "feature", "left").withColumn("_basic", basic), "screening-rows")
    strong = pairs.where(
        (F.col("right") != target) & (F.abs("correlation") > max_correlation)
    )
    known = F.coalesce("relevance", F.lit(-1.0))
    names = rows.where(F.col("_basic").isNull()).select(
        F.struct((-known).alias("r"), F.col("feature").alias("name")).alias("name")
    )
    # One row holds the names in order of relevance and the strong pairs; nulls are not collected.
    both = names.unionByName(strong.select(F.struct("left", "right").alias("pair")), allowMissingColumns=True)
    kept = both.agg(
        F.array_sort(F.collect_list("name")).alias("names"), F.collect_list("pair").alias("strong")
    ).select(
        F.explode(
            F.aggregate(
                "names",
                F.array().cast("array<string>"),
                lambda kept, f: F.when(
                    F.exists(
                        "strong",
                        lambda p: ((p["left"] == f["name"]) & F.array_contains(kept, p["right"]))
                        | ((p["right"] == f["name"]) & F.array_contains(kept, p["left"])),
                    ),
                    kept,
                ).otherwise(F.concat(kept, F.array(f["name"]))),
            )
        ).alias("feature"),
        F.lit(True).alias("_kept"),
    )
    reason = F.coalesce("_basic", F.when(F.col("_kept").isNull(), "correlated"))
    return rows.join(kept, "feature", "left").select("feature", "null_rate", "top_share", "relevance", reason.alias("reason"))


def mutual_information(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Mutual information (nats) of each discrete feature with the target."""
    cells = F.inline(
        F.array(
            *[
                F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("x"))
                for c in features
            ]
        )
    )
    joint = (
        df.where(F.col(target).isNotNull())
        .select(F.col(target).alias("y"), cells)
        .groupBy("feature", "x", "y")
        .agg(F.count("*").alias("n"))
    )
    by_x = joint.groupBy("feature", F.col("x").alias("x2")).agg(F.sum("n").alias("nx"))
    by_y = joint.groupBy(F.col("feature").alias("f2"), F.col("y").alias("y2")).agg(
        F.sum("n").alias("ny")
    )
    total = joint.groupBy(F.col("feature").alias("f3")).agg(F.sum("n").alias("nn"))
    joined = (
        joint.withColumnRenamed("feature", "f")
        .join(by_x, (F.col("f") == by_x["feature"]) & F.col("x").eqNullSafe(F.col("x2")))
        .join(by_y, (F.col("f") == F.col("f2")) & (F.col("y") == F.col("y2")))
        .join(total, F.col("f") == F.col("f3"))
    )
    term = F.col("n") / F.col("nn") * F.log(
        F.col("n") * F.col("nn") / (F.col("nx") * F.col("ny"))
    )
    return joined.groupBy(F.col("f").alias("feature")).agg(
        F.sum(term).alias("mutual_information")
    )


