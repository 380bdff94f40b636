"""Eligibility rules, range guards and business-group resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave import rules

EligibilityRules = Sequence[tuple[str, Column]]


def eligibility_rules(strict_real_estate: bool = False) -> EligibilityRules:
    """(name, keep-test) in order. A test that is unknown for a row drops the row.

    ``strict_real_estate`` keeps only rows without any real-estate profile; by default the
    profile "1" alone is excluded.
    """
    real_estate = F.col("real_estate")
    segment, public_activity = rules.EXCLUDED_PUBLIC_ACTIVITY
    return (
        ("legal_form", ~F.col("legal_form").isin(*rules.EXCLUDED_LEGAL_FORMS)),
        ("activity", F.col("activity") != rules.EXCLUDED_ACTIVITY),
        (
            "public_activity",
            ~((F.col("segment") == segment) & (F.col("activity") == public_activity)),
        ),
        ("segment", F.col("segment").isin(*rules.KEPT_SEGMENTS)),
        (
            "real_estate",
            real_estate.isNull()
            if strict_real_estate
            else F.coalesce(real_estate, F.lit("")) != "1",
        ),
        ("has_account", F.col("has_account") == "1"),
        ("risk_claim", ~F.col("risk_claim").isin(*rules.EXCLUDED_RISK_CLAIMS)),
        ("economic_code", ~F.col("economic_code").isin(*rules.EXCLUDED_ECONOMIC_CODES)),
        ("client_nature", F.col("client_nature") != rules.EXCLUDED_CLIENT_NATURE),
    )


def eligible(df: DataFrame, checks: EligibilityRules | None = None) -> DataFrame:
    for _, test in checks if checks is not None else eligibility_rules():
        df = df.where(test)
    return df


def filter_report(df: DataFrame, checks: EligibilityRules | None = None) -> DataFrame:
    """Rows in, rows out and percentage removed per rule, from one pass over ``df``."""
    checks = list(checks if checks is not None else eligibility_rules())
    passed = F.lit(True)
    counts = [F.count(F.lit(1)).alias("_0")]
    for i, (_, test) in enumerate(checks, 1):
        passed = passed & F.coalesce(test, F.lit(False))
        counts.append(F.count_if(passed).alias(f"_{i}"))
    steps = F.array(
        *[
            F.struct(
                F.lit(i).alias("step"),
                F.lit(name).alias("rule"),
                F.col(f"_{i - 1}").alias("rows_in"),
                F.col(f"_{i}").alias("rows_out"),
            )
            for i, (name, _) in enumerate(checks, 1)
        ]
    )
    return df.agg(*counts).select(F.inline(steps)).withColumn(
        "pct_removed",
        F.coalesce(
            F.round(
                F.try_divide(100.0 * (F.col("rows_in") - F.col("rows_out")), F.col("rows_in")), 2
            ),
            F.lit(0.0),
        ),
    )


def guard_range(df: DataFrame, value: str, low, high, mode: str = "drop") -> DataFrame:
    """Treat values outside [low, high]: ``keep`` them, ``drop`` the row or ``clip``.

    Adds ``out_of_range``, so the rejected rows can be counted with ``range_report`` or
    ``observe`` without a second pass.
    """
    outside = F.coalesce(~F.col(value).between(low, high), F.lit(False))
    flagged = df.withColumn("out_of_range", outside)
    if mode == "keep":
        return flagged
    if mode == "drop":
        return flagged.where(~F.col("out_of_range"))
    if mode == "clip":
        clipped = F.when(F.col(value) < low, F.lit(low)).when(F.col(value) > high, F.lit(high))
        return flagged.withColumn(value, clipped.otherwise(F.col(value)))
    raise ValueError(f"mode must be keep, drop or clip, not {mode!r}")


def range_report(df: DataFrame, value: str, low, high, by: Sequence[str] = ()) -> DataFrame:
    inside = F.col(value).between(low, high)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(~inside).alias("rows_rejected"),
        F.max(F.when(inside, F.col(value))).alias("max_kept"),
    )


# ------------------------------------------------------------------------------ groups


def resolve_groups(
    links: DataFrame, enterprise: str, group: str, drop_if_no_capital: bool = True
) -> DataFrame:
    """One business group per enterprise.

    A single group stays. Of several, capital links come first, then the newest start, then
    the newest update, then the largest group id. With ``drop_if_no_capital`` an enterprise
    in several groups without any capital link is left out.
    """
    capital = F.col("link_type") == "CAPIT"
    best = F.max(
        F.struct(
            capital.cast("int").alias("is_capital"),
            "start_date",
            "update_date",
            F.col(group).alias(group),
            "link_type",
        )
    ).alias("best")
    found = links.groupBy(enterprise).agg(
        best, F.min(group).alias("_first"), F.max(group).alias("_last")
    )
    if drop_if_no_capital:
        found = found.where(
            (F.col("_first") == F.col("_last")) | (F.col("best.is_capital") == 1)
        )
    return found.select(
        enterprise, f"best.{group}", "best.link_type", "best.start_date", "best.update_date"
    )


def group_branches(links: DataFrame, enterprise: str, group: str) -> list[DataFrame]:
    """The same choice as three branches that exclude each other.

    Single group; exactly one capital group of several; several capital groups, newest
    first.
    """
    n_groups = links.groupBy(enterprise).agg(
        F.count_distinct(group).alias("n_groups"),
        F.count_distinct(F.when(F.col("link_type") == "CAPIT", F.col(group))).alias("n_capital"),
    )
    counted = links.join(n_groups, enterprise)
    newest = Window.partitionBy(enterprise).orderBy(
        F.desc("start_date"), F.desc("update_date"), F.desc(group)
    )
    columns = [enterprise, group, "link_type", "start_date", "update_date"]

    def newest_row(df: DataFrame) -> DataFrame:
        return df.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").select(*columns)

    several = counted.where((F.col("n_groups") > 1) & (F.col("link_type") == "CAPIT"))
    return [
        newest_row(counted.where(F.col("n_groups") == 1)),
        newest_row(several.where(F.col("n_capital") == 1)),
        newest_row(several.where(F.col("n_capital") > 1)),
    ]
