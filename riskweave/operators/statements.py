"""Financial statements and rating history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave import rules
from riskweave.functions.scalars import (
    as_col,
    exercise_months,
    ratio,
    ratio_or_zero,
    signed_sum,
    valid_exercise_months,
)


def latest_rows(
    df: DataFrame, key: str | Sequence[str], order: Sequence[Column], keep: int = 1
) -> DataFrame:
    """The first ``keep`` rows per key in a total order, with their rank.

    Spark limits the groups on the map side before the shuffle, so a hot key sends at most
    ``keep`` rows per task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= keep)


def latest_with_ties(df: DataFrame, key: str, day: str) -> DataFrame:
    """Every row of the newest ``day`` per key."""
    newest = Window.partitionBy(key).orderBy(F.desc(day))
    return df.withColumn("_r", F.rank().over(newest)).where("_r = 1").drop("_r")


def wide_statement(
    detail: DataFrame, keys: Sequence[str], code: str, value: str, codes: Sequence[str]
) -> DataFrame:
    """One ``mt_<code>`` column per listed code; other codes are dropped before the shuffle."""
    pivoted = (
        detail.where(F.col(code).isin(*codes))
        .groupBy(*keys)
        .pivot(code, list(codes))
        .agg(F.sum(value))
    )
    return pivoted.select(*keys, *[F.col(str(c)).alias(f"mt_{c}") for c in codes])


def previous_closing(closings: DataFrame, company: str, closing: str) -> DataFrame:
    """Distinct closing dates with the one before.

    Only distinct dates reach the window, so a company is at most one row per day.
    """
    by_company = Window.partitionBy(company).orderBy(closing)
    return (
        closings.select(company, closing)
        .where(F.col(closing).isNotNull())
        .distinct()
        .withColumn("previous_closing", F.lag(closing).over(by_company))
    )


def exercise_length(df: DataFrame, declared: str, closing: str, previous: str) -> Column:
    return valid_exercise_months(declared, exercise_months(closing, previous))


def imputed_tax_regime(regime: Column | str, rank: Column | str) -> Column:
    """A missing regime of the newest statement counts as regime 1."""
    regime = as_col(regime)
    return F.when(regime.isNull() & (as_col(rank) == 1), "1").otherwise(regime)


def annual(amount: Column, months: Column | str) -> Column:
    return F.try_divide(amount, as_col(months)) * F.lit(float(rules.EXERCISE_MONTHS))


def conso_ratios(wide: DataFrame, months: str) -> DataFrame:
    """Annual consolidated result, turnover and margin; a zero turnover gives no margin."""
    turnover = F.when(
        F.col("mt_310").isNotNull(), annual(F.col("mt_310"), months)
    ).otherwise(annual(F.col("mt_24") + F.col("mt_309"), months))
    return (
        wide.withColumn("conso_result", annual(signed_sum(rules.CONSO_RESULT), months))
        .withColumn("conso_turnover", turnover)
        .withColumn("VB023", ratio("conso_result", "conso_turnover") * 100)
    )


def solo_cash_flow(regime: Column | str, months: Column | str) -> Column:
    regime = as_col(regime)
    return F.when(
        regime == "1", annual(signed_sum(rules.CASH_FLOW_REGIME_1), months)
    ).when(regime == "2", annual(signed_sum(rules.CASH_FLOW_REGIME_2), months))


def solo_ratios(
    wide: DataFrame,
    regime: str,
    months: str,
    debt_service: Column,
    result: Column,
    assets: Column,
    total: Column,
) -> DataFrame:
    """Cash-flow, result and asset ratios in percent; no quotient counts as 0.

    The numerators of the last two ratios are parameters of the caller.
    """
    return (
        wide.withColumn("cash_flow", solo_cash_flow(regime, months))
        .withColumn("VB005", ratio_or_zero(F.col("cash_flow"), debt_service) * 100)
        .withColumn("VB035", ratio_or_zero(result, total) * 100)
        .withColumn("VB055", ratio_or_zero(assets, total) * 100)
    )


def change_over_previous(
    df: DataFrame, company: str, period: str, value: str
) -> DataFrame:
    """Relative change, trend sign and two-point deviation against the period before.

    ``df`` holds one row per company and period.
    """
    order = Window.partitionBy(company).orderBy(period)
    current, before = F.col(value), F.col("previous")
    return (
        df.withColumn("previous", F.lag(value).over(order))
        .withColumn("change", F.try_divide(current - before, F.abs(before)))
        .withColumn("trend", F.signum(current - before))
        .withColumn("volatility", F.abs(current - before) / F.sqrt(F.lit(2.0)))
    )


# -------------------------------------------------------------- further statement ratios


def financial_ratios() -> dict[str, Column]:
    """Ratios over named statement posts, in the order they are published."""

    def q(top: str, bottom: str, factor: float | None = None) -> Column:
        out = ratio(top, bottom)
        return out * factor if factor is not None else out

    def growth(name: str, absolute: bool = False) -> Column:
        base = F.col(f"{name}_n1")
        return F.try_divide(F.col(name) - base, F.abs(base) if absolute else base)

    def negative(name: str) -> Column:
        return (F.col(name) < 0).cast("int")

    return {
        "current_ratio": q("current_assets", "current_liabilities"),
        "quick_ratio": F.try_divide(
            F.col("current_assets") - F.col("inventory"), F.col("current_liabilities")
        ),
        "cash_ratio": q("cash", "current_liabilities"),
        "equity_ratio": q("equity", "total_liabilities"),
        "gearing": q("financial_debt", "equity"),
        "repayment_years": q("long_term_debt", "cash_flow"),
        "roe": q("net_result", "equity"),
        "roa": q("net_result", "total_assets"),
        "gross_margin": q("gross_surplus", "turnover"),
        "operating_margin": q("operating_result", "turnover"),
        "inventory_turns": q("turnover", "mean_inventory"),
        "customer_days": q("receivables", "turnover", 365),
        "supplier_days": q("payables", "purchases", 365),
        "capital_intensity": q("fixed_assets", "total_assets"),
        "working_capital_share": q("working_capital_need", "turnover"),
        "working_capital_cover": q("net_working_capital", "working_capital_need"),
        "interest_cover": q("gross_surplus", "interest_charges"),
        "debt_cover": q("cash_flow", "debt_service"),
        "turnover_growth": growth("turnover"),
        "result_growth": growth("net_result", absolute=True),
        "staff_growth": growth("staff"),
        "loss_flag": negative("net_result"),
        "negative_equity_flag": negative("equity"),
        "negative_cash_flag": negative("cash"),
        "repeated_loss_flag": (
            (F.col("net_result") < 0) & (F.col("net_result_n1") < 0)
        ).cast("int"),
    }


def interactions() -> dict[str, Column]:
    """Cross features and the two composite scores."""

    def between(name: str, low: float, high: float) -> Column:
        return F.least(F.greatest(F.col(name), F.lit(low)), F.lit(high))

    liquidity = F.col("current_ratio")
    return {
        "balance_x_rating": F.col("balance") * F.col("rating_score"),
        "turnover_x_gearing": F.col("turnover") * F.col("gearing"),
        "sector_x_liquidity": F.col("sector_class").cast("double") * liquidity,
        "stress_score": (F.col("n_debit_days") / 180)
        * (F.col("reject_rate") + 0.01)
        * F.try_divide(F.lit(1.0), liquidity + 0.1),
        "health_score": 0.3 * between("roe", -1, 1)
        + 0.3 * between("current_ratio", 0, 3) / 3
        + 0.2 * (1 - between("gearing", 0, 5) / 5)
        + 0.2 * between("gross_margin", -0.5, 0.5)
        + 0.5,
    }
