"""Movement categorisation and transaction features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave import rules
from riskweave.functions.scalars import as_col, ratio_or_zero
from riskweave.operators.ordered import exact_quantiles


def direction(amount: Column | str) -> Column:
    """Positive is a credit, zero and below a debit, NULL neither."""
    amount = as_col(amount)
    return F.when(amount > 0, "credit").when(amount <= 0, "debit")


def starts_with_any(label: Column | str, prefixes: Sequence[str]) -> Column:
    label = as_col(label)
    test = label.startswith(prefixes[0])
    for prefix in prefixes[1:]:
        test = test | label.startswith(prefix)
    return test


def category(
    code: Column | str,
    side: Column | str,
    label: Column | str,
    table: Sequence[rules.CategoryRule] = rules.CATEGORY_RULES,
) -> Column:
    """First matching rule of ``table``; NULL when none matches.

    The code is best a bigint. For smaller integers Spark unrolls every code set into a
    switch, and all rules together make a method too large to be compiled to machine code.
    """
    code, side, label = as_col(code), as_col(side), as_col(label)
    chain: Column | None = None
    for rule in table:
        tests = []
        if rule.codes:
            tests.append(code.isin(*rule.codes))
        if rule.direction:
            tests.append(side == rule.direction)
        if rule.label_prefixes:
            tests.append(starts_with_any(label, rule.label_prefixes))
        test = tests[0]
        for more in tests[1:]:
            test = test & more
        name = F.lit(rule.category)
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain.otherwise(F.lit(None).cast("string"))


def category_function_sql(
    name: str = "movement_category",
    table: Sequence[rules.CategoryRule] = rules.CATEGORY_RULES,
    temporary: bool = True,
) -> str:
    """Statement that makes ``table`` a SQL function of (code, side, label), for users of SQL.

    Spark puts the body in place of each call, so a query that calls it compiles like ``category``.
    A temporary function lasts as long as the session; another belongs to the current schema.
    """

    def text(value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    branches = []
    for rule in table:
        tests = []
        if rule.codes:
            tests.append(f"code IN ({', '.join(f'{c}L' for c in rule.codes)})")
        if rule.direction:
            tests.append(f"side = {text(rule.direction)}")
        if rule.label_prefixes:
            tests.append("(" + " OR ".join(f"startswith(label, {text(p)})" for p in rule.label_prefixes) + ")")
        branches.append(f"WHEN {' AND '.join(tests)} THEN {text(rule.category)}")
    kind = "TEMPORARY FUNCTION" if temporary else "FUNCTION"
    return (
        f"CREATE OR REPLACE {kind} {name}(code BIGINT, side STRING, label STRING) RETURNS STRING\n"
        "RETURN CASE " + "\n  ".join(branches) + " END"
    )


def without_cancelled(
    movements: DataFrame, cancels: DataFrame, keys: Sequence[str]
) -> DataFrame:
    return movements.join(cancels, on=list(keys), how="left_anti")


def bridge(scope: DataFrame, *links: tuple[DataFrame, str, str]) -> DataFrame:
    """Follow (from, to) link tables one after the other.

    Each link is made distinct first, so a repeated link does not multiply movements.
    """
    out = scope
    for table, source, target in links:
        out = out.join(table.select(source, target).distinct(), on=source, how="inner")
    return out


def totals_by_category(
    movements: DataFrame, enterprise: str, category_col: str = "category", amount: str = "amount"
) -> DataFrame:
    """One row per (enterprise, category) plus the operation count over all categories.

    One shuffle of the movements: they are first summed per (enterprise, category), the
    uncategorised row included, and the total count is taken over those few rows.
    """
    per_category = movements.groupBy(enterprise, category_col).agg(
        F.sum(amount).alias("netamount"),
        F.count(amount).alias("nops_category"),
        F.min(amount).alias("min_amount"),
        F.max(amount).alias("max_amount"),
    )
    # At most one row per category rule and enterprise reaches this window.
    whole = Window.partitionBy(enterprise)
    return per_category.withColumn(
        "nops_total", F.sum("nops_category").over(whole).cast("long")
    ).where(F.col(category_col).isNotNull())


def windowed_totals(
    movements: DataFrame, enterprise: str, category_col: str = "category", amount: str = "amount"
) -> DataFrame:
    """The same columns on every movement, for callers that keep the detail rows.

    The totals come from the pre-aggregated rows and are joined back, so a hot enterprise
    never sits in one window task. Movements without a category find no partner and drop out.
    """
    totals = totals_by_category(movements, enterprise, category_col, amount)
    # A key that is never NULL spares the scan a filter that would work out the category twice.
    keyed = movements.withColumn("_key", F.coalesce(F.col(category_col), F.lit("")))
    return keyed.join(
        totals.withColumnRenamed(category_col, "_key"), [enterprise, "_key"], "inner"
    ).drop("_key")


def model_category(c: Column | str) -> Column:
    c = as_col(c)
    chain: Column | None = None
    for source, target in rules.CATEGORY_REGROUP.items():
        test = c == source
        chain = F.when(test, target) if chain is None else chain.when(test, target)
    return chain.otherwise(c)


MEASURES = {
    "netamount": "netamount",
    "nops": "nops_category",
    "min_amount": "min_amount",
    "max_amount": "max_amount",
}


def model_rows(totals: DataFrame, category_col: str) -> DataFrame:
    return totals.withColumn("model_category", model_category(category_col)).where(
        F.col("model_category").isin(*rules.MODEL_CATEGORIES)
    )


def _operation_count(nops_mode: str) -> Column:
    if nops_mode == "summed":
        return F.sum(F.col("nops_total").cast("double")).alias("nops")
    if nops_mode == "total":
        return F.max(F.col("nops_total").cast("double")).alias("nops")
    raise ValueError(f"nops_mode must be 'summed' or 'total', not {nops_mode!r}")


def wide_by_condition(
    totals: DataFrame,
    enterprise: str,
    category_col: str = "category",
    nops_mode: str = "summed",
) -> DataFrame:
    """Four sums per model category as columns, in one pass. Absent category gives NULL."""
    aggs = [
        F.sum(F.when(F.col("model_category") == name, F.col(source).cast("double"))).alias(
            f"{name}__{measure}"
        )
        for name in rules.MODEL_CATEGORIES
        for measure, source in MEASURES.items()
    ]
    return (
        model_rows(totals, category_col)
        .groupBy(enterprise)
        .agg(*aggs, _operation_count(nops_mode))
    )


def wide_by_pivot(totals: DataFrame, enterprise: str, category_col: str = "category") -> DataFrame:
    """The same columns through ``pivot`` with the listed values."""
    pivoted = (
        model_rows(totals, category_col)
        .groupBy(enterprise)
        .pivot("model_category", list(rules.MODEL_CATEGORIES))
        .agg(
            *[
                F.sum(F.col(source).cast("double")).alias(measure)
                for measure, source in MEASURES.items()
            ]
        )
    )
    return pivoted.select(
        enterprise,
        *[
            F.col(f"{name}_{measure}").alias(f"{name}__{measure}")
            for name in rules.MODEL_CATEGORIES
            for measure in MEASURES
        ],
    )


def one_or_two(test: Column) -> Column:
    """"1" where the test holds, "2" where it does not or is unknown."""
    return F.when(test, "1").otherwise("2")


def transaction_flags(wide: DataFrame) -> DataFrame:
    ratio = ratio_or_zero("interets__netamount", "turnover__netamount")
    return (
        wide.withColumn(
            "remb_sepa_max",
            one_or_two(F.col("rembt_prlv_sepa__max_amount") > rules.REFUND_MAX_BOUND),
        )
        .withColumn("pres_prlv_retourne", one_or_two(F.col("prlv_sepa_retourne__nops") > 0))
        .withColumn("pres_saisie", one_or_two(F.col("saisie__nops") > 0))
        .withColumn("net_interets_sur_turnover", ratio)
        .withColumn(
            "net_int_turnover",
            one_or_two(
                (F.col("nops") >= rules.INTEREST_MIN_OPERATIONS)
                & (F.col("net_interets_sur_turnover") < rules.INTEREST_RATIO_BOUND)
            ),
        )
    )


def add_transaction_features(
    main: DataFrame,
    totals: DataFrame,
    enterprise: str,
    category_col: str = "category",
    nops_mode: str = "summed",
) -> DataFrame:
    wide = wide_by_condition(totals, enterprise, category_col, nops_mode)
    return main.join(transaction_flags(wide), enterprise, "left").withColumn(
        "flag_transac", F.lit("OK")
    )


def activity_features(movements: DataFrame, enterprise: str) -> DataFrame:
    """Volume, regularity, stress and revenue-structure measures per enterprise.

    Expects ``amount`` (double), ``category``, ``side``, ``period`` (1 first half, 2 second)
    and ``balance``. Every measure is a partial aggregate; the revenue concentration is
    written as sum(x^2) / sum(x)^2, so it needs no second look at the rows.
    """
    amount, credit = F.col("amount"), F.col("side") == "credit"

    def total(test: Column) -> Column:
        return F.sum(F.when(test, amount))

    def among(*names: str) -> Column:
        return F.col("category").isin(*names)

    revenue = total(credit)
    measured = movements.groupBy(enterprise).agg(
        F.sum(amount).alias("total_volume"),
        F.count(amount).alias("n_movements"),
        F.avg(amount).alias("mean_amount"),
        F.stddev(amount).alias("std_amount"),
        F.try_divide(F.stddev(amount), F.avg(amount)).alias("cv_amount"),
        F.try_divide(total(F.col("period") == 1), total(F.col("period") == 2)).alias(
            "trend_halves"
        ),
        F.count(F.when(F.col("balance") < 0, 1)).alias("n_debit_days"),
        F.min("balance").alias("min_balance"),
        F.try_divide(
            F.count(F.when(among("rejected"), 1)).cast("double"), F.count("category")
        ).alias("reject_rate"),
        F.try_divide(F.sum(F.when(credit, amount * amount)), revenue * revenue).alias(
            "revenue_concentration"
        ),
        F.count_distinct(F.when(credit, F.col("category"))).alias("n_revenue_sources"),
        F.try_divide(F.abs(total(among("loyer", "assurance", "abonnement"))), revenue).alias(
            "fixed_charge_ratio"
        ),
        F.try_divide(F.abs(total(among("interets"))), total(among("turnover"))).alias(
            "interest_turnover_ratio"
        ),
        F.try_divide(revenue, F.abs(total(among("pret", "leasing")))).alias("loan_cover"),
    )
    p95 = exact_quantiles(movements, "amount", {"p95_amount": 0.95}, [enterprise])
    return measured.join(p95.drop("n_values"), enterprise, "left")
