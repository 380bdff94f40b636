"""Enterprise features, encoders, binning and the logistic score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave import rules
from riskweave.functions.scalars import (
    as_col,
    bin_class,
    cents_to_units,
    decimal_comma_number,
    floored,
    label_of,
    sigmoid,
)
from riskweave.operators.statements import latest_rows

# ---------------------------------------------------------------------------- encoders


def legal_form_class(code: Column | str) -> Column:
    return label_of(code, rules.LEGAL_FORM_CLASSES, rules.LEGAL_FORM_DEFAULT)


def add_sector_class(df: DataFrame, code: str, mapping: DataFrame) -> DataFrame:
    """Class from a (sector_code, sector_class) table; an unknown code takes the default."""
    keyed = mapping.select(
        F.col("sector_code").alias(code), F.col("sector_class").alias("sector_class")
    ).dropDuplicates([code])
    return df.join(keyed, code, "left").withColumn(
        "sector_class", F.coalesce("sector_class", F.lit(rules.SECTOR_DEFAULT))
    )


def sector_mapping(spark) -> DataFrame:
    """The published sample; a full mapping comes as a table of the same shape."""
    return spark.createDataFrame(rules.SECTOR_SAMPLE, "sector_code string, sector_class string")


def group_flag(group: Column | str, blank_is_null: bool = False) -> Column:
    group = as_col(group)
    missing = group.isNull()
    if blank_is_null:
        missing = missing | (F.trim(group) == "")
    return F.when(missing, "0").otherwise("1")


# ------------------------------------------------------------------------------ joins


def enriched(main: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Row-preserving left join; the features are unique per key by construction."""
    return main.join(features, key, "left")


def duplicate_keys(features: DataFrame, key: str) -> DataFrame:
    """Keys that would multiply rows in ``enriched``; empty for a valid feature table."""
    return features.groupBy(key).count().where("count > 1")


def add_risk_features(main: DataFrame, overdrafts: DataFrame, key: str, days: str) -> DataFrame:
    worst = overdrafts.groupBy(key).agg(F.max(days).alias("overdraft_days"))
    return enriched(main, worst, key).withColumn("flag_risk", F.lit("OK"))


def balances(accounts: DataFrame, key: str, account: str, cents: str) -> DataFrame:
    """Algebraic sum in units and the number of account rows (not distinct accounts)."""
    return accounts.groupBy(key).agg(
        cents_to_units(F.sum(cents)).alias("balance"), F.count(account).alias("n_accounts")
    )


def add_balance_features(
    main: DataFrame, accounts: DataFrame, key: str, account: str, cents: str
) -> DataFrame:
    return enriched(main, balances(accounts, key, account, cents), key).withColumn(
        "flag_balance", F.lit("OK")
    )


def newest_rating(
    ratings: DataFrame, key: str, day: str, group: Sequence[str], score: str
) -> DataFrame:
    """Scores summed over the grouping columns, newest group per enterprise.

    Equal dates are settled by the remaining grouping columns, descending.
    """
    rest = [c for c in group if c not in (key, day)]
    summed = ratings.groupBy(*group).agg(F.sum(score).alias("rating_score"))
    order = [F.desc(day), *[F.desc(c) for c in rest]]
    return latest_rows(summed, key, order).drop("rank")


def add_rating_features(
    main: DataFrame, ratings: DataFrame, key: str, day: str, group: Sequence[str], raw: str
) -> DataFrame:
    """``raw`` is text with a decimal comma; what is not a number becomes NULL."""
    numeric = ratings.withColumn("_score", decimal_comma_number(raw))
    newest = newest_rating(numeric, key, day, group, "_score").select(
        key, "rating_score", sigmoid("rating_score").alias("rating_probability")
    )
    return enriched(main, newest, key)


# ----------------------------------------------------------------------------- binning


def overdraft_class(days: Column | str) -> Column:
    return F.when(as_col(days) > rules.OVERDRAFT_DAYS_BOUND, ">12").otherwise("<=12")


def score_variables(
    legal_form: str = "legal_form_class",
    sector: str = "sector_class",
    segment: str = "segment",
    group: str = "top_ga",
    days: str = "overdraft_days",
    balance: str = "balance",
    rating: str = "rating_probability",
    conso_margin: str = "VB023",
    cash_flow: str = "VB005",
    result: str = "VB035",
    assets: str = "VB055",
) -> dict[str, Column]:
    """The class columns of the score that need binning or renaming."""
    form = F.col(legal_form)
    return {
        "nat_jur_a": F.when(form == "7", ">=7").otherwise(form),
        "secto_b": F.col(sector),
        "seg_nae": F.when(F.col(segment) == "ME", "ME").otherwise("autres"),
        "top_ga": F.col(group),
        "nbj": overdraft_class(days),
        "solde_cav_char": bin_class(balance, rules.BALANCE_BINS),
        "reboot_score_char2": bin_class(rating, rules.RATING_BINS),
        "rn_ca_conso_023b": bin_class(conso_margin, rules.CONSO_MARGIN_BINS),
        "caf_dmlt_005": bin_class(cash_flow, rules.CASH_FLOW_BINS),
        "res_total_passif_035": bin_class(result, rules.RESULT_BINS),
        "immob_total_passif_055": bin_class(assets, rules.ASSET_BINS),
    }


# ------------------------------------------------------------------------------- score


def coefficient(
    variable: str, table: Sequence[tuple[str, str, float]] = rules.COEFFICIENTS
) -> Column:
    """Coefficient of the modality; NULL and unknown modalities weigh 0."""
    pairs = [(m, c) for v, m, c in table if v == variable]
    lookup = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.coalesce(F.try_element_at(lookup, F.col(variable)), F.lit(0.0))


def add_score(
    df: DataFrame,
    include_intercept: bool = True,
    orientation: str = "complement",
    table: Sequence[tuple[str, str, float]] = rules.COEFFICIENTS,
    intercept: float = rules.INTERCEPT,
) -> DataFrame:
    """Linear sum, probability of default, its floored and rounded form, and a flag.

    ``orientation`` "complement" gives 1 - sigmoid(z), "direct" gives sigmoid(z).
    """
    if orientation not in ("complement", "direct"):
        raise ValueError(f"orientation must be 'complement' or 'direct', not {orientation!r}")
    variables = tuple(dict.fromkeys(v for v, _, _ in table))
    missing = [v for v in variables if v not in df.columns]
    if missing:
        raise ValueError(f"missing score variables: {missing}")
    z = F.lit(intercept if include_intercept else 0.0)
    for variable in variables:
        z = z + coefficient(variable, table)
    scored = df.withColumn("intercept", F.lit(intercept)).withColumn("sum_total_coeffs", z)
    signed = F.col("sum_total_coeffs")
    return (
        scored.withColumn(
            "PDO_compute", sigmoid(-signed if orientation == "complement" else signed)
        )
        .withColumn("PDO", floored("PDO_compute"))
        .withColumn("flag_pdo_OK", F.lit("flag"))
    )


def one_hot(
    df: DataFrame, table: Sequence[tuple[str, str, float]] = rules.COEFFICIENTS
) -> DataFrame:
    """One 0/1 column per modality; a NULL or unknown modality is all zeros."""
    return df.select(
        "*",
        *[
            F.coalesce((F.col(v) == m).cast("int"), F.lit(0)).alias(one_hot_name(v, m))
            for v, m, _ in table
        ],
    )


def one_hot_name(variable: str, modality: str) -> str:
    text = modality.replace(">=", "sup").replace("<=", "inf_equal_").replace(">", "sup_")
    return f"{variable}_{text.replace('-', '_')}"


def add_linear_probability(
    df: DataFrame,
    weights: dict[str, float],
    intercept: float,
    name: str = "probability",
) -> DataFrame:
    """Probability of an external linear model over numeric columns."""
    if not weights:
        raise ValueError("the model has no weights")
    missing = [c for c in weights if c not in df.columns]
    if missing:
        raise ValueError(f"missing model columns: {missing}")
    z = F.lit(float(intercept))
    for column, weight in weights.items():
        z = z + F.col(column) * F.lit(float(weight))
    return df.withColumn(name, floored(sigmoid(z)))


def completeness(weights: dict[str, float]) -> dict[str, Column]:
    """Missing flags per column and a score of 1 minus the weights of the missing ones."""
    score = F.lit(1.0)
    out = {}
    for name, weight in weights.items():
        flag = F.col(name).isNull().cast("int")
        out[f"no_{name}"] = flag
        score = score - flag * F.lit(weight)
    out["completeness"] = score
    return out


def decision_tags(risk: str, fraud: str, amount: str, distance: str, night: str) -> Column:
    """Tags of a scored transaction, the risk level first."""
    return F.concat(
        F.array(F.concat(F.lit("risk:"), F.col(risk))),
        F.array_compact(
            F.array(
                F.when(F.col(fraud), "fraud_detected"),
                F.when(F.col(amount) > 500, "high_value"),
                F.when(F.col(distance) > 100, "far_merchant"),
                F.when(F.col(night), "night_transaction"),
            )
        ),
    )
