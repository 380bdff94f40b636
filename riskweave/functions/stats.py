"""Tail probabilities as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def ks_p_value(statistic: Column, n_ref: Column, n_cur: Column) -> Column:
    """Asymptotic two-sample p-value: 2 * sum (-1)^(k-1) exp(-2 k^2 t^2)."""
    t = statistic * F.sqrt(n_ref * n_cur / (n_ref + n_cur))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * t * t),
    )
    # The alternating series needs far more terms near zero, where the value is one.
    return F.when(t < 0.2, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), series))
    )


def _chi2_tail(x: float, dof: int) -> float:
    if dof <= 0 or x <= 0:
        return 1.0
    half = x / 2.0
    if dof % 2:
        total, term, k = math.erfc(math.sqrt(half)), 0.0, 0.5
        log_term = 0.5 * math.log(half) - half - math.lgamma(1.5)
        while k < dof / 2.0:
            term = math.exp(log_term)
            total += term
            k += 1.0
            log_term += math.log(half) - math.log(k)
        return min(1.0, total)
    total, log_term = 0.0, -half
    for k in range(dof // 2):
        total += math.exp(log_term)
        log_term += math.log(half) - math.log(k + 1)
    return min(1.0, total)


@F.pandas_udf(DoubleType())
def chi2_p_value(x: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the chi-square law. Runs on one row per tested column."""
    return pd.Series([_chi2_tail(float(a), int(b)) for a, b in zip(x, dof)])


def entropy_term(p: Column) -> Column:
    return F.when(p > 0, -p * F.log(p)).otherwise(F.lit(0.0))
