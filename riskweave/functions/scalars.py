"""Column builders for dates, numbers and JSON. All stay inside generated code."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave import rules


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------------------- dates


def year_month(day: Column | str) -> Column:
    return F.date_format(as_col(day), "yyyyMM")


def year_month_from_parts(day: Column | str) -> Column:
    day = as_col(day)
    return F.concat(
        F.year(day).cast("string"), F.lpad(F.month(day).cast("string"), 2, "0")
    )


def months_before(as_of: date, months: int) -> date:
    """First day of the month ``months`` before ``as_of``."""
    index = as_of.year * 12 + as_of.month - 1 - months
    return date(index // 12, index % 12 + 1, 1)


def exercise_months(closing: Column | str, previous: Column | str) -> Column:
    return F.datediff(as_col(closing), as_col(previous)) / F.lit(rules.DAYS_PER_MONTH)


def valid_exercise_months(declared: Column | str, derived: Column | str) -> Column:
    """Declared length, else the derived one, else a whole year."""
    declared = as_col(declared).cast("double")
    chosen = F.when(declared.isNull() | (declared == 0), as_col(derived)).otherwise(declared)
    return F.when(chosen > 0, chosen).otherwise(F.lit(float(rules.EXERCISE_MONTHS)))


# ----------------------------------------------------------------------------- numbers


def number_or_null(c: str, type_name: str = "double") -> Column:
    return F.expr(f"try_cast({c} AS {type_name})")


def decimal_comma_number(c: str) -> Column:
    return F.expr(f"try_cast(replace({c}, ',', '.') AS double)")


def cents_to_units(cents: Column | str) -> Column:
    return as_col(cents).cast("double") / F.lit(100.0)


def sigmoid(x: Column | str) -> Column:
    x = as_col(x)
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """NULL where the quotient does not exist."""
    return F.try_divide(as_col(top).cast("double"), as_col(bottom).cast("double"))


def ratio_or_zero(top: Column | str, bottom: Column | str) -> Column:
    return F.coalesce(ratio(top, bottom), F.lit(0.0))


def floored(p: Column | str, floor: float = rules.PDO_FLOOR, digits: int = 4) -> Column:
    p = as_col(p)
    return F.when(p < floor, F.lit(floor)).otherwise(F.round(p, digits))


def clip(x: Column | str, low, high) -> Column:
    x = as_col(x)
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def signed_log(x: Column | str) -> Column:
    x = as_col(x)
    return F.signum(x) * F.log1p(F.abs(x))


def bin_class(x: Column | str, bins: rules.Bins) -> Column:
    """Class label from ascending bounds.

    NULL takes the default class; the hole value takes none.
    """
    x = as_col(x)
    chain = F.when(x.isNull(), F.lit(bins.default))
    if bins.hole is not None:
        chain = chain.when(x == bins.hole, F.lit(None))
    for bound, label in zip(bins.bounds, bins.classes):
        chain = chain.when(x < bound, F.lit(label))
    return chain.otherwise(F.lit(bins.classes[-1]))


def label_of(c: Column | str, classes: dict[str, tuple[str, ...]], default: str) -> Column:
    c = as_col(c)
    chain = None
    for label, members in classes.items():
        test = c.isin(*members)
        chain = F.when(test, F.lit(label)) if chain is None else chain.when(test, F.lit(label))
    return chain.otherwise(F.lit(default))


def signed_sum(codes: dict[str, int], prefix: str = "mt_") -> Column:
    """Signed total of pivoted statement columns; NULL as soon as one is missing."""
    total = F.lit(0.0)
    for code, sign in codes.items():
        amount = F.col(f"{prefix}{code}")
        total = total + amount if sign > 0 else total - amount
    return total


# ----------------------------------------------------------------- arrays, maps and JSON


def share_true(flags: Column | str) -> Column:
    flags = as_col(flags)
    return F.try_divide(
        F.size(F.filter(flags, lambda f: f)).cast("double"), F.size(flags).cast("double")
    )


def largest_value(m: Column | str) -> Column:
    return F.array_max(F.map_values(as_col(m)))


def tags(*rules_: tuple[Column, str]) -> Column:
    """Array of the names whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in rules_]))


def subject_and_body(subject: Column | str, body: Column | str) -> Column:
    def present(c):
        return F.when(F.trim(as_col(c)) != "", as_col(c))

    return F.concat_ws(" ", present(subject), present(body))


def redact_keys(payload: Column | str) -> Column:
    """Mask the values of sensitive keys in a string map."""
    return F.transform_values(
        as_col(payload),
        lambda k, v: F.when(
            F.lower(k).rlike("|".join(rules.SENSITIVE_KEYS)), F.lit("[REDACTED]")
        ).otherwise(v),
    )
