"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.functions.scalars import as_col


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _total(
        F.zip_with(
            as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double")
        )
    )


def l2_norm(a: Column | str) -> Column:
    """Length of the vector; a zero vector counts as length one."""
    length = F.sqrt(
        F.aggregate(
            as_col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")
        )
    )
    return F.when(length == 0, F.lit(1.0)).otherwise(length)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (l2_norm(a) * l2_norm(b))


def scaled_score(s: Column | str) -> Column:
    return (as_col(s) + 1) / 2


def clamped_score(s: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), as_col(s)))
