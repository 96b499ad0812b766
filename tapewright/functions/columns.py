"""Scalar rules for missing values.

NULL is the only missing value: NaN and infinities never enter a frame. Each rule below
says what a missing operand gives, because the flags of the feature frame differ in that.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key_of(*keys: str) -> Column:
    """All keys as one value that is never missing.

    A struct is not NULL when its fields are, and equal structs have equal or equally missing
    fields. So it groups, partitions windows and joins by plain equality, and a frame that is
    laid out by it for one of these needs no other shuffle for the next.
    """
    return F.struct(*keys)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join by column names where missing keys are equal, as they are in groups and windows.

    Key columns are those of ``left``.
    """
    lefts, rights = left.withColumn("_key", key_of(*keys)), right.withColumn("_key", key_of(*keys))
    return lefts.join(rights.drop(*keys), "_key", how).drop("_key")


def div(a: Column | str, b: Column | str) -> Column:
    """a / b; NULL for a zero or missing divisor (ANSI division would raise)."""
    return F.try_divide(col(a), col(b))


def flag(condition: Column) -> Column:
    """Condition as 0/1; missing counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def differs(a: Column, b: Column) -> Column:
    """a != b as 0/1; missing counts as 1."""
    return F.coalesce(a != b, F.lit(True)).cast("int")


def sign(c: Column | str) -> Column:
    """-1, 0 or 1; missing stays missing. Adding 0.0 removes a negative zero."""
    return F.signum(col(c)) + F.lit(0.0)


def clip_below(c: Column | str, bound: float = 0.0) -> Column:
    """Raise values under ``bound`` to it; missing stays missing."""
    return F.when(col(c).isNotNull(), F.greatest(col(c), F.lit(bound)))


def clip_above(c: Column | str, bound: float = 0.0) -> Column:
    """Lower values over ``bound`` to it; missing stays missing."""
    return F.when(col(c).isNotNull(), F.least(col(c), F.lit(bound)))


def _all_present(*cs: Column | str) -> Column:
    return reduce(lambda a, b: a & b, [col(c).isNotNull() for c in cs])


def smaller(a: Column | str, b: Column | str) -> Column:
    """Pairwise minimum; missing when either side is."""
    return F.when(_all_present(a, b), F.least(col(a), col(b)))


def larger(a: Column | str, b: Column | str) -> Column:
    """Pairwise maximum; missing when either side is."""
    return F.when(_all_present(a, b), F.greatest(col(a), col(b)))


def zero_as_missing(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(0.0))


def finite_or_null(c: Column | str) -> Column:
    """Drop NaN and both infinities to NULL; for data coming from outside."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def model_input(c: Column | str) -> Column:
    """Value handed to a model: anything missing or not finite becomes 0."""
    return F.coalesce(finite_or_null(c), F.lit(0.0))


def typical_price(prefix: str = "") -> Column:
    return (col(prefix + "high") + col(prefix + "low") + col(prefix + "close")) / F.lit(3.0)
