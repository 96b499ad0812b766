"""Joins along time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import epoch_seconds


SPANS = 1024  # spans whose carried rows are found together


def left_on_time(bars: DataFrame, features: DataFrame, on: str = "bar_ts") -> DataFrame:
    """Every bar, with the features of exactly its time where there are any."""
    return bars.join(features, on, "left")


def complete_on_time(
    bars: DataFrame, features: DataFrame, columns: Sequence[str], on: str = "bar_ts"
) -> DataFrame:
    """Bars that have all of ``columns``: an inner join on complete feature rows."""
    return bars.join(features.na.drop("any", subset=list(columns)), on, "inner")


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    *,
    on: str = "bar_ts",
    by: Sequence[str] = (),
    columns: Sequence[str],
    matched: str = "feature_ts",
    tolerance: Column | None = None,
    span_seconds: int,
    sequence: str | None = None,
) -> DataFrame:
    """For each left row the newest right row at or before it; ``matched`` is that row's time.

    Time is cut into spans. Within a span a window finds the match; each span also takes the
    last right row of earlier spans, found on a table with one row per span, in two steps: within
    groups of ``SPANS`` spans, then over the groups. So no task needs all of history, and without
    ``by`` the work still spreads over spans. Both sides are read twice: pass stored tables.

    ``sequence`` is a column of the right side that orders its rows of equal time: the last one
    is the match. Without it one of them is.
    """
    tie = F.lit(0).cast("bigint") if sequence is None else F.col(sequence)
    keys = [*by, "_span"]
    span = F.floor(epoch_seconds(on) / span_seconds)
    payload = F.struct(F.col(on).alias(matched), *columns)
    lefts = left.select(
        *by, on, span.alias("_span"), F.lit(True).alias("_is_left"),
        F.struct(*left.columns).alias("_row"),
    )
    rights = right.select(
        *by, on, span.alias("_span"), F.lit(False).alias("_is_left"), payload.alias("_match"),
        tie.alias("_tie"),
    )
    stacked = lefts.unionByName(rights, allowMissingColumns=True)
    # false sorts before true: a right row at the same time is a match
    upto = (
        Window.partitionBy(*keys)
        .orderBy(on, "_is_left", "_tie")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    inside = stacked.withColumn("_match", F.last("_match", ignorenulls=True).over(upto)).where(
        "_is_left"
    )

    at = F.struct(on, "_tie") if sequence else F.col(on)
    tails = rights.groupBy(*keys).agg(F.max_by("_match", at).alias("_tail"))
    spans = (
        lefts.select(*keys).distinct().join(tails, keys, "full")
        .withColumn("_group", F.floor(F.col("_span") / SPANS))
    )

    last = F.when(F.col("_tail").isNotNull(), F.col("_span"))
    groups = spans.groupBy(*by, "_group").agg(F.max_by("_tail", last).alias("_tail"))
    all_before = Window.unboundedPreceding, -1
    in_group = Window.partitionBy(*by, "_group").orderBy("_span").rowsBetween(*all_before)
    by_group = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_group").rowsBetween(*all_before)
    before = groups.select(*by, "_group", F.last("_tail", ignorenulls=True).over(by_group).alias("_before"))
    inner = F.last("_tail", ignorenulls=True).over(in_group)
    carried = (
        spans.select(*keys, "_group", inner.alias("_inner"))
        .join(before, [*by, "_group"])
        .select(*keys, F.coalesce("_inner", "_before").alias("_carry"))
    )

    found = inside.join(carried, keys, "left").select(
        "_row.*", F.coalesce("_match", "_carry").alias("_match")
    )
    if tolerance is not None:
        near = F.col(on) - F.col(f"_match.{matched}") <= tolerance
        found = found.withColumn("_match", F.when(near, F.col("_match")))
    return found.select(
        *left.columns, *[F.col(f"_match.{c}").alias(c) for c in (matched, *columns)]
    )
