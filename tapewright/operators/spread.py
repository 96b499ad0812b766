"""Top-minus-bottom spread of a group: mean of the values at or above the (1-q) quantile less
the mean of those at or below the q quantile, quantiles exact and linearly interpolated.

Two forms with equal results. ``tail_spread`` holds a group's values in one array and is for
groups with a known bound (a declared universe of symbols). ``tail_spread_by_rank`` works for
groups of any size, including one that holds most of the table: it narrows the ranges of values
that hold the wanted ranks, level by level, until each fits a task. A group without a value has
a row with a missing spread in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import join_on, key_of
from ..session import materialize

GROUP_ROWS = 20_000   # values of one group that may sit in one array, or be ranked by one task
PIECES = 64           # pieces a range of more values is cut into, per level


def _edges(ordered: Column, q: float) -> tuple[Column, Column, Column]:
    """Quantile of a sorted array and its two neighbours."""
    at = (F.size(ordered) - 1) * F.lit(q)
    below = F.floor(at).cast("int")
    a = F.get(ordered, below)
    b = F.coalesce(F.get(ordered, below + 1), a)
    return F.when(at == below, a).otherwise(a + (b - a) * (at - below)), a, b


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(total, F.size(values))


def _spread_of_sorted(ordered: Column, q: float) -> Column:
    """The tails are slices of the sorted array, found by position. (A test of each element
    against the quantile would work out the quantile once per element.)"""
    high, a, b = _edges(ordered, 1 - q)
    first = F.array_position(ordered, F.when(a >= high, a).otherwise(b)).cast("int")
    low, c, d = _edges(ordered, q)
    falling = F.reverse(ordered)
    skipped = F.array_position(falling, F.when(d <= low, d).otherwise(c)).cast("int") - 1
    n = F.size(ordered)
    top = F.slice(ordered, first, n - first + 1)
    bottom = F.slice(ordered, F.lit(1), n - skipped)
    return F.when(n > 0, _mean(top) - _mean(bottom))


def tail_spread(grouped: DataFrame, arrays: dict[str, str], q: float = 0.2) -> DataFrame:
    """Replace array columns (name -> name of the result) by the spread of their values.

    The arrays come from ``collect_list`` over bounded groups in an earlier aggregation: one
    buffer per group and column, sorted once.
    """
    ordered = grouped.withColumns({a: F.sort_array(a) for a in arrays})
    spreads = {out: _spread_of_sorted(F.col(a), q) for a, out in arrays.items()}
    return ordered.withColumns(spreads).drop(*arrays)


def tail_spread_by_rank(
    rows: DataFrame,
    group: list[str],
    value: str,
    out: str,
    q: float = 0.2,
    *,
    pieces: int = PIECES,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row per group with the spread of ``value``, for groups without a size bound.

    Equal values are counted first, and the counts are stored: ``rows`` is read once. Each group
    starts as one range of values. Ranges of more than ``group_rows`` distinct values are cut at
    approximate quantiles of their own values, the pieces are counted exactly, and only those
    that hold a wanted rank go on; each level divides by ``pieces``. What is left is ranked, a
    range a task. Cut points only steer: ranks come from counts and are exact.
    """
    counted = materialize(
        rows.groupBy(*group, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "counted"
    )
    present = F.col("_v").isNotNull()
    ranges = counted.groupBy(*group).agg(
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
        F.lit(0).cast("bigint").alias("_below"),
        F.count("_v").alias("_distinct"),
        F.coalesce(F.sum(F.when(present, F.col("_n"))), F.lit(0)).alias("_size"),
    )
    ranges = materialize(ranges.where("_size > 0"), "ranges")
    largest, before = _largest(ranges), None
    while largest > group_rows and (before is None or largest < before):
        large = F.col("_distinct") > group_rows
        narrowed = _narrow(counted, ranges.where(large), group, q, max(pieces, 2))
        ranges = materialize(ranges.where(~large).unionByName(narrowed), "ranges")
        largest, before = _largest(ranges), largest

    inside = Window.partitionBy(key_of(*group, "_below")).orderBy("_v")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    ranked = _within(counted, ranges, group).withColumn("_next", F.col("_below") + F.sum("_n").over(upto))

    def level(p: float, name: str) -> tuple[list[Column], Column]:
        at, low, high = _ranks(p)
        covers = lambda r: (F.col("_next") - F.col("_n") <= r) & (r < F.col("_next"))
        picked = [
            F.max(F.when(covers(low), F.col("_v"))).alias(f"_{name}a"),
            F.max(F.when(covers(high), F.col("_v"))).alias(f"_{name}b"),
            F.max(at - low).alias(f"_{name}f"),
        ]
        a, b, f = (F.col(f"_{name}{x}") for x in "abf")
        return picked, F.when(f == 0, a).otherwise(a + (b - a) * f)

    high_parts, high = level(1 - q, "h")
    low_parts, low = level(q, "l")
    levels = ranked.groupBy(*group).agg(*high_parts, *low_parts).select(
        *group, high.alias("_high"), low.alias("_low")
    )
    v, n = F.col("_v"), F.col("_n")

    def weighted(condition: Column) -> Column:
        return F.try_divide(F.sum(F.when(condition, v * n)), F.sum(F.when(condition, n)))

    # Stored, so that the join with the counted values knows the size of one row per group.
    levels = materialize(levels, "levels")
    return join_on(counted, levels, group, "left").groupBy(*group).agg(
        (weighted(v >= F.col("_high")) - weighted(v <= F.col("_low"))).alias(out)
    )


def _largest(ranges: DataFrame) -> int:
    return ranges.agg(F.max("_distinct")).first()[0] or 0


def _ranks(p: float) -> tuple[Column, Column, Column]:
    """Place of the ``p`` quantile among ``_size`` values from 0, and the ranks beside it."""
    at = (F.col("_size") - 1) * F.lit(p)
    low = F.floor(at)
    return at, low, F.least(low + 1, F.col("_size") - 1)


def _within(counted: DataFrame, ranges: DataFrame, group: list[str]) -> DataFrame:
    """Counted values with each range (of their group) that they lie in."""
    return join_on(counted, ranges, group).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))


def _narrow(counted: DataFrame, ranges: DataFrame, group: list[str], q: float, pieces: int) -> DataFrame:
    """The pieces of ``ranges`` that hold a wanted rank, with their own bounds and counts."""
    steps = [i / pieces for i in range(1, pieces)]
    named = [*group, "_below", "_lo", "_hi", "_size"]
    cuts = (
        _within(counted, ranges, group)
        .groupBy(*named)
        .agg(F.percentile_approx("_v", steps, 10 * pieces).alias("_cuts"))
    )
    # Stored: small, of known size for the join, and the same at each reading.
    cuts = materialize(cuts, "cuts")
    piece = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    counts = (
        _within(counted, cuts, group)
        .groupBy(*group, "_below", "_size", piece.alias("_piece"))
        .agg(
            F.min("_v").alias("_lo"),
            F.max("_v").alias("_hi"),
            F.count(F.lit(1)).alias("_distinct"),
            F.sum("_n").alias("_rows"),
        )
    )
    earlier = Window.partitionBy(key_of(*group, "_below")).orderBy("_piece")
    first = F.col("_below") + F.coalesce(
        F.sum("_rows").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    wanted = F.array(*[r for p in (q, 1 - q) for r in _ranks(p)[1:]])
    holds = F.exists(wanted, lambda r: (r >= F.col("_first")) & (r < F.col("_first") + F.col("_rows")))
    return (
        counts.withColumn("_first", first)
        .where(holds)
        .select(*group, "_lo", "_hi", F.col("_first").alias("_below"), "_distinct", "_size")
    )
