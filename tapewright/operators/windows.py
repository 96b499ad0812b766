"""Row-frame series operators as columns over a given window.

A rolling value is missing unless its frame holds ``min_periods`` present values; the default
is the full width.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import col, div


def lag(c: Column | str, k: int, w: WindowSpec) -> Column:
    return F.lag(col(c), k).over(w)


def diff(c: Column | str, k: int, w: WindowSpec) -> Column:
    return col(c) - lag(c, k, w)


def pct_change(c: Column | str, k: int, w: WindowSpec) -> Column:
    """Relative change over k rows; no padding across missing values."""
    return div(c, lag(c, k, w)) - 1


def rolling(
    fn: Callable[[Column], Column],
    c: Column | str,
    n: int,
    w: WindowSpec,
    *,
    min_periods: int | None = None,
    skip: int = 0,
) -> Column:
    """``fn`` over n rows ending ``skip`` rows before the current one."""
    frame = w.rowsBetween(-(n - 1) - skip, -skip)
    enough = F.count(col(c)).over(frame) >= (n if min_periods is None else min_periods)
    return F.when(enough, fn(col(c)).over(frame))


def rolling_mean(c: Column | str, n: int, w: WindowSpec, **kw: int) -> Column:
    return rolling(F.avg, c, n, w, **kw)


def rolling_sum(c: Column | str, n: int, w: WindowSpec, **kw: int) -> Column:
    return rolling(F.sum, c, n, w, **kw)


def rolling_std(c: Column | str, n: int, w: WindowSpec, **kw: int) -> Column:
    """Sample standard deviation."""
    return rolling(F.stddev_samp, c, n, w, **kw)


def rolling_max(c: Column | str, n: int, w: WindowSpec, **kw: int) -> Column:
    return rolling(F.max, c, n, w, **kw)


def rolling_min(c: Column | str, n: int, w: WindowSpec, **kw: int) -> Column:
    return rolling(F.min, c, n, w, **kw)


def rolling_quantile(c: Column | str, n: int, q: float, w: WindowSpec, **kw: int) -> Column:
    """Exact quantile with linear interpolation."""
    return rolling(lambda x: F.percentile(x, q), c, n, w, **kw)


def zscore(c: Column | str, n: int, w: WindowSpec) -> Column:
    """Distance from the rolling mean in sample standard deviations, over a full frame.

    One count guards both statistics: every aggregate of a frame is updated for each of its
    rows, so each one less counts n times per row.
    """
    frame = w.rowsBetween(-(n - 1), 0)
    distance = div(col(c) - F.avg(col(c)).over(frame), F.stddev_samp(col(c)).over(frame))
    return F.when(F.count(col(c)).over(frame) >= n, distance)


def true_range(high: str, low: str, close: str, w: WindowSpec) -> Column:
    """Largest of the three ranges that are present; high - low on the first row."""
    last = lag(close, 1, w)
    return F.greatest(
        col(high) - col(low), F.abs(col(high) - last), F.abs(col(low) - last)
    )


def reference_levels(
    high: str, low: str, w: WindowSpec, rows: int, is_final: Column | None = None
) -> tuple[Column, Column]:
    """Highest high and lowest low of the ``rows`` bars before the current one.

    A provisional bar is not in the history the levels come from, so for it the frame lies
    one bar further back.
    """

    def level(fn: Callable[[Column], Column], c: str) -> Column:
        final = fn(col(c)).over(w.rowsBetween(-rows, -1))
        if is_final is None:
            return final
        return F.when(is_final, final).otherwise(fn(col(c)).over(w.rowsBetween(-rows - 1, -2)))

    return level(F.max, high), level(F.min, low)
