"""The bar history: stacking, one row per key, newest rows, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import key_of
from ..schemas import HISTORY_ROWS
from ..session import materialize


def _pick(rows: DataFrame, keys: Sequence[str], fn, arrival: Sequence[str]) -> DataFrame:
    """One row per key: the smallest or largest by ``arrival``, then by the other columns.

    An aggregate, not a window: copies of a key are reduced before the shuffle, so a key that
    holds a third of all rows costs one row per map task.
    """
    rest = [c for c in rows.columns if c not in keys and c not in arrival]
    best = fn(F.struct(*arrival, *rest)).alias("_row")
    return rows.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*rows.columns)


def keep_first(rows: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """First arrival per key; equal arrivals are told apart by the remaining columns."""
    return _pick(rows, keys, F.min, arrival)


def keep_last(rows: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """Last arrival per key; equal arrivals are told apart by the remaining columns."""
    return _pick(rows, keys, F.max, arrival)


def stack(*frames: DataFrame) -> DataFrame:
    """All rows of all frames by column name; a column a frame lacks is missing there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def days_needed(counts: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """Of row counts ``_n`` per (keys, ``_day``): the days that can hold one of the newest ``n``
    rows, with ``_after``, the number of rows on later days. Rows without a day are the oldest."""
    later = Window.partitionBy("_key").orderBy(F.desc("_day"))
    after = F.coalesce(F.sum("_n").over(later.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        counts.groupBy(key_of(*keys).alias("_key"), "_day")
        .agg(F.sum("_n").alias("_n"))
        .select("_key", "_day", after.alias("_after"))
        .where(F.col("_after") < n)
    )


def newest(
    rows: DataFrame,
    n: int = HISTORY_ROWS,
    *,
    keys: Sequence[str] = ("series",),
    order: str = "bar_ts",
    catalogue: DataFrame | None = None,
) -> DataFrame:
    """Newest ``n`` rows per series.

    Row counts per day tell from which day on rows can matter at all, so only those days are
    ranked. ``rows`` is read twice: pass a stored table. If it is partitioned by ``trade_date``
    (the day of ``order``), the join on it prunes the scan while the query runs. With
    ``catalogue``, counts ``n`` per (keys, ``trade_date``) as ``write_bars`` stores them, nothing
    is counted, and the days reach the scan as literals; it must not count rows that are not
    there. Rows with a missing key are a series of their own; those without a time are its oldest.
    """
    placed = "trade_date" in rows.columns
    day = F.col("trade_date") if placed else F.to_date(order)
    dated = rows.withColumns({"_key": key_of(*keys), "_day": day})
    if catalogue is not None:
        counts = catalogue.select(*keys, F.col("trade_date").alias("_day"), F.col("n").alias("_n"))
    else:
        counts = dated.groupBy(*keys, "_day").agg(F.count(F.lit(1)).alias("_n"))
    needed = days_needed(counts, n, keys)
    known = dated.where(F.col("_day").isNotNull())
    if placed and catalogue is not None:
        # One row per day of the calendar at most.
        days = [r["_day"] for r in needed.select("_day").distinct().where("_day IS NOT NULL").collect()]
        known = known.where(F.col("trade_date").isin(days))
    left = known.join(needed.where(F.col("_day").isNotNull()), ["_key", "_day"])
    timeless = dated.where(F.col("_day").isNull()).join(
        needed.where(F.col("_day").isNull()).drop("_day"), "_key"
    )
    in_day = Window.partitionBy("_key", "_day").orderBy(F.desc(order))
    return (
        left.select(*rows.columns, "_key", "_day", "_after")
        .unionByName(timeless.select(*rows.columns, "_key", "_day", "_after"))
        .withColumn("_rank", F.col("_after") + F.row_number().over(in_day))
        .where(F.col("_rank") <= n)
        .select(*rows.columns)
    )


def last_bar(
    rows: DataFrame, *, back: int = 0, keys: Sequence[str] = ("series",), order: str = "bar_ts"
) -> DataFrame:
    """Last row per series, or the one ``back`` rows before it."""
    if back == 0:
        return _pick(rows, keys, F.max, [order])
    tail = newest(rows, back + 1, keys=keys, order=order)
    by_age = Window.partitionBy(*keys).orderBy(F.desc(order))
    return (
        tail.withColumn("_age", F.row_number().over(by_age))
        .where(F.col("_age") == back + 1)
        .drop("_age")
    )


def overlay(
    history: DataFrame, fresh: DataFrame, *, keys: Sequence[str] = ("series", "bar_ts")
) -> DataFrame:
    """History with fresh rows laid over it: same keys replaced, new keys added.

    Used as it is for a provisional bar, which is never stored.
    """
    both = stack(
        history.withColumn("_arrival", F.lit(0)), fresh.withColumn("_arrival", F.lit(1))
    )
    return keep_last(both, keys, ["_arrival"]).drop("_arrival")


def upsert(
    history: DataFrame,
    fresh: DataFrame,
    *,
    keys: Sequence[str] = ("series",),
    order: str = "bar_ts",
    rows: int = HISTORY_ROWS,
) -> DataFrame:
    """Overlay, then keep the newest ``rows`` bars per series. Applying it twice changes nothing.

    The merged rows are stored in between, because the cut reads them twice.
    """
    merged = materialize(overlay(history, fresh, keys=[*keys, order]), "merged")
    return newest(merged, rows, keys=keys, order=order)


def with_min_history(rows: DataFrame, n: int, *, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Rows of series that have at least ``n`` of them."""
    keyed = rows.withColumn("_key", key_of(*keys))
    enough = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n)
    return keyed.join(enough, "_key", "left_semi").select(*rows.columns)
