"""Ticks to OHLCV bars, and bars of many series to one index bar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import bar_floor, in_order
from ..functions.columns import col


def build_bars(
    ticks: DataFrame,
    width: str,
    *,
    series: Column | str = "event_type",
    ts: str = "ts",
    price: str = "value",
    volume: Column | str | None = None,
    sequence: Column | str | None = None,
) -> DataFrame:
    """One bar per (series, bar time).

    Every aggregate keeps a fixed-width buffer, so Spark combines ticks on the map side in a
    hash aggregate: a series or a bar holding a third of all ticks reaches the shuffle as at
    most one row per map task and bar. ``open_ts``/``close_ts`` make the result mergeable
    (see ``merge_series``). Ticks without a time or price form no bar.

    ``sequence``, an integer, orders ticks of equal time, so that open and close don't depend on
    how the ticks are laid out; bars then carry ``open_key`` and ``close_key``, by which merging
    them keeps that order. Without it one of the first (last) ticks gives the open (close).
    """
    slim = ticks.where(col(ts).isNotNull() & col(price).isNotNull()).select(
        col(series).alias("series"),
        bar_floor(ts, width).alias("bar_ts"),
        *tick_columns(ts, price, volume, sequence),
    )
    return slim.groupBy("series", "bar_ts").agg(*bar_columns(sequence is not None))


def tick_columns(
    ts: str, price: str, volume: Column | str | None, sequence: Column | str | None = None
) -> list[Column]:
    key = [] if sequence is None else [in_order(ts, sequence).alias("_key")]
    quantity = F.lit(1.0) if volume is None else col(volume).cast("double")
    return [
        col(ts).alias("_at"),
        col(price).cast("double").alias("_price"),
        quantity.alias("_quantity"),
        *key,
    ]


def bar_columns(sequenced: bool = False) -> list[Column]:
    order = "_key" if sequenced else "_at"
    return [
        F.min_by("_price", order).alias("open"),
        F.max("_price").alias("high"),
        F.min("_price").alias("low"),
        F.max_by("_price", order).alias("close"),
        F.sum("_quantity").alias("volume"),
        F.min("_at").alias("open_ts"),
        F.max("_at").alias("close_ts"),
        *([F.min("_key").alias("open_key"), F.max("_key").alias("close_key")] if sequenced else []),
    ]


def _merged(bars: DataFrame) -> list[Column]:
    """Aggregates that make one bar of several."""
    sequenced = "open_key" in bars.columns
    first, last = ("open_key", "close_key") if sequenced else ("open_ts", "close_ts")
    return [
        F.min_by("open", first).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", last).alias("close"),
        F.sum("volume").alias("volume"),
    ]


def merge_bars(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bars from partial bars with the same ``keys``, whose ticks don't overlap."""
    return parts.groupBy(*keys).agg(
        *_merged(parts), F.min("open_ts").alias("open_ts"), F.max("close_ts").alias("close_ts")
    )


def merge_series(bars: DataFrame, name: str) -> DataFrame:
    """All series together as one series ``name``: bars of bars, no second tick scan.

    A merged bar is final (``is_final``, where the column exists) when all its parts are.
    """
    final = [F.every("is_final").alias("is_final")] if "is_final" in bars.columns else []
    return (
        bars.groupBy("bar_ts")
        .agg(
            *_merged(bars),
            *final,
        )
        .select(F.lit(name).alias("series"), "*")
    )


def with_prefix(bars: DataFrame, prefix: str) -> DataFrame:
    """Rename the OHLC columns, e.g. ``close`` to ``index_close``."""
    return bars.withColumnsRenamed({c: prefix + c for c in ("open", "high", "low", "close")})
