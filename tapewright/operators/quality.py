"""Data-quality and coverage profiles as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_profile(rows: DataFrame, columns: Sequence[str], order: str, recent: int = 10) -> DataFrame:
    """One row per column: ``rows, missing, all_missing, missing_in_last, present_recent``.

    One pass of counts, and a top-k for the newest rows, which Spark takes per partition
    before merging.
    """
    whole = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in columns],
    ).unpivot("rows", list(columns), "column", "missing")
    tail = rows.select(order, *columns).orderBy(F.desc(order)).limit(recent)
    newest = tail.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.count(c).alias("present_recent"),
                    F.max_by(F.col(c).isNull(), order).cast("int").alias("missing_in_last"),
                )
                for c in columns
            ]
        ).alias("profile")
    ).select(F.inline("profile"))
    return whole.join(newest, "column").select(
        "column",
        "rows",
        "missing",
        (F.col("missing") == F.col("rows")).cast("int").alias("all_missing"),
        "missing_in_last",
        "present_recent",
    )


def members_per_bar(bars: DataFrame, *, approximate: bool = False) -> DataFrame:
    """Distinct symbols at each bar time; ``approximate`` counts with a sketch."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    return bars.groupBy("bar_ts").agg(count("series").alias("symbols"))


def bars_per_symbol(bars: DataFrame) -> DataFrame:
    return bars.groupBy("series").agg(F.count(F.lit(1)).alias("bars"))


def coverage_summary(bars: DataFrame) -> DataFrame:
    """Count, mean, spread and quartiles of the bars per symbol."""
    b = F.col("bars").cast("double")
    return bars_per_symbol(bars).agg(
        F.count(b).alias("symbols"),
        F.avg(b).alias("mean_bars"),
        F.stddev_samp(b).alias("std_bars"),
        F.min(b).alias("min_bars"),
        F.percentile(b, 0.25).alias("q25_bars"),
        F.percentile(b, 0.5).alias("median_bars"),
        F.percentile(b, 0.75).alias("q75_bars"),
        F.max(b).alias("max_bars"),
    )
