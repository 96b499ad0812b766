"""Reading candles, instruments, seed history; writing bars and the signal log."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clock import bar_floor, in_session, minutes, session_open
from ..operators.history import newest
from ..schemas import (
    BAR,
    HISTORY_ROWS,
    INSTRUMENT,
    OHLC,
    SIGNAL,
    XSECTION_COLUMNS,
    SessionSpec,
    history_schema,
)

STORED = T.StructType([*BAR.fields, T.StructField("trade_date", T.DateType())])
DAY_COUNTS = "_day_counts"
DAY_COUNT = T.StructType(
    [
        T.StructField("series", T.StringType()),
        T.StructField("trade_date", T.DateType()),
        T.StructField("n", T.LongType()),
    ]
)


def time_range(rows: DataFrame, start: datetime, end: datetime, ts: str = "bar_ts") -> DataFrame:
    """Rows from ``start`` to ``end``, both included; the bounds reach the file scan."""
    return rows.where(F.col(ts).between(F.lit(start), F.lit(end)))


def up_to(rows: DataFrame, end: datetime, ts: str = "bar_ts") -> DataFrame:
    return rows.where(F.col(ts) <= F.lit(end))


def read_bars(
    spark: SparkSession,
    path: str,
    *,
    series: Sequence[str] | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Bars of some series in a time range.

    On a table written by ``write_bars`` the range also prunes day folders.
    """
    bars = spark.read.schema(STORED).parquet(path)
    if series is not None:
        bars = bars.where(F.col("series").isin(*series))
    if start is not None:
        bars = bars.where((F.col("bar_ts") >= F.lit(start)) & (F.col("trade_date") >= start.date()))
    if end is not None:
        bars = bars.where((F.col("bar_ts") <= F.lit(end)) & (F.col("trade_date") <= end.date()))
    return bars.drop("trade_date")


def write_bars(bars: DataFrame, path: str, mode: str = "append") -> None:
    """Store bars in day folders, and their row counts per (series, day) beside them.

    Rows are brought together by day first, so that there are few files; the rebalance hint lets
    Spark split a day that is too large for one task. ``bars`` is read twice: pass a stored
    table. Counts are written last, so after a failure in between there are too few of them,
    which costs readers pruning but no row.
    """
    counted = bars.groupBy("series", F.to_date("bar_ts").alias("trade_date")).agg(
        F.count(F.lit(1)).alias("n")
    )
    (
        bars.withColumn("trade_date", F.to_date("bar_ts"))
        .hint("rebalance", "trade_date")
        .write.mode(mode)
        .partitionBy("trade_date")
        .parquet(path)
    )
    # A name that starts with an underscore is no data to readers of ``path``.
    counted.write.mode(mode).parquet(f"{path}/{DAY_COUNTS}")


def day_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``n`` per (series, ``trade_date``) of a table written by ``write_bars``."""
    return spark.read.schema(DAY_COUNT).parquet(f"{path}/{DAY_COUNTS}")


def read_newest(spark: SparkSession, path: str, n: int = HISTORY_ROWS) -> DataFrame:
    """Newest ``n`` stored bars per series; only the days that hold one of them are read."""
    stored = spark.read.schema(STORED).parquet(path)
    return newest(stored, n, catalogue=day_counts(spark, path)).select(*BAR.names)


def read_seed_history(spark: SparkSession, path: str, prefix: str = "index_") -> DataFrame:
    """Seed history from CSV with a header; the first column is the bar time."""
    return (
        spark.read.schema(history_schema(prefix))
        .option("header", True)
        .option("enforceSchema", True)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(path)
    )


def write_seed_history(history: DataFrame, path: str, prefix: str = "index_") -> None:
    names = ["bar_ts", *[prefix + c for c in OHLC], *XSECTION_COLUMNS]
    (
        history.select(*names)
        .write.mode("errorifexists")
        .option("header", True)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(path)
    )


def read_instruments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INSTRUMENT).parquet(path)


def floor_bars(candles: DataFrame, spec: SessionSpec, ts: str = "bar_ts") -> DataFrame:
    """Candle times floored to the bar width."""
    return candles.withColumn(ts, bar_floor(ts, spec.bar_width))


def gate(bars: DataFrame, spec: SessionSpec, ts: str = "bar_ts") -> DataFrame:
    """Bars inside the daily gate, limits included."""
    return bars.where(in_session(ts, spec))


def since_open(bars: DataFrame, spec: SessionSpec, lead_minutes: int = 0) -> DataFrame:
    """Bars from the session open of their own day, or from ``lead_minutes`` before it."""
    start = session_open("bar_ts", spec) - minutes(lead_minutes)
    return bars.where(F.col("bar_ts") >= start)


def append_log(rows: DataFrame, path: str, system: str) -> None:
    """Append predictions to the log, one folder per day; columns ``timestamp, system, ...``."""
    rest = [c for c in rows.columns if c != "bar_ts"]
    (
        rows.select(
            F.col("bar_ts").alias("timestamp"),
            F.lit(system).alias("system"),
            *rest,
            F.to_date("bar_ts").alias("trade_date"),
        )
        .hint("rebalance", "trade_date")
        .write.mode("append")
        .partitionBy("trade_date")
        .parquet(path)
    )


def read_log(spark: SparkSession, path: str, schema: T.StructType = SIGNAL) -> DataFrame:
    """The log as ``append_log`` wrote it; ``schema`` is that of the rows appended.

    A log that no prediction reached has no day folder to infer a schema from, so it is given.
    """
    log = T.StructType(
        [
            T.StructField("timestamp", schema["bar_ts"].dataType),
            T.StructField("system", T.StringType()),
            *[f for f in schema.fields if f.name != "bar_ts"],
            T.StructField("trade_date", T.DateType()),
        ]
    )
    return spark.read.schema(log).parquet(path)
