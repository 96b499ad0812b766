"""Row order and layout for series operators.

Series operators look back over rows of one series. Up to ``TASK_ROWS`` bars in all, one task
per series is fine and costs one shuffle. Beyond that nothing here puts a whole series into
one task: rows get their position in the series from per-block counts, are cut into blocks of
equal row count, and every block carries the few earlier rows its look-back needs (a halo).
A series that holds most of the table is then as parallel as many small ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.clock import epoch_seconds
from ..session import materialize

TASK_ROWS = 50_000   # bars of all series up to which one task per series is fine
BLOCK_ROWS = 4096    # bars per block beyond that


@dataclass(frozen=True)
class Ordered:
    """Bars with ``seq``, their 0-based position in the series.

    ``split`` says whether a series may span several blocks, ``rows`` how many bars there are in
    all, which bounds the length of a series.
    """

    df: DataFrame
    keys: tuple[str, ...]
    split: bool
    block_rows: int
    rows: int

    def with_df(self, df: DataFrame) -> Ordered:
        return replace(self, df=df)

    def derive(
        self, lookback: int, *levels: Callable[[WindowSpec], dict[str, Column]]
    ) -> Ordered:
        """Add columns level by level; a level may use the columns of those before it.

        All levels share one window (one shuffle, one sort). ``lookback`` is how many earlier
        rows the last level reaches through all levels together.
        """
        laid = _with_halo(self, lookback)
        window = Window.partitionBy(*self.keys, "_block").orderBy("seq")
        for level in levels:
            laid = laid.withColumns(level(window))
        return self.with_df(laid.where("_own").drop("_block", "_own"))


def ordered(
    bars: DataFrame,
    *,
    bar_seconds: int,
    keys: Sequence[str] = ("series",),
    order: str = "bar_ts",
    totals: dict[str, Column] | None = None,
    task_rows: int = TASK_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> Ordered:
    """Number the bars of each series and add running totals.

    ``bars`` should be a stored table: it is counted (a metadata read for parquet), and in the
    split layout it is read twice. ``(keys, order)`` must be unique and ``bar_seconds`` the
    bar width, so that a block of time holds at most ``block_rows`` rows. Totals skip missing
    values but are missing where their own value is.
    """
    rows = bars.count()
    split = rows > task_rows
    number = _number_split if split else _number_whole
    df = number(bars, tuple(keys), order, totals or {}, bar_seconds * block_rows)
    return Ordered(df, tuple(keys), split, block_rows, rows)


def _number_whole(
    bars: DataFrame, keys: tuple, order: str, totals: dict[str, Column], _span: int
) -> DataFrame:
    by_time = Window.partitionBy(*keys).orderBy(order)
    upto = by_time.rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumns(
        {"seq": F.row_number().over(by_time).cast("bigint") - 1}
        | {n: F.when(c.isNotNull(), F.sum(c).over(upto)) for n, c in totals.items()}
    )


def _number_split(
    bars: DataFrame, keys: tuple, order: str, totals: dict[str, Column], span: int
) -> DataFrame:
    """Counts and sums per (series, time block), their running values over the blocks, then
    the position inside the block. The offsets enter the in-block window as a row before the
    block's first, so they need no join and no shuffle of their own, and rows with a missing key
    or time keep theirs."""
    names = list(totals)
    spans = bars.withColumns(
        {"_span": F.floor(epoch_seconds(order) / span)}
        | {f"_v_{n}": c for n, c in totals.items()}
    )
    span_keys = [*keys, "_span"]
    sizes = spans.groupBy(*span_keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names]
    )
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        *span_keys,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0.0)).alias(f"_s0_{n}") for n in names],
    )
    inside = Window.partitionBy(*span_keys).orderBy("_bar", order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    both = spans.withColumn("_bar", F.lit(True)).unionByName(
        offsets.withColumn("_bar", F.lit(False)), allowMissingColumns=True
    )
    numbered = both.withColumns(
        {"seq": F.max("_n0").over(upto) + F.row_number().over(inside) - 2}
        | {
            n: F.when(
                F.col(f"_v_{n}").isNotNull(),
                F.max(f"_s0_{n}").over(upto) + F.sum(f"_v_{n}").over(upto),
            )
            for n in names
        }
    ).where("_bar")
    # Stored, because the plans that follow read it more than once.
    return materialize(numbered.select(*bars.columns, "seq", *names), "ordered")


def _with_halo(o: Ordered, lookback: int) -> DataFrame:
    if not o.split:
        return o.df.withColumns({"_block": F.lit(0).cast("bigint"), "_own": F.lit(True)})
    size = max(o.block_rows, lookback)
    home = F.floor(F.col("seq") / size)
    feeds_next = F.col("seq") % size >= size - lookback
    return (
        o.df.withColumn("_home", home)
        .withColumn(
            "_block",
            F.explode(
                F.when(feeds_next, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))
            ),
        )
        .withColumn("_own", F.col("_block") == F.col("_home"))
        .drop("_home")
    )
