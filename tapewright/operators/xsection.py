"""Columns per symbol and aggregates across symbols at one bar time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import div, flag, join_on, sign, typical_price, zero_as_missing
from ..schemas import (
    ADV_MIN_PERIODS,
    ADV_WINDOW,
    BREADTH_THRESHOLD,
    XSECTION_COLUMNS,
)
from .blocks import Ordered
from .spread import GROUP_ROWS, tail_spread, tail_spread_by_rank
from .windows import pct_change, rolling_mean

LOADINGS = T.StructType(
    [
        T.StructField("series", T.StringType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("weight", T.DoubleType()),
    ]
)


def symbol_columns(
    bars: DataFrame | Ordered, *, adv_window: int = ADV_WINDOW, threshold: float = BREADTH_THRESHOLD
) -> DataFrame:
    """``vwap, adv, norm_vol, ret, active, vwap_pressure`` per symbol and bar.

    A DataFrame is reset every trading day, so a window never holds more than the bars of one
    symbol and day. ``Ordered`` bars run on across days in blocks.
    """

    def level(w) -> dict[str, Column]:
        average = rolling_mean("volume", adv_window, w, min_periods=ADV_MIN_PERIODS)
        return {"adv": zero_as_missing(average), "ret": pct_change("close", 1, w)}

    if isinstance(bars, Ordered):
        windowed = bars.derive(adv_window, level).df
    else:
        daily = bars.withColumn("trade_date", F.to_date("bar_ts"))
        windowed = daily.withColumns(
            level(Window.partitionBy("series", "trade_date").orderBy("bar_ts"))
        )
    return (
        windowed.withColumn("vwap", typical_price())
        .withColumn("norm_vol", div("volume", "adv"))
        .withColumns(
            {
                "active": flag(F.col("norm_vol") > threshold),
                "vwap_pressure": div(F.col("close") - F.col("vwap"), "vwap"),
            }
        )
    )


def advance_decline(ret: str = "ret", volume: str = "volume") -> Column:
    """Volume of advancers over volume of decliners; missing without either."""
    up = F.sum(F.when(F.col(ret) > 0, F.col(volume)))
    down = F.sum(F.when(F.col(ret) < 0, F.col(volume)))
    return F.try_divide(up, down)


def share_positive(c: str) -> Column:
    return F.avg(flag(F.col(c) > 0))


def share_with_mean_sign(c: str) -> Column:
    """Share of members whose sign is that of the group mean.

    Counts per sign and the mean are plain sums, so the group is combined before the shuffle.
    """
    mean_sign = sign(F.avg(c))
    same = (
        F.when(mean_sign > 0, F.count_if(F.col(c) > 0))
        .when(mean_sign < 0, F.count_if(F.col(c) < 0))
        .when(mean_sign == 0, F.count_if(F.col(c) == 0))
        .otherwise(F.lit(0))
    )
    return same / F.count(F.lit(1))


def cross_section(
    symbols: DataFrame,
    *,
    universe: Sequence[str] | None = None,
    loadings: DataFrame | None = None,
) -> DataFrame:
    """One row per bar time with the cross-section columns.

    All columns except the spreads are sums and counts that combine before the shuffle. With a
    declared ``universe`` of bounded size a bar has at most that many rows, and one grouping
    yields the spreads too; without one they are ranked in pieces.
    """
    members = symbols if universe is None else symbols.where(F.col("series").isin(*universe))
    bounded = universe is not None and len(universe) <= GROUP_ROWS
    columns = [
        F.avg("norm_vol").alias("eq_norm_volume"),
        F.avg("active").alias("liquidity_breadth"),
        advance_decline().alias("adv_dec_volume_ratio"),
        F.avg("vwap_pressure").alias("_mean_pressure"),
        share_positive("vwap_pressure").alias("pct_vwap_up"),
        F.stddev_samp("vwap_pressure").alias("vwap_disp"),
        share_with_mean_sign("vwap_pressure").alias("pct_flow_align"),
    ]
    if bounded:
        columns += [
            F.collect_list("vwap_pressure").alias("_pressures"),
            F.collect_list("ret").alias("_returns"),
        ]
    grouped, names = members, list(XSECTION_COLUMNS)
    if loadings is None:
        names.remove("vwap_pca1")
    else:
        grouped = members.join(loadings, "series", "left")
        columns.append(projection().alias("_projected"))
    rows = grouped.groupBy("bar_ts").agg(*columns)
    rows = rows.withColumnRenamed("_mean_pressure", "vwap_pressure")
    if bounded:
        rows = tail_spread(rows, {"_pressures": "vwap_tb_spread", "_returns": "ret_tb_spread"})
    if loadings is not None:
        rows = rows.withColumn("vwap_pca1", F.col("_projected") - centre(loadings))
    if not bounded:
        for source, out in (("vwap_pressure", "vwap_tb_spread"), ("ret", "ret_tb_spread")):
            rows = join_on(rows, tail_spread_by_rank(members, ["bar_ts"], source, out), ["bar_ts"], "left")
    return rows.select("bar_ts", *names)


def projection(value: str = "vwap_pressure") -> Column:
    """Weighted sum over the members present; a member without a bar counts as value 0.

    The fitted means enter once for the whole universe (see ``centre``), so the long form
    gives what the dense matrix would, and no matrix is built.
    """
    return F.sum(F.coalesce(F.col(value) * F.col("weight"), F.lit(0.0)))


def centre(loadings: DataFrame) -> Column:
    """Score of the fitted means, as a scalar subquery."""
    return loadings.agg(F.sum(F.col("mean") * F.col("weight"))).scalar()


def project(symbols: DataFrame, loadings: DataFrame, value: str = "vwap_pressure") -> DataFrame:
    """First-component score ``vwap_pca1`` per bar time. ``loadings``: series, mean, weight."""
    return (
        symbols.join(loadings, "series", "left")
        .groupBy("bar_ts")
        .agg(projection(value).alias("_projected"))
        .select("bar_ts", (F.col("_projected") - centre(loadings)).alias("vwap_pca1"))
    )


def pivot_symbols(
    symbols: DataFrame, universe: Sequence[str], value: str = "vwap_pressure"
) -> DataFrame:
    """Dense matrix, one column per symbol of the universe; a repeated cell is an error."""
    only = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("repeated (bar_ts, series)")))
    cell = F.coalesce(only.cast("double"), F.first(value))
    return (
        symbols.where(F.col("series").isin(*universe))
        .groupBy("bar_ts")
        .pivot("series", list(universe))
        .agg(cell)
    )


def fit_cross_section_pca(
    symbols: DataFrame, universe: Sequence[str], value: str = "vwap_pressure"
) -> DataFrame:
    """Loadings (series, mean, weight) of the first principal component.

    The covariance over bar times is a distributed sum; the driver sees only the
    universe-sized result. The component's sign is fixed: its largest weight is positive.
    """
    spark = symbols.sparkSession
    names = [f"m{i}" for i in range(len(universe))]
    wide = pivot_symbols(symbols, universe, value).fillna(0.0)
    wide = wide.select(*[F.col(f"`{s}`").alias(n) for s, n in zip(universe, names, strict=True)])
    vectors = VectorAssembler(inputCols=names, outputCol="v").transform(wide).select("v", *names)
    means = vectors.agg(*[F.avg(n).alias(n) for n in names]).first()
    weights = PCA(k=1, inputCol="v", outputCol="p").fit(vectors).pc.toArray()[:, 0]
    if weights[abs(weights).argmax()] < 0:
        weights = -weights
    rows = [
        (s, float(means[n]), float(x)) for s, n, x in zip(universe, names, weights, strict=True)
    ]
    return spark.createDataFrame(rows, LOADINGS)
