"""The index feature frame.

Each column is defined once, in dependency levels; every level is one projection over the
same window, so the frame costs one shuffle for the windows plus those of the weighted means.
Names that end up in no model are intermediate values a user may still select.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.clock import minute_of_day
from ..functions.columns import (
    clip_above,
    clip_below,
    differs,
    div,
    flag,
    larger,
    sign,
    smaller,
    typical_price,
)
from ..operators.blocks import Ordered, ordered
from ..operators.ewm import Ewm, ewm_means
from ..operators.windows import (
    diff,
    lag,
    pct_change,
    rolling_max,
    rolling_mean,
    rolling_min,
    rolling_quantile,
    rolling_std,
    rolling_sum,
    true_range,
    zscore,
)
from ..schemas import ATR_ROWS, RUNNING_TYPICAL_BASE, SessionSpec

LOOKBACK = 64  # rows the deepest column reaches back is 55


@dataclass(frozen=True)
class FeatureSpec:
    """Options of the frame; the defaults are the parity settings."""

    prefix: str = "index_"
    session: SessionSpec = field(default_factory=SessionSpec)
    running_base: float = RUNNING_TYPICAL_BASE
    keys: tuple[str, ...] = ("series",)
    # True compares the close with the 20 rows before it; by default the frame includes the
    # current row, so that a breakout cannot happen on a valid bar.
    breakout_excludes_current: bool = False


def order_history(history: DataFrame, spec: FeatureSpec = FeatureSpec(), **layout) -> Ordered:
    """Number the bars and add the running typical price (see ``ordered`` for layout)."""
    return ordered(
        history,
        keys=spec.keys,
        bar_seconds=spec.session.bar_seconds,
        totals={"_typical_total": typical_price(spec.prefix)},
        **layout,
    )


def feature_frame(bars: Ordered, spec: FeatureSpec = FeatureSpec()) -> Ordered:
    """Every derived column, on every row (nothing dropped).

    ``bars`` come from ``order_history`` and hold index OHLC and the cross-section columns.
    """
    p, s = spec.prefix, spec.session
    o, h, l, c = (p + name for name in ("open", "high", "low", "close"))
    ret = p + "ret"

    def raw(_: WindowSpec) -> dict[str, Column]:
        minutes = minute_of_day("bar_ts")
        since_open = minutes - s.open_minute
        return {
            "trade_date": F.to_date("bar_ts"),
            p + "vwap": F.col("_typical_total") + F.lit(spec.running_base),
            "vwap": typical_price(p),
            "range": F.col(h) - F.col(l),
            "up_range": F.col(h) - F.col(o),
            "dn_range": F.col(o) - F.col(l),
            "lower_wick": smaller(o, c) - F.col(l),
            "upper_wick": F.col(h) - larger(o, c),
            "tod_norm": minutes / s.day_minutes,
            "minutes_since_open": since_open,
            "session_frac": since_open / s.session_minutes,
            "flow_dir": sign("vwap_pressure")
            + sign(F.col("adv_dec_volume_ratio") - 1)
            + sign(F.col("liquidity_breadth") - 0.5),
        }

    means = [Ewm(f"_ema{n}", c, n, True) for n in (5, 15, 30)]
    for n in (3, 6, 12):
        means += [
            Ewm(f"vwap_pressure_ema{n}", "vwap_pressure", n, False),
            Ewm(f"breadth_ema{n}", "liquidity_breadth", n, False),
            Ewm(f"advdec_ema{n}", "adv_dec_volume_ratio", n, False),
        ]
    means += [Ewm(f"flow_dir_ema{n}", "flow_dir", n, False) for n in (6, 12)]

    def steps(w: WindowSpec) -> dict[str, Column]:
        """Lags and differences of inputs, and row arithmetic on the raw level."""
        typical = F.col("vwap")
        last_typical = F.coalesce(lag("vwap", 1, w), F.lit(0.0))
        last_two = typical + last_typical
        # Differences of the running total, written as short sums: the base cancels and the
        # result keeps its digits.
        slope = last_two + F.coalesce(lag("vwap", 2, w), F.lit(0.0))
        distance_step = F.when(lag("vwap", 2, w).isNotNull(), diff(c, 2, w) - last_two)
        return {
            ret: pct_change(c, 1, w),
            "mom_3": pct_change(c, 3, w),
            "mom_6": pct_change(c, 6, w),
            "price_vel": diff(c, 3, w),
            "vwap_slope": F.when(lag("vwap", 3, w).isNotNull(), slope),
            "vwap_dist": div(F.col(c) - typical, typical),
            "vwap_pca_slope": diff("vwap_pca1", 3, w),
            "vwap_pressure_accel": diff("vwap_pressure", 2, w),
            "breadth_accel": diff("liquidity_breadth", 2, w),
            "advdec_accel": diff("adv_dec_volume_ratio", 2, w),
            "range_skew": F.col("up_range") - F.col("dn_range"),
            "wick_skew": F.col("upper_wick") - F.col("lower_wick"),
            "_distance": F.col(c) - F.col(p + "vwap"),
            "_distance_step": distance_step,
            "_true_range": true_range(h, l, c, w),
            **{f"ema{n}_slope": diff(f"_ema{n}", 1, w) for n in (5, 15, 30)},
        }

    def rolled(w: WindowSpec) -> dict[str, Column]:
        """Rolling values of inputs and of the steps."""
        skip = 1 if spec.breakout_excludes_current else 0
        means_of_six = {
            "range_skew_30m": "range_skew",
            "wick_skew_30m": "wick_skew",
            "vwap_disp_ma": "vwap_disp",
            "vwap_tb_ma": "vwap_tb_spread",
            "ret_tb_ma": "ret_tb_spread",
            "flow_align_ma": "pct_flow_align",
            "breadth_ma": "liquidity_breadth",
        }
        scored = ("vwap_pressure", "liquidity_breadth", "adv_dec_volume_ratio", "eq_norm_volume")
        return {
            **{out: rolling_mean(source, 6, w) for out, source in means_of_six.items()},
            **{f"{name}_z": zscore(name, 48, w) for name in scored},
            "ret1": F.col(ret),
            "down_mom": F.col("price_vel"),
            "pos_ret_30m": rolling_sum(clip_below(ret), 6, w),
            "neg_ret_30m": rolling_sum(-clip_above(ret) + F.lit(0.0), 6, w),
            "vol_12": rolling_std(ret, 12, w),
            "vol_48": rolling_std(ret, 48, w),
            "range_z20": zscore("range", 20, w),
            "atr": rolling_mean("_true_range", ATR_ROWS, w),
            "open_range": rolling_max(h, 6, w) - rolling_min(l, 6, w),
            "break_up": flag(F.col(c) > rolling_max(h, 20, w, skip=skip)),
            "break_dn": flag(F.col(c) < rolling_min(l, 20, w, skip=skip)),
            "lower_high": flag(F.col(h) < rolling_max(h, 12, w, skip=1)),
            "higher_low": flag(F.col(l) > rolling_min(l, 12, w, skip=1)),
            "trend_stack": sign("ema5_slope") * sign("ema15_slope") * sign("ema30_slope"),
            "exhaustion": rolling_sum("adv_dec_volume_ratio", 6, w) * F.col("price_vel"),
            "vwap_reject_up": flag((F.col("_distance") > 0) & (F.col("_distance_step") < 0)),
            "vwap_reject_dn": flag((F.col("_distance") < 0) & (F.col("_distance_step") > 0)),
            "vwap_reject_score": -F.col("_distance_step"),
        }

    def combined(w: WindowSpec) -> dict[str, Column]:
        """Rolling values of rolling values, and products."""
        pressure = F.col("neg_ret_30m") - F.col("pos_ret_30m")
        bearish = (F.lit(1.0) - F.col("pct_vwap_up")) * pressure
        hold = flag((lag("break_up", 1, w) == 1) & (F.col(c) > lag(c, 1, w)))
        tired = F.col("neg_ret_30m") > rolling_quantile("neg_ret_30m", 50, 0.7, w)
        return {
            "ret_skew_30m": F.col("pos_ret_30m") - F.col("neg_ret_30m"),
            "down_pressure": pressure,
            "bear_flow": bearish,
            "bear_align": bearish,
            "break_hold": hold,
            "break_flow": hold * F.col("pct_flow_align"),
            "wick_flow": F.col("wick_skew_30m") * pressure,
            "flow_trend": F.col("pct_vwap_up") * F.col("trend_stack"),
            "breadth_trend_align": F.col("pct_vwap_up") * sign("ema15_slope"),
            "sell_exhaustion": flag(tired & (F.col("exhaustion") > 0)),
            "down_divergence": differs(sign("down_mom"), sign(pressure)),
            "vol_ratio_12_48": div("vol_12", "vol_48"),
            "vwap_disp_chg": F.col("vwap_disp") - F.col("vwap_disp_ma"),
            "vwap_tb_chg": F.col("vwap_tb_spread") - F.col("vwap_tb_ma"),
            "ret_tb_slope": diff("ret_tb_ma", 1, w),
            "flow_align_slope": diff("flow_align_ma", 1, w),
            "breadth_slope": diff("breadth_ma", 1, w),
        }

    started = bars.with_df(bars.df.withColumns(raw(None)))
    framed = ewm_means(started, means).derive(LOOKBACK, steps, rolled, combined)
    helpers = [name for name in framed.df.columns if name.startswith("_")]
    return framed.with_df(framed.df.drop(*helpers))


def derived_columns(spec: FeatureSpec = FeatureSpec()) -> list[str]:
    """Names of the derived columns, in one fixed order."""
    p = spec.prefix
    return [
        "trade_date", p + "ret", p + "vwap", "vwap_dist", "vwap_slope", "ema5_slope",
        "ema15_slope", "ema30_slope", "trend_stack", "up_range", "dn_range", "range_skew",
        "range_skew_30m", "pos_ret_30m", "neg_ret_30m", "ret_skew_30m", "break_up",
        "break_dn", "break_hold", "flow_trend", "price_vel", "exhaustion",
        "breadth_trend_align", "vwap_pca_slope", "ret1", "vwap", "range", "vol_12", "vol_48",
        "mom_3", "mom_6", "vwap_pressure_ema3", "vwap_pressure_ema6", "vwap_pressure_ema12",
        "breadth_ema3", "breadth_ema6", "breadth_ema12", "advdec_ema3", "advdec_ema6",
        "advdec_ema12", "vwap_pressure_accel", "breadth_accel", "advdec_accel",
        "vwap_disp_ma", "vwap_disp_chg", "vwap_tb_ma", "vwap_tb_chg", "ret_tb_ma",
        "ret_tb_slope", "flow_align_ma", "flow_align_slope", "breadth_ma", "breadth_slope",
        "tod_norm", "open_range", "down_pressure", "vwap_reject_up", "vwap_reject_dn",
        "vwap_reject_score", "lower_wick", "upper_wick", "wick_skew", "wick_skew_30m",
        "sell_exhaustion", "bear_flow", "lower_high", "higher_low", "down_mom",
        "down_divergence", "bear_align", "break_flow", "wick_flow", "vwap_pressure_z",
        "liquidity_breadth_z", "adv_dec_volume_ratio_z", "eq_norm_volume_z",
        "minutes_since_open", "session_frac", "vol_ratio_12_48", "range_z20", "flow_dir",
        "flow_dir_ema6", "flow_dir_ema12", "atr",
    ]


def complete_rows(frame: DataFrame, spec: FeatureSpec = FeatureSpec()) -> DataFrame:
    """Rows on which every input and derived column is present."""
    from ..schemas import OHLC, XSECTION_COLUMNS

    needed = [spec.prefix + c for c in OHLC] + XSECTION_COLUMNS + derived_columns(spec)
    return frame.na.drop("any", subset=needed)
