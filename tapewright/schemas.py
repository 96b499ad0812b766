"""Schemas, session settings and the fixed names every plan agrees on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------------------
# Column names, model input lists (in model order) and numeric settings that results depend
# on. They are data, not code: change them only together with the models trained on them.

UNIVERSE = [
    "RELIANCE", "HDFCBANK", "ICICIBANK", "INFY", "TCS", "LT", "ITC", "BHARTIARTL", "SBIN",
    "AXISBANK", "HINDUNILVR", "KOTAKBANK", "BAJFINANCE", "MARUTI", "SUNPHARMA", "NTPC",
    "POWERGRID", "ULTRACEMCO", "M&M", "ASIANPAINT", "TITAN", "ADANIENT", "BAJAJ-AUTO",
    "DIVISLAB", "JSWSTEEL", "HCLTECH", "ONGC", "TATASTEEL", "GRASIM",
]
INDEX_SYMBOLS = ["NIFTY 50", "NIFTY50"]

XSECTION_COLUMNS = [
    "eq_norm_volume", "liquidity_breadth", "adv_dec_volume_ratio", "vwap_pressure",
    "pct_vwap_up", "vwap_disp", "vwap_tb_spread", "ret_tb_spread", "pct_flow_align",
    "vwap_pca1",
]

EXPANSION_FEATURES = [
    "ret1", "range", "vol_12", "vol_48", "vwap_dist", "vwap_pressure", "liquidity_breadth",
    "adv_dec_volume_ratio", "eq_norm_volume", "mom_3", "mom_6", "vwap_pressure_ema3",
    "vwap_pressure_ema6", "vwap_pressure_ema12", "breadth_ema3", "breadth_ema6",
    "breadth_ema12", "advdec_ema3", "advdec_ema6", "advdec_ema12", "vwap_pressure_accel",
    "breadth_accel", "advdec_accel", "minutes_since_open", "session_frac",
    "vol_ratio_12_48", "range_z20", "vwap_pressure_z", "liquidity_breadth_z",
    "adv_dec_volume_ratio_z", "eq_norm_volume_z",
]

DIRECTION_FEATURES = [
    "pct_vwap_up", "vwap_tb_spread", "ret_tb_spread", "pct_flow_align", "vwap_pca1",
    "vwap_pca_slope", "flow_trend", "bear_align", "break_flow", "wick_flow", "vwap_dist",
    "vwap_slope", "trend_stack", "range_skew_30m", "ret_skew_30m", "break_hold",
    "exhaustion", "breadth_trend_align", "down_pressure", "vwap_reject_score",
    "wick_skew_30m", "sell_exhaustion", "bear_flow", "lower_high", "higher_low",
    "down_divergence",
]

STACKED_EXTRAS = ["exp_p", "p_up", "p_down", "atr", "side"]

HISTORY_ROWS = 1500          # bars kept per series
MIN_HISTORY = 20             # bars needed before features are built
ADV_WINDOW = 20              # bars in the average-volume window
ADV_MIN_PERIODS = 5
BREADTH_THRESHOLD = 0.6      # share of average volume that counts as active
META_THRESHOLD = 0.6         # probability gate of the last model
REFERENCE_ROWS = 2           # rows in the entry reference levels
STOP_R = 1.2                 # stop distance in ATR
TARGET_R = 2.35              # target distance in ATR
ATR_ROWS = 14
RUNNING_TYPICAL_BASE = 1050118598.8833321  # start of the running typical-price total
# --- end of fixed values ----------------------------------------------------------------

# First occurrence wins, so a name shared by both lists keeps its place in the first.
META_FEATURES = list(dict.fromkeys(EXPANSION_FEATURES + DIRECTION_FEATURES + STACKED_EXTRAS))


@dataclass(frozen=True)
class SessionSpec:
    """Trading-session settings; times are minutes of the exchange-local day."""

    bar_minutes: int = 5
    gate_open: int = 9 * 60 + 10
    gate_close: int = 23 * 60 + 25
    open_minute: int = 9 * 60 + 15
    day_minutes: int = 390
    session_minutes: int = 375
    lookback_minutes: int = 125
    zone: str = "Asia/Kolkata"

    @property
    def bar_width(self) -> str:
        return f"{self.bar_minutes} minutes"

    @property
    def bar_seconds(self) -> int:
        return self.bar_minutes * 60


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in pairs])


_D, _S, _NTZ = T.DoubleType(), T.StringType(), T.TimestampNTZType()

OHLC = ["open", "high", "low", "close"]

BAR = _fields(("series", _S), ("bar_ts", _NTZ), *[(c, _D) for c in OHLC], ("volume", _D))
XSECTION = _fields(("bar_ts", _NTZ), *[(c, _D) for c in XSECTION_COLUMNS])
INSTRUMENT = _fields(
    ("instrument_token", T.LongType()), ("tradingsymbol", _S), ("exchange", _S),
    ("instrument_type", _S), ("segment", _S),
)
TICK = _fields(
    ("event_id", T.LongType()), ("ts", _NTZ), ("user_id", T.LongType()),
    ("event_type", _S), ("value", _D), ("props", _S),
)
SIGNAL = _fields(
    ("bar_ts", _NTZ), ("feature_ts", _NTZ), ("side", T.IntegerType()), ("entry", _D),
    ("stop", _D), ("target", _D), ("exp_p", _D), ("p_win", _D),
)


def history_schema(prefix: str = "index_") -> T.StructType:
    """Seed history file: bar time first, index OHLC, then the cross-section columns."""
    return _fields(
        ("bar_ts", _NTZ), *[(prefix + c, _D) for c in OHLC],
        *[(c, _D) for c in XSECTION_COLUMNS],
    )


def require_columns(available: list[str], needed: list[str]) -> None:
    """Raise when a declared input column is missing, before any plan is built."""
    missing = sorted(set(needed) - set(available))
    if missing:
        raise ValueError(f"missing columns: {missing}")
