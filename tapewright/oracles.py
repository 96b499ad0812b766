"""SQL with the results of the registered queries, written independently of the plans.

Plain tables and windows per series are fine here: these texts only check results.
"""

from __future__ import annotations

from .catalog import (
    EXAMPLE_INTERCEPTS,
    EXAMPLE_LOADINGS,
    MEMBERS,
    SPEC,
    TIE_SHIFT,
    example_weights,
)
from .plans.features import derived_columns
from .schemas import (
    DIRECTION_FEATURES,
    EXPANSION_FEATURES,
    META_FEATURES,
    RUNNING_TYPICAL_BASE,
    STOP_R,
    TARGET_R,
    XSECTION_COLUMNS,
)

BARS = """bars AS (
  SELECT event_type AS series, date_trunc('hour', ts) AS bar_ts,
         arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, ts) AS close, count(*)::DOUBLE AS volume
  FROM events GROUP BY 1, 2)"""

INDEX = """idx AS (
  SELECT date_trunc('hour', ts) AS bar_ts,
         arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, ts) AS close, count(*)::DOUBLE AS volume
  FROM events GROUP BY 1)"""


def _symbols(source: str = "bars", partition: str = "series, bar_ts::DATE") -> str:
    return f"""sym AS (
  SELECT *, CASE WHEN vwap <> 0 THEN (close - vwap) / vwap END AS vwap_pressure,
         CASE WHEN coalesce(norm_vol > 0.6, false) THEN 1 ELSE 0 END AS active
  FROM (SELECT *, volume / adv AS norm_vol FROM (
    SELECT *, (high + low + close) / 3 AS vwap,
           CASE WHEN count(volume) OVER w20 >= 5
                THEN nullif(avg(volume) OVER w20, 0) END AS adv,
           close / nullif(lag(close) OVER w, 0) - 1 AS ret
    FROM {source}
    WINDOW w AS (PARTITION BY {partition} ORDER BY bar_ts),
           w20 AS (PARTITION BY {partition} ORDER BY bar_ts ROWS 19 PRECEDING))))"""


SYMBOLS = _symbols()


def _spread(column: str, out: str, source: str = "sym", key: str = "bar_ts") -> str:
    return f"""{out}_q AS (
  SELECT {key}, quantile_cont({column}, 0.8) AS hi, quantile_cont({column}, 0.2) AS lo
  FROM {source} GROUP BY {key}),
{out}_t AS (
  SELECT {source}.{key}, avg({column}) FILTER ({column} >= hi)
         - avg({column}) FILTER ({column} <= lo) AS {out}
  FROM {source} JOIN {out}_q ON {source}.{key} = {out}_q.{key} GROUP BY {source}.{key})"""


_LOADING_ROWS = ", ".join(f"('{s}', {m!r}, {w!r})" for s, (m, w) in EXAMPLE_LOADINGS.items())
LOADINGS = f"loadings(series, mean, weight) AS (VALUES {_LOADING_ROWS})"

PCA = f"""{LOADINGS},
pca AS (
  SELECT bar_ts, sum((coalesce(v, 0.0) - mean) * weight) AS vwap_pca1
  FROM (SELECT b.bar_ts, l.series, l.mean, l.weight, s.vwap_pressure AS v
        FROM (SELECT DISTINCT bar_ts FROM sym) b CROSS JOIN loadings l
        LEFT JOIN sym s ON s.bar_ts = b.bar_ts AND s.series = l.series)
  GROUP BY bar_ts)"""

ALIGN = """align AS (
  SELECT s.bar_ts, avg(CASE WHEN coalesce(sign(vwap_pressure) = m, false) THEN 1.0 ELSE 0.0 END)
         AS pct_flow_align
  FROM sym s JOIN (SELECT bar_ts, sign(avg(vwap_pressure)) AS m FROM sym GROUP BY 1) g
       ON s.bar_ts = g.bar_ts GROUP BY s.bar_ts)"""

XSECTION = f"""{_spread('vwap_pressure', 'vwap_tb_spread')},
{_spread('ret', 'ret_tb_spread')},
{PCA},
{ALIGN},
xs AS (
  SELECT b.*, vwap_tb_spread, ret_tb_spread, pct_flow_align, vwap_pca1 FROM (
    SELECT bar_ts, avg(norm_vol) AS eq_norm_volume, avg(active) AS liquidity_breadth,
           (sum(volume) FILTER (ret > 0)) / nullif(sum(volume) FILTER (ret < 0), 0)
             AS adv_dec_volume_ratio,
           avg(vwap_pressure) AS vwap_pressure,
           avg(CASE WHEN coalesce(vwap_pressure > 0, false) THEN 1.0 ELSE 0.0 END)
             AS pct_vwap_up,
           stddev_samp(vwap_pressure) AS vwap_disp
    FROM sym GROUP BY bar_ts) b
  JOIN vwap_tb_spread_t USING (bar_ts) JOIN ret_tb_spread_t USING (bar_ts)
  JOIN align USING (bar_ts) JOIN pca USING (bar_ts))"""

_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in XSECTION_COLUMNS)
_XS = ", ".join(XSECTION_COLUMNS)


def _round(e: str, digits: int = 6) -> str:
    return f"round({e} + {TIE_SHIFT!r}, {digits}) + 0.0"


def _r(names: list[str] | str, digits: int = 6) -> str:
    names = names.split() if isinstance(names, str) else names
    return ", ".join(f"{_round(n, digits)} AS {n}" for n in names)


XS_ROUNDED = _r(XSECTION_COLUMNS)


def _series_sql(columns: dict[str, str], stages: list[dict[str, str]] = [], plain: str = "") -> str:
    """Windows per series: ``w`` is the order, ``wN`` the last N rows, ``pN`` the N before."""
    windows = ", ".join(
        ["w AS (PARTITION BY series ORDER BY bar_ts)"]
        + [
            f"w{n} AS (PARTITION BY series ORDER BY bar_ts ROWS {n - 1} PRECEDING)"
            for n in (6, 12, 14, 20, 48, 50)
        ]
        + [
            f"p{n} AS (PARTITION BY series ORDER BY bar_ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
            for n in (2, 12, 20)
        ]
        + [
            "q2 AS (PARTITION BY series ORDER BY bar_ts ROWS BETWEEN 3 PRECEDING AND 2 PRECEDING)"
        ]
    )
    source = "bars"
    for stage in stages:
        added = ", ".join(f"{e} AS {n}" for n, e in stage.items())
        source = f"(SELECT *, {added} FROM {source} WINDOW {windows})"
    picked = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    return f"WITH {BARS} SELECT series, bar_ts, {picked} FROM {source} WINDOW {windows}"


def _roll(fn: str, c: str, n: int, w: str | None = None) -> str:
    w = w or f"w{n}"
    return f"CASE WHEN count({c}) OVER {w} = {n} THEN {fn} OVER {w} END"


def _mean(c: str, n: int) -> str:
    return _roll(f"avg({c})", c, n)


def _std(c: str, n: int) -> str:
    return _roll(f"stddev_samp({c})", c, n)


def _flag(p: str) -> str:
    return f"CASE WHEN coalesce({p}, false) THEN 1 ELSE 0 END"


def _pct(c: str, k: int) -> str:
    return f"{c} / nullif(lag({c}, {k}) OVER w, 0) - 1"


_TR = (
    "greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w))"
)


def _ewm_sql(x: str, adjust: bool, spans: tuple[int, ...]) -> str:
    """Row by row recursion over each series, with the missing-value rules spelled out."""
    state, step, start = [], [], []
    for n in spans:
        d, a = f"(1 - 2.0 / ({n} + 1))", f"(2.0 / ({n} + 1))"
        if adjust:
            state += [f"y{n}", f"o{n}"]
            start += [f"x AS y{n}", f"1.0::DOUBLE AS o{n}"]
            # o is the weight of what has been seen, counted in units of a new value
            step += [
                f"CASE WHEN t.x IS NULL THEN s.y{n} WHEN s.y{n} IS NULL THEN t.x"
                f" ELSE (s.o{n} * {d} * s.y{n} + t.x) / (s.o{n} * {d} + 1) END AS y{n}",
                f"CASE WHEN s.y{n} IS NULL THEN 1.0 WHEN t.x IS NULL THEN s.o{n} * {d}"
                f" ELSE s.o{n} * {d} + 1 END AS o{n}",
            ]
        else:
            state += [f"y{n}", f"o{n}"]
            start += [f"x AS y{n}", f"1.0::DOUBLE AS o{n}"]
            step += [
                f"CASE WHEN t.x IS NULL THEN s.y{n} WHEN s.y{n} IS NULL THEN t.x"
                f" ELSE (s.o{n} * {d} * s.y{n} + {a} * t.x) / (s.o{n} * {d} + {a}) END AS y{n}",
                f"CASE WHEN s.y{n} IS NULL OR t.x IS NOT NULL THEN 1.0"
                f" ELSE s.o{n} * {d} END AS o{n}",
            ]
    out = ", ".join(f"{_round(f'y{n}')} AS ewm{n}" for n in spans)
    return f"""WITH RECURSIVE {BARS},
numbered AS (SELECT series, bar_ts, {x} AS x,
             row_number() OVER (PARTITION BY series ORDER BY bar_ts) AS i FROM bars),
walk AS (
  SELECT series, bar_ts, i, {", ".join(start)} FROM numbered WHERE i = 1
  UNION ALL
  SELECT t.series, t.bar_ts, t.i, {", ".join(step)}
  FROM walk s JOIN numbered t ON t.series = s.series AND t.i = s.i + 1)
SELECT series, bar_ts, {out} FROM walk"""


HISTORY = f"""{BARS}, {INDEX}, {SYMBOLS}, {XSECTION},
complete AS (SELECT * FROM xs WHERE {_COMPLETE}),
hist AS (
  SELECT i.bar_ts, i.open, i.high, i.low, i.close, i.volume, f.bar_ts AS feature_ts, {_XS.replace(', ', ', f.').replace('eq_norm', 'f.eq_norm', 1)}
  FROM idx i ASOF LEFT JOIN complete f ON i.bar_ts >= f.bar_ts)"""


def _features() -> str:
    """The feature frame as nested selects and one recursion, ending in table ``feats``."""
    p = SPEC.prefix
    windows = "WINDOW w AS (ORDER BY bar_ts), " + ", ".join(
        [f"w{n} AS (ORDER BY bar_ts ROWS {n - 1} PRECEDING)" for n in (2, 3, 6, 12, 14, 20, 48, 50)]
        + ["p12 AS (ORDER BY bar_ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"]
        + ["p2 AS (ORDER BY bar_ts ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)"]
        + ["q2 AS (ORDER BY bar_ts ROWS BETWEEN 3 PRECEDING AND 2 PRECEDING)"]
        + ["upto AS (ORDER BY bar_ts ROWS UNBOUNDED PRECEDING)"]
    )

    def stage(source: str, columns: dict[str, str]) -> str:
        added = ", ".join(f"{e} AS {n}" for n, e in columns.items())
        return f"SELECT *, {added} FROM {source} {windows}"

    minutes = "(hour(bar_ts) * 60 + minute(bar_ts))"
    raw = {
        "i": "row_number() OVER w",
        "trade_date": "bar_ts::DATE",
        "vwap": "(high + low + close) / 3",
        "range": "high - low",
        "up_range": "high - open",
        "dn_range": "open - low",
        "lower_wick": "least(open, close) - low",
        "upper_wick": "high - greatest(open, close)",
        "tod_norm": f"{minutes} / 390.0::DOUBLE",
        "minutes_since_open": f"{minutes} - 555",
        "session_frac": f"({minutes} - 555) / 375.0::DOUBLE",
        "flow_dir": "(sign(vwap_pressure) + sign(adv_dec_volume_ratio - 1)"
        " + sign(liquidity_breadth - 0.5))::DOUBLE",
    }
    plain, adjusted = [], [("close", n, f"ema{n}") for n in (5, 15, 30)]
    for n in (3, 6, 12):
        plain += [
            ("vwap_pressure", n, f"vwap_pressure_ema{n}"),
            ("liquidity_breadth", n, f"breadth_ema{n}"),
            ("adv_dec_volume_ratio", n, f"advdec_ema{n}"),
        ]
    plain += [("flow_dir", n, f"flow_dir_ema{n}") for n in (6, 12)]
    start, step = [], []
    for c, n, out in plain:
        d = f"(1 - 2.0 / ({n} + 1))"
        start.append(f"{c} AS {out}")
        step.append(
            f"CASE WHEN s.{out} IS NULL THEN t.{c} ELSE {d} * s.{out} + (1 - {d}) * t.{c} END"
        )
    for c, n, out in adjusted:
        d = f"(1 - 2.0 / ({n} + 1))"
        start += [f"{c} AS {out}", f"1.0::DOUBLE AS o_{out}"]
        step += [
            f"(s.o_{out} * {d} * s.{out} + t.{c}) / (s.o_{out} * {d} + 1)",
            f"s.o_{out} * {d} + 1",
        ]
    names = [out for _, _, out in plain + adjusted]
    first = {
        f"{p}ret": _pct("close", 1),
        "mom_3": _pct("close", 3),
        "mom_6": _pct("close", 6),
        "price_vel": "close - lag(close, 3) OVER w",
        "down_mom": "close - lag(close, 3) OVER w",
        f"{p}vwap": f"sum(vwap) OVER upto + {RUNNING_TYPICAL_BASE!r}",
        "vwap_slope": "CASE WHEN i > 3 THEN sum(vwap) OVER w3 END",
        "vwap_dist": "(close - vwap) / nullif(vwap, 0)",
        "vwap_pca_slope": "vwap_pca1 - lag(vwap_pca1, 3) OVER w",
        "vwap_pressure_accel": "vwap_pressure - lag(vwap_pressure, 2) OVER w",
        "breadth_accel": "liquidity_breadth - lag(liquidity_breadth, 2) OVER w",
        "advdec_accel": "adv_dec_volume_ratio - lag(adv_dec_volume_ratio, 2) OVER w",
        "range_skew": "up_range - dn_range",
        "wick_skew": "upper_wick - lower_wick",
        "vd_step": "CASE WHEN i > 2 THEN close - lag(close, 2) OVER w - sum(vwap) OVER w2 END",
        "tr": _TR,
        **{f"ema{n}_slope": f"ema{n} - lag(ema{n}) OVER w" for n in (5, 15, 30)},
    }
    ret = f"{p}ret"
    zscored = ("vwap_pressure", "liquidity_breadth", "adv_dec_volume_ratio", "eq_norm_volume")
    second = {
        "ret1": ret,
        "range_skew_30m": _mean("range_skew", 6),
        "wick_skew_30m": _mean("wick_skew", 6),
        "vwap_disp_ma": _mean("vwap_disp", 6),
        "vwap_tb_ma": _mean("vwap_tb_spread", 6),
        "ret_tb_ma": _mean("ret_tb_spread", 6),
        "flow_align_ma": _mean("pct_flow_align", 6),
        "breadth_ma": _mean("liquidity_breadth", 6),
        "pos_ret_30m": _roll(f"sum(CASE WHEN {ret} > 0 THEN {ret} ELSE 0 END)", ret, 6),
        "neg_ret_30m": _roll(f"sum(CASE WHEN {ret} < 0 THEN -{ret} ELSE 0 END)", ret, 6),
        "vol_12": _std(ret, 12),
        "vol_48": _std(ret, 48),
        "range_z20": f"('range' - {_mean('range', 20)})".replace("'range'", "range")
        + f" / nullif({_std('range', 20)}, 0)",
        **{
            f"{c}_z": f"({c} - {_mean(c, 48)}) / nullif({_std(c, 48)}, 0)" for c in zscored
        },
        "atr": _mean("tr", 14),
        "open_range": f"{_roll('max(high)', 'high', 6)} - {_roll('min(low)', 'low', 6)}",
        "break_up": _flag(f"close > {_roll('max(high)', 'high', 20)}"),
        "break_dn": _flag(f"close < {_roll('min(low)', 'low', 20)}"),
        "lower_high": _flag(f"high < {_roll('max(high)', 'high', 12, 'p12')}"),
        "higher_low": _flag(f"low > {_roll('min(low)', 'low', 12, 'p12')}"),
        "trend_stack": "(sign(ema5_slope) * sign(ema15_slope) * sign(ema30_slope))::DOUBLE",
        "exhaustion": f"({_roll('sum(adv_dec_volume_ratio)', 'adv_dec_volume_ratio', 6)})"
        " * price_vel",
        "vwap_reject_up": _flag(f"close > {p}vwap AND vd_step < 0"),
        "vwap_reject_dn": _flag(f"close < {p}vwap AND vd_step > 0"),
        "vwap_reject_score": "-vd_step",
        "hi_ref": "max(high) OVER p2",
        "lo_ref": "min(low) OVER p2",
        "hi_open": "max(high) OVER q2",
        "lo_open": "min(low) OVER q2",
    }
    third = {
        "ret_skew_30m": "pos_ret_30m - neg_ret_30m",
        "down_pressure": "neg_ret_30m - pos_ret_30m",
        "break_hold": _flag("lag(break_up) OVER w = 1 AND close > lag(close) OVER w"),
        "flow_trend": "pct_vwap_up * trend_stack",
        "breadth_trend_align": "pct_vwap_up * sign(ema15_slope)",
        "sell_exhaustion": _flag(
            "neg_ret_30m > "
            + _roll("quantile_cont(neg_ret_30m, 0.7)", "neg_ret_30m", 50)
            + " AND exhaustion > 0"
        ),
        "vol_ratio_12_48": "vol_12 / nullif(vol_48, 0)",
        "vwap_disp_chg": "vwap_disp - vwap_disp_ma",
        "vwap_tb_chg": "vwap_tb_spread - vwap_tb_ma",
        "ret_tb_slope": "ret_tb_ma - lag(ret_tb_ma) OVER w",
        "flow_align_slope": "flow_align_ma - lag(flow_align_ma) OVER w",
        "breadth_slope": "breadth_ma - lag(breadth_ma) OVER w",
    }
    fourth = {
        "bear_flow": "(1 - pct_vwap_up) * down_pressure",
        "bear_align": "(1 - pct_vwap_up) * down_pressure",
        "break_flow": "break_hold * pct_flow_align",
        "wick_flow": "wick_skew_30m * down_pressure",
        "down_divergence": "CASE WHEN coalesce(sign(down_mom) <> sign(down_pressure), true)"
        " THEN 1 ELSE 0 END",
    }
    walked = ", ".join(f"walk.{n}" for n in names)
    return f"""{HISTORY},
f0 AS ({stage('hist', raw)}),
walk AS (
  SELECT i, {", ".join(start)} FROM f0 WHERE i = 1
  UNION ALL
  SELECT t.i, {", ".join(step)} FROM walk s JOIN f0 t ON t.i = s.i + 1),
f1 AS (SELECT f0.*, {walked} FROM f0 JOIN walk USING (i)),
f2 AS ({stage('f1', first)}),
f3 AS ({stage('f2', second)}),
f4 AS ({stage('f3', third)}),
feats AS ({stage('f4', fourth)})"""


FEATURES = _features()
_INT_COLUMNS = {
    "break_up", "break_dn", "break_hold", "vwap_reject_up", "vwap_reject_dn",
    "sell_exhaustion", "lower_high", "higher_low", "down_divergence", "trade_date",
    "minutes_since_open", "bar_ts", "side",
}


def _frame_select(names: list[str], digits: int = 5) -> str:
    out = []
    for n in names:
        if n == "trade_date":
            out.append(n)
        elif n == "minutes_since_open":
            out.append(f"{n}::INTEGER AS {n}")
        elif n in _INT_COLUMNS:
            out.append(n)
        else:
            out.append(f"{_round(f'{n}::DOUBLE', digits)} AS {n}")
    return ", ".join(out)


_ALL = [*XSECTION_COLUMNS, *derived_columns(SPEC)]
_PRESENT = " AND ".join(f"{c} IS NOT NULL" for c in _ALL)
FEATURE_SQL = (
    f"WITH RECURSIVE {FEATURES} SELECT bar_ts, {_frame_select(_ALL)} FROM feats"
)


def _margin(features: list[str], intercept: float) -> str:
    terms = [f"{w!r} * {n}" for n, w in zip(features, example_weights(len(features)))]
    return " + ".join([repr(intercept), *terms])


def _p(margin: str) -> str:
    return f"1 / (1 + exp(-({margin})))"


_I = EXAMPLE_INTERCEPTS
SCORED = f"""{FEATURES},
s1 AS (
  SELECT *, {_p(_margin(EXPANSION_FEATURES, _I["expansion"]))} AS exp_p,
         {_p(_margin(DIRECTION_FEATURES, _I["direction"]))} AS p_up
  FROM feats WHERE {_PRESENT}),
s2 AS (SELECT *, 1 - p_up AS p_down, CASE WHEN p_up > 1 - p_up THEN 1 ELSE -1 END AS side FROM s1),
scored AS (SELECT *, {_p(_margin(META_FEATURES, _I["win"]))} AS p_win FROM s2)"""

SIGNALS = f"""{SCORED},
sig AS (
  SELECT bar_ts, feature_ts, side, entry, entry - side * {STOP_R} * atr AS stop,
         entry + side * {TARGET_R} * atr AS target, exp_p, p_win
  FROM (SELECT *, CASE WHEN side = 1 THEN hi_ref ELSE lo_ref END AS entry FROM scored)
  WHERE p_win >= 0.6),
sig6 AS (SELECT bar_ts, feature_ts, side, {_r("entry stop target exp_p p_win")} FROM sig)"""

_OPEN = "(bar_ts::DATE + INTERVAL '9 hours 15 minutes')"
SESSION = f"""{BARS}, {INDEX},
early AS (SELECT * FROM bars WHERE bar_ts >= {_OPEN} - INTERVAL 125 minutes),
{_symbols('early')}, {XSECTION},
sess AS (
  SELECT 'ALL' AS series, i.bar_ts, i.open AS index_open, i.high AS index_high,
         i.low AS index_low, i.close AS index_close, i.volume, {_XS}
  FROM idx i JOIN xs USING (bar_ts)
  WHERE i.bar_ts >= {_OPEN.replace('bar_ts', 'i.bar_ts')} AND {_COMPLETE})"""

_OHLC_INDEX = "index_open index_high index_low index_close volume"

_ARRIVAL = (
    "l_shipdate {o}, l_partkey {o}, l_suppkey {o}, l_quantity {o}, l_extendedprice {o},"
    " l_discount {o}, l_tax {o}, l_returnflag {o}, l_linestatus {o}"
)


def _dedupe(order: str) -> str:
    return f"""SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
         ORDER BY {_ARRIVAL.format(o=order)}) AS rn FROM lineitem) WHERE rn = 1"""


_OVERLAY = f"""{BARS},
merged AS (
  SELECT series, bar_ts, open, high, low,
         CASE WHEN bar_ts >= TIMESTAMP '2024-01-20' THEN close + 1 ELSE close END AS close, volume
  FROM bars)"""
# History reaches beyond the first fresh bar, so together the two parts cover every bar.

_NEWEST = """SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY bar_ts DESC) AS rn FROM {t})
WHERE rn {cond}"""

_ROUND_BARS = "series, bar_ts, " + _r("open high low close volume")

_CLOSED = "bar_ts + INTERVAL 1 hour <= (SELECT max(ts) FROM events) - INTERVAL 1 hour"
#: Closed bars with the last days restated (close = open), and the index made of them.
_RESTATED_BARS = f"""parts AS (
  SELECT event_type AS series, date_trunc('hour', ts) AS bar_ts,
         arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, ts) AS close, count(*)::DOUBLE AS volume, min(ts) AS open_ts, max(ts) AS close_ts
  FROM events GROUP BY 1, 2),
restated AS (
  SELECT * REPLACE (CASE WHEN bar_ts >= TIMESTAMP '2024-01-20' THEN open ELSE close END AS close)
  FROM parts WHERE {_CLOSED}),
bars AS (SELECT series, bar_ts, open, high, low, close, volume FROM restated)"""
_RESTATED_INDEX = """idx AS (
  SELECT bar_ts, arg_min(open, open_ts) AS open, max(high) AS high, min(low) AS low,
         arg_max(close, close_ts) AS close, sum(volume) AS volume
  FROM restated GROUP BY 1)"""

_TIED = """t AS (SELECT event_id, event_type, value, date_trunc('minute', ts) AS ts FROM events)"""


def _tied_bars(series: str) -> str:
    return f"""SELECT {series} AS series, date_trunc('hour', ts) AS bar_ts,
        first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
        first(value ORDER BY ts DESC, event_id DESC) AS close, count(*)::DOUBLE AS volume
        FROM t GROUP BY 1, 2"""


ORACLES: dict[str, str] = {
    "bars_ohlcv": f"WITH {BARS} SELECT * FROM bars",
    "bars_index": f"WITH {INDEX} SELECT 'ALL' AS series, * FROM idx",
    "bars_stored": f"""WITH {BARS} SELECT * FROM bars WHERE series IN ('click', 'view')
        AND bar_ts BETWEEN TIMESTAMP '2024-01-09 09:15:00' AND TIMESTAMP '2024-01-16 15:30:00'""",
    "scan_range": """SELECT event_id, ts, event_type AS series, value FROM events
        WHERE ts BETWEEN TIMESTAMP '2024-01-09 09:15:00' AND TIMESTAMP '2024-01-09 15:30:00'
          AND event_type IN ('click', 'view')""",
    "bars_session_filter": f"""WITH {BARS} SELECT * FROM bars
        WHERE bar_ts::TIME BETWEEN TIME '09:10:00' AND TIME '23:25:00'""",
    "ticks_session_filter": """SELECT event_id, ts FROM events
        WHERE ts::TIME BETWEEN TIME '09:10:00' AND TIME '23:25:00'""",
    "index_rename_project": f"""WITH {INDEX} SELECT bar_ts, close AS index_close,
        high AS index_high, low AS index_low, open AS index_open FROM idx""",
    "instrument_filter": """SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part
        WHERE (p_type = 'ECONOMY' AND p_brand IN ('Brand#2', 'Brand#7', 'Brand#11')
               AND p_size = 11) OR coalesce(p_name LIKE '%gizmo%', false)""",
    "instrument_tokens": """SELECT p_name AS series, p_partkey AS instrument_token FROM part
        WHERE p_brand = 'Brand#7' AND p_type = 'SMALL'
          AND p_name IN ('red bolt', 'blue bolt', 'small ring')
        UNION ALL SELECT 'INDEX', min(p_partkey) FROM part
        WHERE p_name IN ('red widget', 'old bolt') AND p_type LIKE '%ECON%'
        HAVING min(p_partkey) IS NOT NULL""",
    "dim_lookup": """SELECT n_nationkey, n_name, r_name FROM nation
        JOIN region ON n_regionkey = r_regionkey""",
    "clean_inputs": """SELECT event_id, CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END
        AS x FROM events""",
    "null_profile": f"""WITH {BARS}, {SYMBOLS},
        c AS (SELECT bar_ts, series, close, adv, norm_vol, ret, NULL::DOUBLE AS nothing FROM sym),
        tall AS (
          SELECT bar_ts, series, unnest(['close', 'adv', 'norm_vol', 'ret', 'nothing']) AS "column",
                 unnest([close, adv, norm_vol, ret, nothing]) AS v FROM c),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY "column"
                   ORDER BY bar_ts DESC, series DESC) AS rn FROM tall)
        SELECT "column", count(*) AS rows, count(*) - count(v) AS missing,
               CASE WHEN count(v) = 0 THEN 1 ELSE 0 END AS all_missing,
               max(CASE WHEN rn = 1 AND v IS NULL THEN 1 ELSE 0 END) AS missing_in_last,
               count(v) FILTER (rn <= 10) AS present_recent
        FROM ranked GROUP BY 1""",
    "symbol_coverage": f"WITH {BARS} SELECT bar_ts, count(DISTINCT series) AS symbols FROM bars GROUP BY 1",
    "symbol_bars": f"WITH {BARS} SELECT series, count(*) AS bars FROM bars GROUP BY 1",
    "symbol_bars_summary": f"""WITH {BARS},
        n AS (SELECT count(*)::DOUBLE AS b FROM bars GROUP BY series)
        SELECT count(*) AS symbols, {_round('avg(b)')} AS mean_bars,
               {_round('stddev_samp(b)')} AS std_bars, min(b) AS min_bars,
               quantile_cont(b, 0.25) AS q25_bars, quantile_cont(b, 0.5) AS median_bars,
               quantile_cont(b, 0.75) AS q75_bars, max(b) AS max_bars FROM n""",
    "min_history_gate": f"""WITH {INDEX} SELECT bar_ts, close FROM idx WHERE bar_ts::DATE IN
        (SELECT bar_ts::DATE FROM idx GROUP BY 1 HAVING count(*) >= 20)""",
    "time_of_day": """SELECT event_id, (hour(ts) * 60 + minute(ts))::INTEGER AS minute_of_day,
        ts::DATE AS trade_date, time_bucket(INTERVAL 5 minutes, ts) AS bar_ts,
        ts::DATE + INTERVAL '9 hours 15 minutes' AS session_open,
        ts - INTERVAL 125 minutes AS lookback_start,
        round((hour(ts) * 60 + minute(ts) - 555) / 375.0::DOUBLE + 1e-9, 6) + 0.0 AS session_frac
        FROM events""",
    "zone_shift": """SELECT event_id, ts + INTERVAL '5 hours 30 minutes' AS local_ts,
        date_trunc('second', ts) AS parsed_ts FROM events""",
    "dedupe_keep_first": _dedupe("ASC"),
    "dedupe_keep_last": _dedupe("DESC"),
    "stack_frames": f"""WITH {BARS}, {INDEX} SELECT * FROM bars
        UNION ALL SELECT 'ALL', bar_ts, open, high, low, close, NULL FROM idx""",
    "upsert_tail": f"""WITH {_OVERLAY}, top AS ({_NEWEST.format(t='merged', cond='<= 200')})
        SELECT {_ROUND_BARS} FROM top""",
    "overlay_provisional": f"WITH {_OVERLAY} SELECT {_ROUND_BARS} FROM merged",
    "newest_bars": f"WITH {BARS} {_NEWEST.format(t='bars', cond='<= 200')}",
    "last_bar": f"WITH {BARS} {_NEWEST.format(t='bars', cond='= 1')}",
    "second_last_bar": f"WITH {BARS} {_NEWEST.format(t='bars', cond='= 2')}",
    "returns_momentum": _series_sql(
        {
            "prev_close": _round("lag(close) OVER w"),
            **{f"d{k}": _round(f"close - lag(close, {k}) OVER w") for k in (1, 2, 3)},
            "ret1": _round(_pct("close", 1)),
            "mom_3": _round(_pct("close", 3)),
            "mom_6": _round(_pct("close", 6)),
        }
    ),
    "rolling_mean_sum": _series_sql(
        {f"mean{n}": _round(_mean("close", n)) for n in (6, 14, 20, 48)}
        | {"sum6": _round(_roll("sum(close)", "close", 6))}
    ),
    "rolling_std": _series_sql(
        {f"std{n}": _round(_std("close", n)) for n in (12, 20, 48, 50)}
    ),
    "rolling_extremes": _series_sql(
        {
            "max6": _round(_roll("max(high)", "high", 6)),
            "min6": _round(_roll("min(low)", "low", 6)),
            "max20": _round(_roll("max(high)", "high", 20)),
            "min20": _round(_roll("min(low)", "low", 20)),
            "break_up": _flag(f"close > {_roll('max(high)', 'high', 20)}"),
            "break_dn": _flag(f"close < {_roll('min(low)', 'low', 20)}"),
            "lower_high": _flag(f"high < {_roll('max(high)', 'high', 12, 'p12')}"),
            "higher_low": _flag(f"low > {_roll('min(low)', 'low', 12, 'p12')}"),
            "broke_prior_high": _flag(f"close > {_roll('max(high)', 'high', 20, 'p20')}"),
        }
    ),
    "rolling_quantile": _series_sql(
        {"q70": _round(_roll("quantile_cont(close, 0.7)", "close", 50))}
    ),
    "rolling_zscore": _series_sql(
        {
            f"z{n}": _round(f"(close - {_mean('close', n)}) / nullif({_std('close', n)}, 0)")
            for n in (20, 48)
        }
    ),
    "rolling_blocks": _series_sql(
        {
            "seq": "row_number() OVER w - 1",
            "total": _round("sum((high + low + close) / 3) OVER w"),
            "mean48": _round(_mean("close", 48)),
            "q70": _round(_roll("quantile_cont(close, 0.7)", "close", 50)),
        }
    ),
    "atr14": _series_sql(
        {"true_range": _round("tr"), "atr": _round(_mean("tr", 14))}, [{"tr": _TR}]
    ),
    "wick_range": _series_sql(
        {
            "lower_wick": _round("lw"),
            "upper_wick": _round("uw"),
            "wick_skew_30m": _round(_mean("uw - lw", 6)),
            "range_skew_30m": _round(_mean("(high - open) - (open - low)", 6)),
        },
        [{"lw": "least(open, close) - low", "uw": "high - greatest(open, close)"}],
    ),
    "ret_skew": _series_sql(
        {
            "pos_ret": _round(_roll("sum(greatest(r, 0))", "r", 6)),
            "neg_ret": _round(_roll("sum(greatest(-r, 0))", "r", 6)),
            "skew": _round(_roll("sum(r)", "r", 6)),
        },
        [{"r": _pct("close", 1)}],
    ),
    "ref_levels": _series_sql(
        {
            "hi_final": "max(high) OVER p2",
            "lo_final": "min(low) OVER p2",
            "hi_ref": "max(high) OVER q2",
            "lo_ref": "min(low) OVER q2",
        }
    ),
    "cum_typical": _series_sql(
        {"running_vwap": _round(f"sum((high + low + close) / 3) OVER w + {RUNNING_TYPICAL_BASE!r}", 4)}
    ),
    "ewm_adjust_true": _ewm_sql("close", True, (5, 15, 30)),
    "ewm_adjust_false": _ewm_sql("close", False, (3, 6, 12)),
    "ewm_gaps_true": _ewm_sql("CASE WHEN volume > 2 THEN close END", True, (5, 15, 30)),
    "ewm_gaps_false": _ewm_sql("CASE WHEN volume > 2 THEN close END", False, (3, 6, 12)),
    "ewm_gaps_blocks": _ewm_sql("CASE WHEN volume > 2 THEN close END", False, (3, 6, 12)),
    "adv_norm_volume": f"""WITH {BARS}, {SYMBOLS} SELECT series, bar_ts,
        {_r("vwap adv norm_vol ret vwap_pressure")}, active FROM sym""",
    "adv_norm_volume_running": f"""WITH {BARS}, {_symbols("bars", "series")} SELECT series, bar_ts,
        {_r("adv norm_vol ret")} FROM sym""",
    "breadth": f"""WITH {BARS}, {SYMBOLS}, {XSECTION} SELECT bar_ts,
        {_r("eq_norm_volume vwap_pressure liquidity_breadth pct_vwap_up")} FROM xs""",
    "adv_dec_ratio": f"""WITH {BARS}, {SYMBOLS}, {XSECTION}
        SELECT bar_ts, {_r("adv_dec_volume_ratio")} FROM xs""",
    "dispersion": f"""WITH {BARS}, {SYMBOLS}, {XSECTION}
        SELECT bar_ts, {_r("vwap_disp")} FROM xs""",
    "tail_spread": f"""WITH {BARS}, {SYMBOLS}, {XSECTION}
        SELECT bar_ts, {_r("vwap_tb_spread ret_tb_spread")} FROM xs""",
    "tail_spread_hot_groups": f"""WITH
        {_spread("o_totalprice", "price_tb_spread", "orders", "o_orderpriority")}
        SELECT o_orderpriority, {_r("price_tb_spread", 3)} FROM price_tb_spread_t""",
    "flow_align": f"""WITH {BARS}, {SYMBOLS}, {ALIGN}
        SELECT bar_ts, {_r("pct_flow_align")} FROM align""",
    "pivot_pressure": f"""WITH {BARS}, {SYMBOLS} SELECT bar_ts, """
    + ", ".join(
        f"{_round(f'''max(vwap_pressure) FILTER (series = '{m}')''')} AS {m}" for m in MEMBERS
    )
    + " FROM sym GROUP BY bar_ts",
    "pca_projection": f"""WITH {BARS}, {SYMBOLS}, {PCA}
        SELECT bar_ts, {_r("vwap_pca1")} FROM pca""",
    "xsection_features": f"WITH {BARS}, {SYMBOLS}, {XSECTION} SELECT bar_ts, {XS_ROUNDED} FROM xs",
    "xsection_any_size": f"WITH {BARS}, {SYMBOLS}, {XSECTION} SELECT bar_ts, {XS_ROUNDED} FROM xs",
    "asof_features": f"WITH {HISTORY} SELECT bar_ts, feature_ts, {XS_ROUNDED} FROM hist",
    "asof_tolerance": f"""WITH {BARS}, thick AS (SELECT * FROM bars WHERE volume > 2),
        m AS (SELECT b.series, b.bar_ts, b.volume, t.bar_ts AS feature_ts, t.close
              FROM bars b ASOF LEFT JOIN thick t
              ON b.series = t.series AND b.bar_ts >= t.bar_ts)
        SELECT series, bar_ts, volume,
          CASE WHEN bar_ts - feature_ts <= INTERVAL 125 minutes THEN feature_ts END AS feature_ts,
          CASE WHEN bar_ts - feature_ts <= INTERVAL 125 minutes THEN close END AS close FROM m""",
    "index_left_join": f"""WITH {BARS}, {INDEX}, {SYMBOLS}, {XSECTION},
        complete AS (SELECT * FROM xs WHERE {_COMPLETE}),
        j AS (SELECT i.bar_ts, open AS index_open, high AS index_high, low AS index_low,
              close AS index_close, volume, {_XS} FROM idx i LEFT JOIN complete USING (bar_ts))
        SELECT bar_ts, {_r(_OHLC_INDEX)}, {XS_ROUNDED} FROM j""",
    "backfill_join": f"WITH {SESSION} SELECT series, bar_ts, {_r(_OHLC_INDEX)}, {XS_ROUNDED} FROM sess",
    "backfill_upsert": f"""WITH {SESSION}, top AS ({_NEWEST.format(t='sess', cond='<= 200')})
        SELECT series, bar_ts, {_r(_OHLC_INDEX)}, {XS_ROUNDED} FROM top""",
    "feature_frame": FEATURE_SQL,
    "feature_frame_blocks": FEATURE_SQL,
    "complete_features": f"""WITH RECURSIVE {FEATURES}
        SELECT bar_ts, {_frame_select(EXPANSION_FEATURES)} FROM feats WHERE {_PRESENT}""",
    "score_chain": f"""WITH RECURSIVE {SCORED}
        SELECT bar_ts, side, {_r("exp_p p_down p_up p_win")} FROM scored""",
    "stacked_inputs": f"""WITH RECURSIVE {SCORED} SELECT bar_ts, side, """
    + ", ".join(f"{_round(f'{n}::DOUBLE', 5)} AS {n}" for n in META_FEATURES if n != "side")
    + " FROM scored",
    "signals": f"WITH RECURSIVE {SIGNALS} SELECT * FROM sig6",
    "signal_text": f"""WITH RECURSIVE {SIGNALS} SELECT bar_ts, printf(
        E'%s\\nSide: %s\\nEntry: %.2f\\nStop: %.2f\\nTarget: %.2f\\nexp_p: %.3f\\np_win: %.3f',
        strftime(bar_ts, '%Y-%m-%d %H:%M:%S'), CASE WHEN side = 1 THEN 'LONG' ELSE 'SHORT' END,
        entry, stop, target, exp_p, p_win) AS text FROM sig""",
    "signal_log": f"""WITH RECURSIVE {SIGNALS} SELECT bar_ts AS timestamp, 'example' AS system,
        side, entry, stop, target, exp_p, p_win FROM sig6""",
    "seed_history": f"""WITH {HISTORY} SELECT bar_ts, {_round('open')} AS index_open,
        {_round('high')} AS index_high, {_round('low')} AS index_low,
        {_round('close')} AS index_close,
        {XS_ROUNDED} FROM hist""",
    # A bar is closed once the watermark (newest tick less one hour) has reached its end.
    "stream_bars": f"""WITH {BARS} SELECT *, true AS is_final FROM bars
        WHERE bar_ts + INTERVAL 1 hour <= (SELECT max(ts) FROM events) - INTERVAL 1 hour""",
    "stream_live_view": f"""WITH {BARS} SELECT *, bar_ts + INTERVAL 1 hour
        <= (SELECT max(ts) FROM events) - INTERVAL 1 hour AS is_final FROM bars""",
    "provisional_signals": f"""WITH RECURSIVE {SCORED},
        marked AS (SELECT *, bar_ts + INTERVAL 1 hour
          <= (SELECT max(ts) FROM events) - INTERVAL 1 hour AS is_final FROM scored),
        levels AS (SELECT *, CASE WHEN side = 1
            THEN CASE WHEN is_final THEN hi_ref ELSE hi_open END
            ELSE CASE WHEN is_final THEN lo_ref ELSE lo_open END END AS entry
          FROM marked WHERE p_win >= 0.6),
        full_rows AS (SELECT *, entry - side * {STOP_R} * atr AS stop,
          entry + side * {TARGET_R} * atr AS target FROM levels)
        SELECT is_final, bar_ts, feature_ts, side, {_r("entry stop target exp_p p_win")}
        FROM full_rows""",
    "stream_signals": f"""WITH RECURSIVE {SIGNALS} SELECT * FROM sig6
        WHERE bar_ts + INTERVAL 1 hour <= (SELECT max(ts) FROM events) - INTERVAL 1 hour""",
    "stream_backfill_live": f"""WITH {BARS}, b AS (SELECT *, bar_ts >= {_OPEN} AS official FROM bars)
        SELECT series, bar_ts, CASE WHEN official THEN round(open) ELSE open END AS open,
          CASE WHEN official THEN round(high) ELSE high END AS high,
          CASE WHEN official THEN round(low) ELSE low END AS low,
          CASE WHEN official THEN round(close) ELSE close END AS close, volume
        FROM b WHERE official OR {_CLOSED}""",
    "stream_replay": f"""WITH {BARS} SELECT * REPLACE (CASE WHEN series = 'click' THEN 0 ELSE close END AS close)
        FROM bars WHERE series = 'click' OR bar_ts < TIMESTAMP '2024-01-16'""",
    "stream_restated_signal": "WITH RECURSIVE "
    + SIGNALS.replace(BARS, _RESTATED_BARS).replace(INDEX, _RESTATED_INDEX) + " SELECT * FROM sig6",
    "stream_repeated_ticks": f"WITH {BARS} SELECT * FROM bars",
    "store_merge": f"""WITH {BARS} SELECT * REPLACE (
        CASE WHEN series = 'click' AND bar_ts >= TIMESTAMP '2024-01-20' THEN high ELSE close END AS close)
        FROM bars""",
    "bars_ties": f"""WITH {_TIED} {_tied_bars('event_type')} UNION ALL {_tied_bars("'ALL'")}""",
    "asof_ties": f"""WITH {_TIED}, {INDEX},
        r AS (SELECT ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM t GROUP BY 1)
        SELECT idx.bar_ts, r.ts AS feature_ts, r.event_id, r.value
        FROM idx ASOF LEFT JOIN r ON idx.bar_ts >= r.ts""",
    "newest_stored": f"WITH {BARS} {_NEWEST.format(t='bars', cond='<= 200')}",
}
