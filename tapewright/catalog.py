"""Registered queries: every operator on the given tables.

Ticks are the ``events`` table: series = event type ("equities"), all series together = the
index, price = value, volume = number of events, one-hour bars. Doubles are rounded at the
very end so that results can be compared with another engine.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import clock
from .functions.columns import (
    clip_above,
    clip_below,
    flag,
    larger,
    model_input,
    smaller,
    typical_price,
)
from .operators.align import asof_backward, left_on_time
from .operators.bars import build_bars, merge_series, with_prefix
from .operators.blocks import Ordered, ordered
from .operators.ewm import Ewm, ewm_means
from .operators.history import (
    keep_first,
    keep_last,
    last_bar,
    newest,
    overlay,
    stack,
    upsert,
    with_min_history,
)
from .operators.instruments import contains, listed, lookup, resolve_tokens
from .operators.quality import (
    bars_per_symbol,
    coverage_summary,
    members_per_bar,
    missing_profile,
)
from .operators.spread import tail_spread, tail_spread_by_rank
from .operators.windows import (
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
from .operators.xsection import (
    LOADINGS,
    advance_decline,
    cross_section,
    fit_cross_section_pca,
    pivot_symbols,
    project,
    share_positive,
    share_with_mean_sign,
    symbol_columns,
)
from .plans.backfill import backfill, session_rows
from .plans.cycle import SignalPlan
from .plans.features import FeatureSpec, complete_rows, derived_columns
from .plans.scoring import LogisticScorer, ModelChain, stacked_row
from .plans.signals import signal_text, signals, with_reference_levels
from .schemas import (
    BAR,
    DIRECTION_FEATURES,
    EXPANSION_FEATURES,
    META_FEATURES,
    MIN_HISTORY,
    OHLC,
    SIGNAL,
    TICK,
    XSECTION_COLUMNS,
    SessionSpec,
)
from .session import materialize, new_path
from .sources.commits import Commits
from .sources.tables import (
    append_log,
    gate,
    read_bars,
    read_log,
    read_newest,
    read_seed_history,
    since_open,
    time_range,
    write_bars,
    write_seed_history,
)
from .streaming.live import (
    STORED_BAR,
    SignalJob,
    backfill_store,
    live_bars,
    live_view,
    merge_store,
    read_open_bars,
    read_store,
    read_ticks,
    start_bar_store,
    start_open_bars,
    store_batch,
    stored_rows,
)

HOURLY = SessionSpec(bar_minutes=60)
WIDTH = "1 hour"
SPEC = FeatureSpec(session=HOURLY)
MEMBERS = ["click", "error", "purchase", "signup", "view"]
# Loadings of the example universe: (mean, weight) per member.
EXAMPLE_LOADINGS = {
    "click": (0.01, 0.5),
    "error": (-0.02, 0.4),
    "purchase": (0.0, -0.3),
    "signup": (0.03, 0.6),
    "view": (-0.01, 0.37),
}
FRESH_FROM = datetime(2024, 1, 20)
HISTORY_TO = datetime(2024, 1, 25)
BACK_TO = datetime(2024, 1, 10)
REPLAY_END = datetime(2024, 1, 16)
RESTATED_FROM = datetime(2024, 1, 20)
TAIL = 200
TIE_SHIFT = 1e-9


def example_weights(n: int) -> list[float]:
    """Small fixed weights, so that probabilities spread out."""
    return [0.001 * ((i * 5) % 7 - 3) for i in range(n)]


def example_scorer(features: list[str], intercept: float) -> LogisticScorer:
    return LogisticScorer(tuple(features), tuple(example_weights(len(features))), intercept)


EXAMPLE_INTERCEPTS = {"expansion": 0.2, "direction": 0.1, "win": 0.3}


def example_chain() -> ModelChain:
    i = EXAMPLE_INTERCEPTS
    return ModelChain(
        example_scorer(EXPANSION_FEATURES, i["expansion"]),
        example_scorer(DIRECTION_FEATURES, i["direction"]),
        example_scorer(META_FEATURES, i["win"]),
    )


def example_loadings(spark: SparkSession) -> DataFrame:
    rows = [(s, m, w) for s, (m, w) in EXAMPLE_LOADINGS.items()]
    return spark.createDataFrame(rows, LOADINGS)


# ---------------------------------------------------------------- inputs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(TICK).parquet(f"{sf_dir}/events.parquet")


def tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_bars(events(spark, sf_dir), WIDTH)


def series_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tick_bars(spark, sf_dir).select(*BAR.names)


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_series(tick_bars(spark, sf_dir), "ALL")


def ordered_series(spark: SparkSession, sf_dir: str, **kw) -> Ordered:
    bars = materialize(series_bars(spark, sf_dir), "bars")
    return ordered(bars, bar_seconds=HOURLY.bar_seconds, **kw)


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbol_columns(series_bars(spark, sf_dir).where(F.col("series").isin(*MEMBERS)))


def example_plan(spark: SparkSession) -> SignalPlan:
    return SignalPlan(MEMBERS, example_loadings(spark), example_chain(), SPEC, "ALL")


def index_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index bars with the newest complete cross-section row at or before each."""
    bars = materialize(tick_bars(spark, sf_dir), "bars")
    return example_plan(spark).history(bars)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles. The small shift moves exact ties (5 in the last digit) off the edge, so
    that the last bits of a sum do not decide them; adding zero turns -0.0 into 0.0."""
    return df.select(
        *[
            (F.round(F.col(f.name) + F.lit(TIE_SHIFT), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# ---------------------------------------------------------------- scans, projections, filters


def bars_ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_bars(spark, sf_dir)


def bars_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_bars(spark, sf_dir)


def bars_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written to day folders, then a range of two series read back."""
    path = new_path(spark, "bar-table")
    write_bars(series_bars(spark, sf_dir), path)
    return read_bars(
        spark, path, series=["click", "view"], start=datetime(2024, 1, 9, 9, 15),
        end=datetime(2024, 1, 16, 15, 30),
    )


def scan_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = time_range(
        events(spark, sf_dir), datetime(2024, 1, 9, 9, 15), datetime(2024, 1, 9, 15, 30), "ts"
    )
    return window.where(F.col("event_type").isin("click", "view")).select(
        "event_id", "ts", F.col("event_type").alias("series"), "value"
    )


def bars_session_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate(series_bars(spark, sf_dir), HOURLY)


def ticks_session_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate(events(spark, sf_dir), HOURLY, "ts").select("event_id", "ts")


def index_rename_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = with_prefix(index_bars(spark, sf_dir), "index_")
    return bars.select("bar_ts", "index_close", "index_high", "index_low", "index_open")


def instrument_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .where(
            listed(
                F.col("p_type"), F.col("p_brand"), F.col("p_size"),
                on="ECONOMY", of=11, symbols=["Brand#2", "Brand#7", "Brand#11"],
            )
            | contains(F.col("p_name"), "gizmo")
        )
        .select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    )


def instrument_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as an instrument master: brand = exchange, name = symbol, type = kind."""
    master = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("instrument_token"),
        F.col("p_name").alias("tradingsymbol"),
        F.col("p_brand").alias("exchange"),
        F.col("p_type").alias("instrument_type"),
        F.col("p_type").alias("segment"),
    )
    return resolve_tokens(
        master,
        universe=["red bolt", "blue bolt", "small ring"],
        index_symbols=["red widget", "old bolt"],
        index_name="INDEX",
        exchange="Brand#7",
        kind="SMALL",
        index_segment="ECON",
    )


def dim_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    return lookup(nations, table(spark, sf_dir, "region"), "r_regionkey").select(
        "n_nationkey", "n_name", "r_name"
    )


def clean_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of some series made missing or not finite, then cleaned."""
    kind = F.col("event_type")
    dirty = (
        F.when(kind == "error", F.lit(float("nan")))
        .when(kind == "click", F.lit(float("inf")))
        .when(kind == "view", F.lit(float("-inf")))
        .when(kind == "signup", F.lit(None).cast("double"))
        .otherwise(F.col("value"))
    )
    return events(spark, sf_dir).select("event_id", model_input(dirty).alias("x"))


def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = symbols(spark, sf_dir).withColumn("nothing", F.lit(None).cast("double"))
    return missing_profile(
        rows.withColumn("_at", F.struct("bar_ts", "series")),
        ["close", "adv", "norm_vol", "ret", "nothing"],
        "_at",
    )


def symbol_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members_per_bar(series_bars(spark, sf_dir))


def symbol_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_per_symbol(series_bars(spark, sf_dir))


def symbol_bars_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(coverage_summary(series_bars(spark, sf_dir)))


def min_history_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days (as series) with at least the minimum number of index bars."""
    daily = index_bars(spark, sf_dir).withColumn("trade_date", F.to_date("bar_ts"))
    return with_min_history(daily, MIN_HISTORY, keys=["trade_date"]).select("bar_ts", "close")


# ---------------------------------------------------------------- clock


def time_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    five = SessionSpec()
    return rounded(
        events(spark, sf_dir).select(
            "event_id",
            clock.minute_of_day(ts).alias("minute_of_day"),
            F.to_date(ts).alias("trade_date"),
            clock.bar_floor(ts, five.bar_width).alias("bar_ts"),
            clock.session_open(ts, five).alias("session_open"),
            (ts - clock.minutes(five.lookback_minutes)).alias("lookback_start"),
            ((clock.minute_of_day(ts) - five.open_minute) / five.session_minutes).alias(
                "session_frac"
            ),
        )
    )


def zone_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTC wall clock to exchange wall clock, and text to time and back."""
    local = clock.wall_clock("ts", HOURLY.zone)
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return events(spark, sf_dir).select(
        "event_id", local.alias("local_ts"), clock.parse_time(text).alias("parsed_ts")
    )


# ---------------------------------------------------------------- history


def _lineitem_order() -> list[str]:
    return [
        "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus",
    ]


def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_first(
        table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], _lineitem_order()
    )


def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_last(
        table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], _lineitem_order()
    )


def stack_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = materialize(tick_bars(spark, sf_dir), "bars")
    return stack(bars.select(*BAR.names), merge_series(bars, "ALL").drop("volume"))


def _history_and_fresh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Overlapping parts of the bars; the fresh part restates the close."""
    bars = materialize(series_bars(spark, sf_dir), "bars")
    history = bars.where(F.col("bar_ts") <= F.lit(HISTORY_TO))
    fresh = bars.where(F.col("bar_ts") >= F.lit(FRESH_FROM)).withColumn(
        "close", F.col("close") + 1.0
    )
    return history, fresh


def upsert_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(upsert(*_history_and_fresh(spark, sf_dir), rows=TAIL))


def overlay_provisional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(overlay(*_history_and_fresh(spark, sf_dir)))


def newest_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest(materialize(series_bars(spark, sf_dir), "bars"), TAIL)


def last_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_bar(series_bars(spark, sf_dir))


def second_last_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_bar(materialize(series_bars(spark, sf_dir), "bars"), back=1)


# ---------------------------------------------------------------- series windows


def _series_query(lookback: int, out: list[str], *levels):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = ordered_series(spark, sf_dir).derive(lookback, *levels).df
        return rounded(df.select("series", "bar_ts", *out))

    return query


returns_momentum = _series_query(
    6,
    ["prev_close", "d1", "d2", "d3", "ret1", "mom_3", "mom_6"],
    lambda w: {
        "prev_close": lag("close", 1, w),
        **{f"d{k}": diff("close", k, w) for k in (1, 2, 3)},
        "ret1": pct_change("close", 1, w),
        "mom_3": pct_change("close", 3, w),
        "mom_6": pct_change("close", 6, w),
    },
)

rolling_mean_sum = _series_query(
    47,
    ["mean6", "mean14", "mean20", "mean48", "sum6"],
    lambda w: {f"mean{n}": rolling_mean("close", n, w) for n in (6, 14, 20, 48)}
    | {"sum6": rolling_sum("close", 6, w)},
)

rolling_std_widths = _series_query(
    49,
    ["std12", "std20", "std48", "std50"],
    lambda w: {f"std{n}": rolling_std("close", n, w) for n in (12, 20, 48, 50)},
)

rolling_extremes = _series_query(
    20,
    ["max6", "min6", "max20", "min20", "break_up", "break_dn", "lower_high", "higher_low",
     "broke_prior_high"],
    lambda w: {
        "max6": rolling_max("high", 6, w),
        "min6": rolling_min("low", 6, w),
        "max20": rolling_max("high", 20, w),
        "min20": rolling_min("low", 20, w),
        "lower_high": flag(F.col("high") < rolling_max("high", 12, w, skip=1)),
        "higher_low": flag(F.col("low") > rolling_min("low", 12, w, skip=1)),
        "broke_prior_high": flag(F.col("close") > rolling_max("high", 20, w, skip=1)),
    },
    lambda w: {
        "break_up": flag(F.col("close") > F.col("max20")),
        "break_dn": flag(F.col("close") < F.col("min20")),
    },
)

rolling_quantile_70 = _series_query(
    49, ["q70"], lambda w: {"q70": rolling_quantile("close", 50, 0.7, w)}
)

rolling_zscore = _series_query(
    47,
    ["z20", "z48"],
    lambda w: {"z20": zscore("close", 20, w), "z48": zscore("close", 48, w)},
)

atr14 = _series_query(
    14,
    ["true_range", "atr"],
    lambda w: {"true_range": true_range("high", "low", "close", w)},
    lambda w: {"atr": rolling_mean("true_range", 14, w)},
)

wick_range = _series_query(
    5,
    ["lower_wick", "upper_wick", "wick_skew_30m", "range_skew_30m"],
    lambda w: {
        "lower_wick": smaller("open", "close") - F.col("low"),
        "upper_wick": F.col("high") - larger("open", "close"),
    },
    lambda w: {
        "wick_skew_30m": rolling_mean(F.col("upper_wick") - F.col("lower_wick"), 6, w),
        "range_skew_30m": rolling_mean(F.col("high") + F.col("low") - 2 * F.col("open"), 6, w),
    },
)

ret_skew = _series_query(
    7,
    ["pos_ret", "neg_ret", "skew"],
    lambda w: {"_ret": pct_change("close", 1, w)},
    lambda w: {
        "pos_ret": rolling_sum(clip_below("_ret"), 6, w),
        "neg_ret": rolling_sum(-clip_above("_ret") + F.lit(0.0), 6, w),
    },
    lambda w: {"skew": F.col("pos_ret") - F.col("neg_ret")},
)


def ref_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of final bars, and of the same bars taken as provisional."""
    bars = ordered_series(spark, sf_dir)
    final = with_reference_levels(bars, "")
    marked = bars.with_df(
        final.df.withColumnsRenamed({"hi_ref": "hi_final", "lo_ref": "lo_final"}).withColumn(
            "is_final", F.lit(False)
        )
    )
    return with_reference_levels(marked, "").df.select(
        "series", "bar_ts", "hi_final", "lo_final", "hi_ref", "lo_ref"
    )


def cum_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = ordered_series(spark, sf_dir, totals={"total": typical_price()})
    return rounded(
        bars.df.select(
            "series", "bar_ts", (F.col("total") + F.lit(SPEC.running_base)).alias("running_vwap")
        ),
        4,
    )


def _ewm_query(source_of: Callable, adjust: bool, spans: tuple[int, ...], **layout):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = ordered_series(spark, sf_dir, **layout)
        prepared = bars.with_df(bars.df.withColumn("x", source_of()))
        names = [f"ewm{n}" for n in spans]
        means = [Ewm(o, "x", n, adjust) for o, n in zip(names, spans, strict=True)]
        return rounded(ewm_means(prepared, means).df.select("series", "bar_ts", *names))

    return query


def _gapped():
    """Close, missing on thin bars (so there are gaps of any length)."""
    return F.when(F.col("volume") > 2, F.col("close"))


ewm_adjust_true = _ewm_query(lambda: F.col("close"), True, (5, 15, 30))
ewm_adjust_false = _ewm_query(lambda: F.col("close"), False, (3, 6, 12))
ewm_gaps_true = _ewm_query(_gapped, True, (5, 15, 30))
ewm_gaps_false = _ewm_query(_gapped, False, (3, 6, 12))
# The same on the layout for series too long for one task.
ewm_gaps_blocks = _ewm_query(_gapped, False, (3, 6, 12), task_rows=0, block_rows=100)


def rolling_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling mean, quantile and running total on the layout for long series."""
    bars = ordered_series(
        spark, sf_dir, totals={"total": typical_price()}, task_rows=0, block_rows=100
    )
    out = bars.derive(
        49,
        lambda w: {
            "mean48": rolling_mean("close", 48, w),
            "q70": rolling_quantile("close", 50, 0.7, w),
        },
    )
    return rounded(out.df.select("series", "bar_ts", "seq", "total", "mean48", "q70"))


def adv_norm_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        symbols(spark, sf_dir).select(
            "series", "bar_ts", "vwap", "adv", "norm_vol", "ret", "active", "vwap_pressure"
        )
    )


def adv_norm_volume_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the daily reset."""
    rows = symbol_columns(ordered_series(spark, sf_dir))
    return rounded(rows.select("series", "bar_ts", "adv", "norm_vol", "ret"))


# ---------------------------------------------------------------- cross-section


def _per_bar(**columns):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        grouped = symbols(spark, sf_dir).groupBy("bar_ts")
        return rounded(grouped.agg(*[c().alias(n) for n, c in columns.items()]))

    return query


breadth = _per_bar(
    eq_norm_volume=lambda: F.avg("norm_vol"),
    vwap_pressure=lambda: F.avg("vwap_pressure"),
    liquidity_breadth=lambda: F.avg("active"),
    pct_vwap_up=lambda: share_positive("vwap_pressure"),
)
adv_dec_ratio = _per_bar(adv_dec_volume_ratio=advance_decline)
dispersion = _per_bar(vwap_disp=lambda: F.stddev_samp("vwap_pressure"))
flow_align = _per_bar(pct_flow_align=lambda: share_with_mean_sign("vwap_pressure"))


def tail_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = symbols(spark, sf_dir).groupBy("bar_ts").agg(
        F.collect_list("vwap_pressure").alias("pressures"), F.collect_list("ret").alias("returns")
    )
    return rounded(
        tail_spread(arrays, {"pressures": "vwap_tb_spread", "returns": "ret_tb_spread"})
    )


def tail_spread_hot_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few groups that hold all rows: spread of order totals per order priority."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice")
    return rounded(
        tail_spread_by_rank(orders, ["o_orderpriority"], "o_totalprice", "price_tb_spread"), 3
    )


def pivot_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pivot_symbols(symbols(spark, sf_dir), MEMBERS))


def pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(project(symbols(spark, sf_dir), example_loadings(spark)))


def pca_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(symbols(spark, sf_dir), "symbols")
    return rounded(fit_cross_section_pca(rows, MEMBERS))


def xsection_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        cross_section(symbols(spark, sf_dir), universe=MEMBERS, loadings=example_loadings(spark))
    )


def xsection_any_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same features without a declared universe: spreads ranked in pieces."""
    rows = materialize(symbols(spark, sf_dir), "symbols")
    return rounded(cross_section(rows, loadings=example_loadings(spark)))


# ---------------------------------------------------------------- alignment


def asof_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        index_history(spark, sf_dir).select("bar_ts", "feature_ts", *XSECTION_COLUMNS)
    )


def asof_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per series: the newest earlier bar with more than two ticks, at most 125 minutes old."""
    bars = materialize(series_bars(spark, sf_dir), "bars")
    thick = bars.where(F.col("volume") > 2).select("series", "bar_ts", "close")
    out = asof_backward(
        bars.select("series", "bar_ts", "volume"),
        thick,
        by=["series"],
        columns=["close"],
        tolerance=clock.minutes(HOURLY.lookback_minutes),
        span_seconds=86400,
    )
    return rounded(out)


def _index_and_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    bars = materialize(tick_bars(spark, sf_dir), "bars")
    rows = cross_section(
        symbol_columns(bars), universe=MEMBERS, loadings=example_loadings(spark)
    )
    return merge_series(bars, "ALL"), bars, rows


def index_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _, rows = _index_and_rows(spark, sf_dir)
    return rounded(
        left_on_time(with_prefix(index, SPEC.prefix), rows.na.drop("any")).drop("series")
    )


def _session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, bars, _ = _index_and_rows(spark, sf_dir)
    return session_rows(
        index, bars, HOURLY, universe=MEMBERS, loadings=example_loadings(spark)
    )


def backfill_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_session_rows(spark, sf_dir))


def backfill_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions' rows put into a history that ends earlier and has other closes."""
    rows = materialize(_session_rows(spark, sf_dir), "session")
    history = rows.where(F.col("bar_ts") <= F.lit(BACK_TO)).withColumn(
        "index_close", F.col("index_close") + 1.0
    )
    return rounded(backfill(history, rows, rows=TAIL))


# ---------------------------------------------------------------- features, scores, signals


def _features(spark: SparkSession, sf_dir: str, **layout) -> Ordered:
    return example_plan(spark).features(index_history(spark, sf_dir), **layout)


def _frame_columns() -> list[str]:
    return ["bar_ts", *XSECTION_COLUMNS, *[c for c in derived_columns(SPEC)]]


def index_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_features(spark, sf_dir).df.select(*_frame_columns()), 5)


def index_features_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on the layout for series too long for one task."""
    frame = _features(spark, sf_dir, task_rows=0, block_rows=128)
    return rounded(frame.df.select(*_frame_columns()), 5)


def complete_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = complete_rows(_features(spark, sf_dir).df, SPEC)
    return rounded(frame.select("bar_ts", *EXPANSION_FEATURES), 5)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return example_plan(spark).scored(_features(spark, sf_dir))


def score_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    return rounded(scored.select("bar_ts", "exp_p", "p_down", "p_up", "side", "p_win"))


def stacked_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    return rounded(stacked_row(scored, "bar_ts"), 5)


def trade_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals(_scored(spark, sf_dir)))


def signal_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal_text(signals(_scored(spark, sf_dir))).select("bar_ts", "text")


def signal_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals appended to the log table, read back."""
    path = new_path(spark, "log")
    rows = trade_signals(spark, sf_dir)
    append_log(rows, path, "example")
    return read_log(spark, path, rows.schema).select(
        "timestamp", "system", "side", "entry", "stop", "target", "exp_p", "p_win"
    )


def seed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History written as a seed CSV file, read back."""
    path = new_path(spark, "seed")
    write_seed_history(index_history(spark, sf_dir), path, SPEC.prefix)
    return rounded(read_seed_history(spark, path, SPEC.prefix))


# ---------------------------------------------------------------- streams


def _run(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def _stream_session(spark: SparkSession) -> SparkSession:
    """Session with one state partition per core. The number is fixed for the life of a
    stream's state, and state does not take part in adaptive execution."""
    session = spark.newSession()
    zone, partitions = "spark.sql.session.timeZone", "spark.sql.shuffle.partitions"
    cores = spark.sparkContext.defaultParallelism
    session.conf.set(zone, spark.conf.get(zone))
    session.conf.set(partitions, str(min(int(spark.conf.get(partitions)), cores)))
    return session


def _replay(
    spark: SparkSession, sf_dir: str, *, final: bool, on_batch=None, delay: str = "1 hour"
) -> str:
    """Run the tick file through a bar stream to its end; the folder of the bar store."""
    path = new_path(spark, "live")
    bars = live_bars(
        read_ticks(_stream_session(spark), sf_dir, name="events.parquet"),
        WIDTH, delay, final=final, tick_key=["event_id"] if final else (),
    )
    handler = on_batch(path) if on_batch else None
    _run(
        start_bar_store(
            bars, f"{path}/bars", f"{path}/state",
            mode="append" if final else "update", on_batch=handler,
            trigger={"availableNow": True},
        )
    )
    return path


def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars closed by the watermark."""
    path = _replay(spark, sf_dir, final=True)
    return read_store(spark, f"{path}/bars", STORED_BAR).select(*BAR.names, "is_final")


def _live_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = read_store(spark, f"{_replay(spark, sf_dir, final=True)}/bars", STORED_BAR)
    seen = read_store(spark, f"{_replay(spark, sf_dir, final=False)}/bars", STORED_BAR)
    return live_view(closed, seen)


def stream_live_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed bars together with the bars still open."""
    return _live_bars(spark, sf_dir).select(*BAR.names, "is_final")


def provisional_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals on closed and still open bars; nothing of the open bars is kept in the history."""
    view = materialize(_live_bars(spark, sf_dir), "view")
    return rounded(example_plan(spark)(view))


def stream_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of closed bars, written batch by batch."""

    def job(path: str) -> SignalJob:
        return SignalJob(f"{path}/bars", f"{path}/signals", SIGNAL, example_plan(spark))

    path = _replay(spark, sf_dir, final=True, on_batch=job)
    return rounded(job(path).read(spark))


def _tied_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks whose times are cut to the minute, so that many are equal."""
    return events(spark, sf_dir).withColumn("ts", F.date_trunc("minute", "ts").cast("timestamp_ntz"))


def bars_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of series and index from ticks with equal times, told apart by their id."""
    bars = materialize(build_bars(_tied_ticks(spark, sf_dir), WIDTH, sequence="event_id"), "bars")
    return stack(bars.select(*BAR.names), merge_series(bars, "ALL").select(*BAR.names))


def asof_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per bar time: the newest tick at or before it; of ticks of one time, the last one."""
    ticks = materialize(_tied_ticks(spark, sf_dir).withColumnRenamed("ts", "bar_ts"), "ticks")
    times = materialize(index_bars(spark, sf_dir).select("bar_ts"), "times")
    return asof_backward(
        times, ticks.select("bar_ts", "event_id", "value"), columns=["event_id", "value"],
        span_seconds=6 * 3600, sequence="event_id",
    )


def _stored_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bars in the form of the bar store, as a table."""
    bars = tick_bars(spark, sf_dir).withColumn("is_final", F.lit(True))
    return materialize(bars.select(*STORED_BAR.names), "bars")


def stream_backfill_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live run, a session back-fill with official (rounded) prices, then the live run's first
    batch once more: the back-fill counts where it has bars, the live bars elsewhere."""
    store = f"{_replay(spark, sf_dir, final=True)}/bars"
    official = since_open(_stored_bars(spark, sf_dir), SPEC.session).withColumns(
        {c: F.round(c) for c in OHLC}
    )
    backfill_store(official, store, name="session")
    first = Commits(spark, store).all[0]
    again = stored_rows(spark, store, STORED_BAR).where(F.col("commit") == first.name)
    again = materialize(again.select(*STORED_BAR.names), "again")
    store_batch(again, first.batch, store, epoch=first.epoch)
    return read_store(spark, store, STORED_BAR).select(*BAR.names)


def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with all days, one that restates a series, then the first one again with fewer days."""
    store, bars = new_path(spark, "store"), _stored_bars(spark, sf_dir)
    store_batch(bars, 0, store, epoch="run")
    store_batch(bars.where(F.col("series") == "click").withColumn("close", F.lit(0.0)), 1, store, epoch="run")
    store_batch(bars.where(F.col("bar_ts") < F.lit(REPLAY_END)), 0, store, epoch="run")
    return read_store(spark, store, STORED_BAR).select(*BAR.names)


def stream_restated_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals written batch by batch, then the last days restated: what they gave is withdrawn
    or replaced, as if the restated bars had been there from the start."""

    def job(path: str) -> SignalJob:
        return SignalJob(f"{path}/bars", f"{path}/signals", SIGNAL, example_plan(spark))

    path = _replay(spark, sf_dir, final=True, on_batch=job)
    stored = read_store(spark, f"{path}/bars", STORED_BAR)
    flat = stored.where(F.col("bar_ts") >= F.lit(RESTATED_FROM)).withColumn("close", F.col("open"))
    backfill_store(materialize(flat, "restated"), f"{path}/bars", name="restated", signals=job(path))
    return rounded(job(path).read(spark))


def stream_repeated_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open bars of a stream that delivers every tick twice."""
    files, path = new_path(spark, "ticks"), new_path(spark, "open")
    for _ in range(2):
        events(spark, sf_dir).write.mode("append").parquet(files)
    _run(
        start_open_bars(
            read_ticks(_stream_session(spark), files), WIDTH, "1 hour", f"{path}/bars", f"{path}/state",
            tick_key=["event_id"], trigger={"availableNow": True},
        )
    )
    return read_open_bars(spark, f"{path}/bars").select(*BAR.names)


def store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert into the bar store: only the days of the fresh bars are written again."""
    store, bars = new_path(spark, "store"), _stored_bars(spark, sf_dir)
    store_batch(bars, 0, store)
    late = bars.where(F.col("bar_ts") >= F.lit(RESTATED_FROM)).where(F.col("series") == "click")
    merge_store(spark, store, STORED_BAR, late.withColumn("close", F.col("high")), epoch="merge")
    return read_store(spark, store, STORED_BAR).select(*BAR.names)


def newest_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest bars of a stored table, found by its stored row counts per day."""
    path = new_path(spark, "bars")
    write_bars(materialize(series_bars(spark, sf_dir), "bars"), path)
    return read_newest(spark, path, TAIL)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "bars_ohlcv": bars_ohlcv,
    "bars_index": bars_index,
    "bars_stored": bars_stored,
    "scan_range": scan_range,
    "bars_session_filter": bars_session_filter,
    "ticks_session_filter": ticks_session_filter,
    "index_rename_project": index_rename_project,
    "instrument_filter": instrument_filter,
    "instrument_tokens": instrument_tokens,
    "dim_lookup": dim_lookup,
    "clean_inputs": clean_inputs,
    "null_profile": null_profile,
    "symbol_coverage": symbol_coverage,
    "symbol_bars": symbol_bars,
    "symbol_bars_summary": symbol_bars_summary,
    "min_history_gate": min_history_gate,
    "time_of_day": time_of_day,
    "zone_shift": zone_shift,
    "dedupe_keep_first": dedupe_keep_first,
    "dedupe_keep_last": dedupe_keep_last,
    "stack_frames": stack_frames,
    "upsert_tail": upsert_tail,
    "overlay_provisional": overlay_provisional,
    "newest_bars": newest_bars,
    "last_bar": last_bars,
    "second_last_bar": second_last_bars,
    "returns_momentum": returns_momentum,
    "rolling_mean_sum": rolling_mean_sum,
    "rolling_std": rolling_std_widths,
    "rolling_extremes": rolling_extremes,
    "rolling_quantile": rolling_quantile_70,
    "rolling_zscore": rolling_zscore,
    "rolling_blocks": rolling_blocks,
    "atr14": atr14,
    "wick_range": wick_range,
    "ret_skew": ret_skew,
    "ref_levels": ref_levels,
    "cum_typical": cum_typical,
    "ewm_adjust_true": ewm_adjust_true,
    "ewm_adjust_false": ewm_adjust_false,
    "ewm_gaps_true": ewm_gaps_true,
    "ewm_gaps_false": ewm_gaps_false,
    "ewm_gaps_blocks": ewm_gaps_blocks,
    "adv_norm_volume": adv_norm_volume,
    "adv_norm_volume_running": adv_norm_volume_running,
    "breadth": breadth,
    "adv_dec_ratio": adv_dec_ratio,
    "dispersion": dispersion,
    "tail_spread": tail_spreads,
    "tail_spread_hot_groups": tail_spread_hot_groups,
    "flow_align": flow_align,
    "pivot_pressure": pivot_pressure,
    "pca_projection": pca_projection,
    "pca_fit": pca_fitted,
    "xsection_features": xsection_features,
    "xsection_any_size": xsection_any_size,
    "asof_features": asof_features,
    "asof_tolerance": asof_tolerance,
    "index_left_join": index_left_join,
    "backfill_join": backfill_join,
    "backfill_upsert": backfill_upsert,
    "feature_frame": index_features,
    "feature_frame_blocks": index_features_blocks,
    "complete_features": complete_features,
    "score_chain": score_chain,
    "stacked_inputs": stacked_inputs,
    "signals": trade_signals,
    "signal_text": signal_messages,
    "signal_log": signal_log,
    "seed_history": seed_history,
    "stream_bars": stream_bars,
    "stream_live_view": stream_live_view,
    "provisional_signals": provisional_signals,
    "stream_signals": stream_signals,
    "stream_backfill_live": stream_backfill_live,
    "stream_replay": stream_replay,
    "stream_restated_signal": stream_restated_signal,
    "stream_repeated_ticks": stream_repeated_ticks,
    "store_merge": store_merge,
    "newest_stored": newest_stored,
    "bars_ties": bars_ties,
    "asof_ties": asof_ties,
}
