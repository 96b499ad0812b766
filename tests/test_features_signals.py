from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from data import same, to_pandas, to_spark, walk
from tapewright.functions import clock
from tapewright.functions import columns as C
from tapewright.plans.features import (
    FeatureSpec,
    complete_rows,
    derived_columns,
    feature_frame,
    order_history,
)
from tapewright.plans.scoring import (
    LogisticScorer,
    ModelChain,
    PandasScorer,
    PipelineScorer,
    score,
    stacked_row,
)
from tapewright.plans.signals import signal_text, signals, with_reference_levels
from tapewright.schemas import (
    DIRECTION_FEATURES,
    EXPANSION_FEATURES,
    META_FEATURES,
    SIGNAL,
    XSECTION_COLUMNS,
    SessionSpec,
)
from tapewright.session import materialize

SPEC = FeatureSpec()
DDL = (
    "series string, bar_ts timestamp_ntz, index_open double, index_high double, index_low double,"
    " index_close double, volume double, " + ", ".join(f"{c} double" for c in XSECTION_COLUMNS)
)


def history(n=600, seed=1, gaps=False) -> pd.DataFrame:
    frame = walk(n, seed).rename(columns={c: f"index_{c}" for c in ("open", "high", "low", "close")})
    rng = np.random.default_rng(seed)
    for c in XSECTION_COLUMNS:
        frame[c] = rng.normal(size=n) if c in ("vwap_pressure", "vwap_pca1") else rng.random(n)
        if gaps:
            frame.loc[rng.random(n) < 0.1, c] = np.nan
    return frame


@pytest.fixture(scope="module")
def frames(spark):
    """Feature frames of a gapped history in both layouts."""
    df = materialize(to_spark(spark, history(gaps=True), DDL), "history")
    whole = feature_frame(order_history(df, SPEC), SPEC).df
    split = feature_frame(order_history(df, SPEC, task_rows=0, block_rows=90), SPEC).df
    return to_pandas(whole, "bar_ts"), to_pandas(split, "bar_ts")


def test_every_derived_column_is_there(frames):
    assert len(derived_columns()) == len(set(derived_columns())) == 84
    assert set(derived_columns()) <= set(frames[0].columns)
    assert len(META_FEATURES) == 61


def test_layouts_agree(frames):
    whole, split = frames
    for c in [*XSECTION_COLUMNS, *derived_columns()]:
        if c == "trade_date":
            assert whole[c].tolist() == split[c].tolist()
        else:
            same(whole[c], split[c])


def test_spot_columns_against_pandas(frames):
    """Columns with rules of their own, on a history with gaps."""
    got, h = frames[0], history(gaps=True)
    close, high, low, open_ = (h[f"index_{c}"] for c in ("close", "high", "low", "open"))
    typical = (high + low + close) / 3
    ret = close / close.shift() - 1
    # gains less losses is the sum of returns, gains plus losses that of their sizes
    size, net = (x.rolling(6).sum() for x in (ret.abs(), ret))
    neg, pos = (size - net) / 2, (size + net) / 2
    same(got["vwap_slope"], typical.cumsum().diff(3))
    same(got["vwap_reject_score"], -(close - typical.cumsum()).diff(2))
    same(got["index_vwap"], SPEC.running_base + typical.cumsum(), 1e-12)
    same(got["vol_48"], ret.rolling(48).std())
    same(got["down_pressure"], neg - pos)
    same(got["flow_dir_ema6"], _flow_dir(h).ewm(span=6, adjust=False).mean())
    same(got["advdec_ema12"], h["adv_dec_volume_ratio"].ewm(span=12, adjust=False).mean())
    same(got["ema30_slope"], close.ewm(span=30).mean().diff())
    tired = 6 * h["adv_dec_volume_ratio"].rolling(6).mean() * (close - close.shift(3))
    same(got["exhaustion"], tired)
    pushed = neg.rolling(50).apply(lambda v: v[-1] - np.quantile(v, 0.7), raw=True)
    same(got["sell_exhaustion"], np.where(pushed.gt(1e-15) & tired.gt(0), 1, 0))
    falling, pressed = np.sign(close - close.shift(3)), np.sign((-net).round(15))
    same(got["down_divergence"], 1 - falling.eq(pressed).astype(int))
    earlier = high.shift().rolling(12).max()
    same(got["lower_high"], np.where(high.lt(earlier), 1, 0))
    # upper less lower wick: the body's two ends add up to open plus close
    wicks = high + low - open_ - close
    same(got["wick_skew_30m"], wicks.rolling(6).mean())
    same(got["break_hold"], np.zeros(len(h)))
    minute = h["bar_ts"].dt.hour * 60 + h["bar_ts"].dt.minute
    same(got["session_frac"], (minute - 555) / 375)


def _flow_dir(h: pd.DataFrame) -> pd.Series:
    return (
        np.sign(h["vwap_pressure"])
        + np.sign(h["adv_dec_volume_ratio"] - 1)
        + np.sign(h["liquidity_breadth"] - 0.5)
    )


def test_first_complete_row_and_invariants(spark):
    df = to_spark(spark, history(200, 2), DDL)
    frame = feature_frame(order_history(df, SPEC), SPEC)
    done = to_pandas(complete_rows(frame.df, SPEC), "bar_ts")
    assert len(done) == 200 - 48
    flags = ["break_up", "break_dn", "break_hold", "vwap_reject_up", "vwap_reject_dn",
             "sell_exhaustion", "lower_high", "higher_low", "down_divergence"]
    assert done[flags].isin([0, 1]).all().all()
    assert (done["atr"] >= 0).all() and (done["lower_wick"] >= 0).all()


def test_breakout_option(spark):
    df = to_spark(spark, history(300, 3), DDL)
    spec = FeatureSpec(breakout_excludes_current=True)
    out = feature_frame(order_history(df, spec), spec).df
    assert out.agg(F.sum("break_up")).first()[0] > 0
    assert out.agg(F.sum("break_hold")).first()[0] > 0


# ---------------------------------------------------------------- scalar rules


def test_missing_value_rules(spark):
    df = spark.createDataFrame(
        [(1.0, None, 0.0), (-2.0, 3.0, float("nan")), (None, None, float("-inf"))],
        "a double, b double, c double",
    )
    rows = df.select(
        C.div("a", F.lit(0.0)).alias("div"),
        C.flag(F.col("a") > 0).alias("flag"),
        C.differs(F.col("a"), F.col("b")).alias("differs"),
        C.sign("a").alias("sign"),
        C.clip_below("a").alias("low"),
        C.clip_above("a").alias("high"),
        C.smaller("a", "b").alias("smaller"),
        C.larger("a", "b").alias("larger"),
        C.zero_as_missing("c").alias("zero"),
        C.model_input("c").alias("input"),
    ).collect()
    assert [r["div"] for r in rows] == [None] * 3
    assert [r["flag"] for r in rows] == [1, 0, 0]
    assert [r["differs"] for r in rows] == [1, 1, 1]
    assert [r["sign"] for r in rows] == [1.0, -1.0, None]
    assert [r["low"] for r in rows] == [1.0, 0.0, None]
    assert [r["high"] for r in rows] == [0.0, -2.0, None]
    assert [r["smaller"] for r in rows] == [None, -2.0, None]
    assert [r["larger"] for r in rows] == [None, 3.0, None]
    assert rows[0]["zero"] is None
    assert [r["input"] for r in rows] == [0.0, 0.0, 0.0]


def test_session_gate_and_clock(spark):
    times = ["09:09:59", "09:10:00", "23:25:00", "23:25:00.000001", "23:25:01"]
    df = spark.createDataFrame(
        [(datetime.fromisoformat(f"2024-03-05T{t}"),) for t in times], "t timestamp_ntz"
    )
    spec = SessionSpec()
    rows = df.select(
        clock.in_session("t", spec).alias("inside"),
        clock.session_open("t", spec).alias("open"),
        clock.bar_floor("t", spec.bar_width).alias("floor"),
        clock.wall_clock("t", spec.zone).alias("local"),
        clock.epoch_seconds("t").alias("epoch"),
    ).collect()
    assert [r["inside"] for r in rows] == [False, True, True, False, False]
    assert rows[0]["open"] == datetime(2024, 3, 5, 9, 15)
    assert rows[0]["floor"] == datetime(2024, 3, 5, 9, 5)
    assert rows[1]["local"] == datetime(2024, 3, 5, 14, 40)
    assert rows[1]["epoch"] == int(pd.Timestamp("2024-03-05 09:10").timestamp())
    instant = spark.sql("SELECT TIMESTAMP '2024-03-05 03:45:00 UTC' AS t")
    assert instant.select(clock.drop_zone("t", spec.zone)).first()[0] == datetime(2024, 3, 5, 9, 15)


# ---------------------------------------------------------------- models and signals


def constant(p: float, features=("atr",)) -> LogisticScorer:
    return LogisticScorer(tuple(features), tuple(0.0 for _ in features), float(np.log(p / (1 - p))))


@pytest.fixture(scope="module")
def features(spark):
    df = to_spark(spark, history(160, 4), DDL)
    frame = with_reference_levels(feature_frame(order_history(df, SPEC), SPEC))
    return materialize(complete_rows(frame.df, SPEC), "features")


def test_tie_counts_as_down(features):
    out = score(features, ModelChain(constant(0.5), constant(0.5), constant(0.9)))
    assert {r["side"] for r in out.select("side").distinct().collect()} == {-1}


def test_signal_levels(features):
    for p_up, side in ((0.8, 1), (0.2, -1)):
        scored = score(features, ModelChain(constant(0.7), constant(p_up), constant(0.7)))
        out = signals(scored)
        assert out.schema.names == SIGNAL.names
        got = to_pandas(out.join(features.select("bar_ts", "atr", "hi_ref", "lo_ref"), "bar_ts"), "bar_ts")
        assert (got["side"] == side).all() and len(got) == features.count()
        same(got["entry"], got["hi_ref"] if side == 1 else got["lo_ref"])
        same(got["stop"], got["entry"] - side * 1.2 * got["atr"])
        same(got["target"], got["entry"] + side * 2.35 * got["atr"])
        assert ((got["stop"] - got["entry"]) * (got["target"] - got["entry"]) < 0).all()
    assert signals(score(features, ModelChain(constant(0.7), constant(0.8), constant(0.59)))).isEmpty()


def test_missing_probability_is_rejected(features):
    scored = score(features, ModelChain(constant(0.7), constant(0.8), constant(0.9)))
    assert signals(scored.withColumn("p_win", F.lit(None).cast("double"))).isEmpty()


def test_signal_text(spark):
    rows = spark.createDataFrame(
        [(datetime(2024, 1, 2, 9, 20), datetime(2024, 1, 2, 9, 20), -1, 100.5, 101.25, 98.0, 0.61, 0.7)],
        SIGNAL,
    )
    assert signal_text(rows).first()["text"] == (
        "2024-01-02 09:20:00\nSide: SHORT\nEntry: 100.50\nStop: 101.25\nTarget: 98.00\n"
        "exp_p: 0.610\np_win: 0.700"
    )


def test_coefficients_from_table(spark, features):
    table = spark.createDataFrame(
        [(None, 0.25), ("atr", 0.5), ("ret1", -2.0), ("unrelated", 9.0)],
        "feature string, weight double",
    )
    scorer = LogisticScorer.from_table(table, ["ret1", "atr"])
    assert scorer == LogisticScorer(("ret1", "atr"), (-2.0, 0.5), 0.25)
    got = to_pandas(scorer(features, None, "p"), "bar_ts")
    same(got["p"], 1 / (1 + np.exp(-(0.25 + 0.5 * got["atr"] - 2 * got["ret1"]))))


def test_pipeline_models_round_trip(spark, features, tmp_path):
    """Three fitted pipelines saved, loaded and chained, on all rows."""
    def fitted(names, label, path):
        assembler = VectorAssembler(inputCols=list(names), outputCol="v")
        trees = GBTClassifier(featuresCol="v", labelCol="label", maxIter=2, seed=1)
        data = label.withColumns({n: C.model_input(n) for n in names if n in label.columns})
        Pipeline(stages=[assembler, trees]).fit(data).write().overwrite().save(path)
        return PipelineScorer.load(path, names)

    label = features.withColumn("label", (F.col("index_ret") > 0).cast("int"))
    expansion = fitted(EXPANSION_FEATURES, label, str(tmp_path / "exp"))
    direction = fitted(DIRECTION_FEATURES, label, str(tmp_path / "dir"))
    first = direction(expansion(label, None, "exp_p"), "p_down", "p_up").withColumn(
        "side", F.when(F.col("p_up") > F.col("p_down"), 1).otherwise(-1)
    )
    win = fitted(META_FEATURES, materialize(first, "first"), str(tmp_path / "win"))
    out = score(features, ModelChain(expansion, direction, win))
    got = out.select("exp_p", "p_up", "p_down", "p_win", "side").toPandas()
    assert len(got) == features.count()
    assert got[["exp_p", "p_up", "p_down", "p_win"]].apply(lambda c: c.between(0, 1)).all().all()
    same(got["p_up"] + got["p_down"], np.ones(len(got)))
    assert stacked_row(out).columns == META_FEATURES


def test_pandas_scorer(features):
    scorer = PandasScorer(("atr", "ret1"), lambda x: 1 / (1 + np.exp(-x["atr"] + x["ret1"])))
    got = to_pandas(scorer(features, "down", "up"), "bar_ts")
    same(got["up"], 1 / (1 + np.exp(-got["atr"] + got["ret1"])))
    same(got["down"], 1 - got["up"])


def test_missing_feature_is_an_error(features):
    with pytest.raises(ValueError, match="missing columns"):
        score(features.drop("ret1"), ModelChain(
            LogisticScorer(("ret1",), (1.0,), 0.0), constant(0.5), constant(0.5)))
