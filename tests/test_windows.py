import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from data import same, to_pandas, to_spark, walk
from tapewright.functions.columns import typical_price
from tapewright.operators import windows as W
from tapewright.operators.blocks import ordered
from tapewright.operators.ewm import Ewm, ewm_means

LAYOUTS = {"whole": {}, "split": {"task_rows": 0, "block_rows": 70}}


def bars_with_gaps(n=700):
    a, b = walk(n, 1, "A"), walk(90, 2, "B")
    rng = np.random.default_rng(3)
    for frame in (a, b):
        frame["x"] = frame["close"].where(rng.random(len(frame)) > 0.3)
    a.loc[:5, "x"] = np.nan            # missing at the start
    a.loc[250:560, "x"] = np.nan       # a gap longer than one run of rows
    b["x"] = np.nan                    # a series without any value
    return pd.concat([a, b], ignore_index=True)


DDL = (
    "series string, bar_ts timestamp_ntz, open double, high double, low double,"
    " close double, volume double, x double"
)


def line(spark, frame, layout, **kw):
    return ordered(to_spark(spark, frame, DDL), bar_seconds=300, **LAYOUTS[layout], **kw)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_rolling(spark, layout):
    frame = bars_with_gaps()
    levels = {
        "mean6": lambda s: s.rolling(6).mean(),
        "std12": lambda s: s.rolling(12).std(),
        "max20": lambda s: s.rolling(20).max(),
        "min20": lambda s: s.rolling(20).min(),
        "sum6": lambda s: s.rolling(6).sum(),
        "q50": lambda s: s.rolling(50).quantile(0.7),
        "z48": lambda s: (s - s.rolling(48).mean()) / s.rolling(48).std(),
        "pct3": lambda s: s.pct_change(3, fill_method=None),
        "diff2": lambda s: s.diff(2),
        "prior12": lambda s: s.rolling(12).max().shift(),
        "few5": lambda s: s.rolling(20, min_periods=5).mean(),
    }
    for c in ("close", "x"):
        out = line(spark, frame, layout).derive(
            49,
            lambda w, c=c: {
                "mean6": W.rolling_mean(c, 6, w),
                "std12": W.rolling_std(c, 12, w),
                "max20": W.rolling_max(c, 20, w),
                "min20": W.rolling_min(c, 20, w),
                "sum6": W.rolling_sum(c, 6, w),
                "q50": W.rolling_quantile(c, 50, 0.7, w),
                "z48": W.zscore(c, 48, w),
                "pct3": W.pct_change(c, 3, w),
                "diff2": W.diff(c, 2, w),
                "prior12": W.rolling_max(c, 12, w, skip=1),
                "few5": W.rolling_mean(c, 20, w, min_periods=5),
            },
        )
        got = to_pandas(out.df, "series", "bar_ts")
        for name, fn in levels.items():
            want = frame.groupby("series")[c].transform(fn)
            same(got[name], want)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_atr_and_running_total(spark, layout):
    frame = bars_with_gaps()
    out = line(spark, frame, layout, totals={"total": typical_price()}).derive(
        14,
        lambda w: {"tr": W.true_range("high", "low", "close", w)},
        lambda w: {"atr": W.rolling_mean("tr", 14, w)},
    )
    got = to_pandas(out.df, "series", "bar_ts")
    for name, part in frame.groupby("series"):
        prev = part["close"].shift()
        # the range widened by yesterday's close, where there is one
        wide = np.fmax(part["high"], prev) - np.fmin(part["low"], prev)
        atr = wide.rolling(14).mean()
        mine = got[got["series"] == name]
        same(mine["atr"], atr)
        same(mine["total"], ((part["high"] + part["low"] + part["close"]) / 3).cumsum())
        assert mine["seq"].tolist() == list(range(len(part)))


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("column", ["close", "x"])
def test_ewm(spark, layout, column):
    frame = bars_with_gaps()
    spans = (2, 3, 12, 30)
    means = [Ewm(f"t{n}", column, n, True) for n in spans]
    means += [Ewm(f"f{n}", column, n, False) for n in spans]
    got = to_pandas(ewm_means(line(spark, frame, layout), means).df, "series", "bar_ts")
    for m in means:
        want = frame.groupby("series")[column].transform(
            lambda s, m=m: s.ewm(span=m.span, adjust=m.adjust).mean()
        )
        same(got[m.out], want)


def test_ewm_long_gap(spark):
    """A gap in which every weight fades below the smallest double."""
    frame = walk(2600, 5)
    frame["x"] = frame["close"]
    frame.loc[300:2500, "x"] = np.nan
    means = [Ewm("t", "x", 3, True), Ewm("f", "x", 3, False)]
    got = to_pandas(ewm_means(line(spark, frame, "whole"), means).df, "bar_ts")
    same(got["t"], frame["x"].ewm(span=3).mean())
    same(got["f"], frame["x"].ewm(span=3, adjust=False).mean())


@pytest.mark.parametrize("fan", [2, 4])
def test_ewm_by_levels(spark, monkeypatch, fan):
    """Run summaries folded in several levels; a long gap and a missing series included."""
    from tapewright.operators import ewm

    frames = [walk(2600, k, s) for k, s in enumerate(["A", "B", None])]
    frames[0].loc[300:2500, "close"] = np.nan
    frames[1].loc[::3, "close"] = np.nan
    frames[2].loc[:700, "close"] = np.nan
    means = [Ewm(f"{k}{n}", "close", n, k == "t") for k in "tf" for n in (3, 30)]
    bars = to_spark(spark, pd.concat(frames))
    whole = ewm_means(ordered(bars, bar_seconds=300), means).df
    monkeypatch.setattr(ewm, "FAN", fan)
    o = ordered(bars, bar_seconds=300)
    assert ewm._levels(o.rows) >= 2 and ewm._levels(10**12) >= 4
    got = ewm_means(o, means).df
    names = ["series", "seq", *[m.out for m in means]]
    got, whole = (df.select(*names).toPandas().sort_values(["series", "seq"]) for df in (got, whole))
    want = pd.concat(frames).reset_index(drop=True)
    for m in means:
        same(got[m.out].reset_index(drop=True), whole[m.out].reset_index(drop=True))
        expected = want.groupby("series", dropna=False, sort=False)["close"].transform(
            lambda s, m=m: s.ewm(span=m.span, adjust=m.adjust).mean()
        )
        same(got[m.out].reset_index(drop=True), expected)


def test_known_ewm_over_one_gap(spark):
    frame = walk(4, 6)
    frame["x"] = [1.0, np.nan, 3.0, 4.0]
    out = ewm_means(line(spark, frame, "whole"), [Ewm("y", "x", 3, False)])
    same(to_pandas(out.df, "bar_ts")["y"], [1, 1, 7 / 3, 19 / 6])


def test_span_too_small():
    with pytest.raises(ValueError):
        Ewm("y", "x", 1, False)


def test_breakout_never_fires_with_current_row(spark):
    frame = walk(600, 7)
    frame["x"] = 0.0
    out = line(spark, frame, "whole").derive(
        20,
        lambda w: {
            "inclusive": F.col("close") > W.rolling_max("high", 20, w),
            "exclusive": F.col("close") > W.rolling_max("high", 20, w, skip=1),
        },
    )
    got = out.df.agg(F.count_if("inclusive").alias("a"), F.count_if("exclusive").alias("b")).first()
    assert got["a"] == 0 and got["b"] > 0


def test_reference_levels_of_provisional_bar(spark):
    frame = walk(8, 8)
    frame["x"] = 0.0
    o = line(spark, frame, "whole")
    o = o.with_df(o.df.withColumn("is_final", F.col("seq") < 7))
    out = o.derive(
        3,
        lambda w: dict(
            zip(("hi", "lo"), W.reference_levels("high", "low", w, 2, F.col("is_final")), strict=True)
        ),
    )
    got = to_pandas(out.df, "bar_ts")
    assert got["hi"][6] == frame["high"][4:6].max()
    assert got["hi"][7] == frame["high"][4:6].max()  # the provisional bar is one row further
    assert got["lo"][7] == frame["low"][4:6].min()


def test_layouts_agree_on_missing_keys_and_times(spark):
    frames = [walk(200, seed=k, series=s) for k, s in enumerate(["A", "B", None])]
    for frame in frames:
        frame.loc[57, "bar_ts"] = pd.NaT
    bars = to_spark(spark, pd.concat(frames))
    found = []
    for layout in LAYOUTS.values():
        o = ordered(bars, bar_seconds=300, totals={"total": F.col("volume")}, **layout)
        o = o.derive(20, lambda w: {"mean": W.rolling_mean("close", 20, w)})
        o = ewm_means(o, [Ewm("smooth", "close", 12, True)])
        names = ["series", "bar_ts", "close", "seq", "total", "mean", "smooth"]
        found.append(o.df.select(*names).toPandas().sort_values(["series", "seq"]).reset_index(drop=True))
    whole, split = found
    assert len(whole) == len(split) == 600
    assert whole["series"].isna().sum() == split["series"].isna().sum() == 200
    assert (whole["bar_ts"].isna() == split["bar_ts"].isna()).all()
    for name in ("close", "seq", "total", "mean", "smooth"):
        same(whole[name], split[name])
