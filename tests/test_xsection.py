import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from data import same, to_pandas, to_spark, walk
from tapewright.operators.spread import tail_spread, tail_spread_by_rank
from tapewright.operators.xsection import (
    LOADINGS,
    cross_section,
    fit_cross_section_pca,
    pivot_symbols,
    project,
    symbol_columns,
)

NAMES = ["A", "B", "C", "D", "E", "F", "G"]


def bars(spark, n=60, names=NAMES):
    frames = [walk(n, i + 10, s).assign(bar_ts=pd.date_range("2024-01-01 09:15", periods=n, freq="5min"))
              for i, s in enumerate(names)]
    frame = pd.concat(frames, ignore_index=True)
    rng = np.random.default_rng(0)
    return frame[rng.random(len(frame)) > 0.15].reset_index(drop=True)


def spread(x: pd.Series) -> float:
    """Means of both ends of the sorted values; the ends are found by search."""
    v = np.sort(x.dropna().to_numpy())
    if not len(v):
        return np.nan
    low, high = np.quantile(v, [0.2, 0.8])
    return v[np.searchsorted(v, high):].mean() - v[: np.searchsorted(v, low, "right")].mean()


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(4)
    rows = []
    for g, n in enumerate([1, 2, 3, 4, 5, 6, 9, 26, 400, 3000]):
        values = np.round(rng.normal(size=n), 1 if g % 2 else 6)   # many ties in odd groups
        rows += [(f"g{g}", float(v)) for v in values]
    rows += [("none", np.nan), ("g3", np.nan)]
    return pd.DataFrame(rows, columns=["g", "v"])


@pytest.mark.parametrize("pieces", [8, 256])
def test_tail_spread_forms(spark, groups, pieces):
    df = to_spark(spark, groups, "g string, v double").repartition(5)
    want = groups.groupby("g")["v"].apply(spread)
    bounded = tail_spread(df.groupBy("g").agg(F.collect_list("v").alias("vs")), {"vs": "s"})
    ranked = tail_spread_by_rank(df, ["g"], "v", "s", pieces=pieces, group_rows=10)
    got = bounded.toPandas().set_index("g")["s"]
    same(got[want.index], want)
    got = ranked.toPandas().set_index("g")["s"]
    assert set(got.index) == set(want.index)
    same(got[got.index], want[got.index])


def test_symbol_columns_reset_daily(spark):
    frame = walk(80, 3).assign(bar_ts=pd.date_range("2024-01-01 20:00", periods=80, freq="5min"))
    got = to_pandas(symbol_columns(to_spark(spark, frame)), "bar_ts")
    day = frame["bar_ts"].dt.date
    adv = frame.groupby(day)["volume"].transform(lambda v: v.rolling(20, min_periods=5).mean())
    same(got["adv"], adv.replace(0, np.nan))
    same(got["ret"], frame.groupby(day)["close"].pct_change())
    same(got["norm_vol"], frame["volume"] / adv.replace(0, np.nan))


def test_cross_section_against_pandas(spark):
    frame = bars(spark)
    loadings = spark.createDataFrame(
        [(s, 0.01 * i, 0.3 - 0.1 * i) for i, s in enumerate(NAMES)], LOADINGS
    )
    symbols = symbol_columns(to_spark(spark, frame))
    got = to_pandas(cross_section(symbols, universe=NAMES, loadings=loadings), "bar_ts")
    whole = to_pandas(cross_section(symbols, loadings=loadings), "bar_ts")
    for c in got.columns[1:]:
        same(whole[c], got[c])

    s = to_pandas(symbols, "bar_ts", "series")
    by = s.groupby("bar_ts")
    same(got["eq_norm_volume"], by["norm_vol"].mean())
    at = s["bar_ts"]
    same(got["liquidity_breadth"], s["norm_vol"].gt(0.6).groupby(at).mean())
    up, down = (
        s["volume"].where(moved).groupby(at).sum(min_count=1) for moved in (s["ret"] > 0, s["ret"] < 0)
    )
    same(got["adv_dec_volume_ratio"], up / down.mask(down == 0))
    same(got["vwap_disp"], by["vwap_pressure"].std())
    same(got["pct_vwap_up"], s["vwap_pressure"].gt(0).groupby(at).mean())
    same(got["vwap_tb_spread"], by["vwap_pressure"].apply(spread))
    same(got["ret_tb_spread"], by["ret"].apply(spread))
    agrees = s["vwap_pressure"] * by["vwap_pressure"].transform("mean") > 0
    same(got["pct_flow_align"], agrees.groupby(at).mean())
    wide = s.pivot(index="bar_ts", columns="series", values="vwap_pressure").fillna(0)
    means = np.array([0.01 * i for i in range(7)])
    weights = np.array([0.3 - 0.1 * i for i in range(7)])
    same(got["vwap_pca1"], (wide.to_numpy() - means) @ weights)


def test_edges_of_one_bar(spark):
    """One member; only advancers; decliners without volume."""
    t = [pd.Timestamp("2024-01-01 10:00"), pd.Timestamp("2024-01-01 10:05")]
    rows = [
        ("A", t[0], 9.0, 10.0, 9.0, 10.0, 5.0), ("A", t[1], 9.0, 11.0, 9.0, 11.0, 5.0),
        ("B", t[0], 9.0, 10.0, 9.0, 10.0, 5.0), ("B", t[1], 9.0, 12.0, 9.0, 12.0, 5.0),
    ]
    frame = pd.DataFrame(rows, columns="series bar_ts open high low close volume".split())
    up = to_pandas(cross_section(symbol_columns(to_spark(spark, frame)), universe=NAMES), "bar_ts")
    assert up["adv_dec_volume_ratio"].isna().all()
    assert (up["pct_flow_align"] == 1.0).all() and (up["liquidity_breadth"] == 0.0).all()
    one = to_spark(spark, frame[frame["series"] == "A"])
    got = to_pandas(cross_section(symbol_columns(one), universe=NAMES), "bar_ts")
    assert got["vwap_disp"].isna().all() and (got["vwap_tb_spread"] == 0).all()
    frame.loc[3, ["close", "volume"]] = [9.5, 0.0]
    still = to_pandas(cross_section(symbol_columns(to_spark(spark, frame)), universe=NAMES), "bar_ts")
    assert np.isnan(still["adv_dec_volume_ratio"][1])


def test_pivot_rejects_repeated_cell(spark):
    frame = walk(3, 1)
    twice = to_spark(spark, pd.concat([frame, frame]))
    with pytest.raises(Exception, match="repeated"):
        pivot_symbols(twice, ["A"], "close").collect()


def test_pca_against_dense_solver(spark):
    symbols = symbol_columns(to_spark(spark, bars(spark))).cache()
    loadings = fit_cross_section_pca(symbols, NAMES).toPandas().set_index("series").loc[NAMES]
    s = symbols.toPandas()
    wide = s.pivot(index="bar_ts", columns="series", values="vwap_pressure")[NAMES].fillna(0)
    x = wide.to_numpy() - wide.to_numpy().mean(axis=0)
    axis = np.linalg.svd(x, full_matrices=False)[2][0]
    axis = axis * np.sign(axis[np.abs(axis).argmax()])
    same(loadings["weight"], axis, 1e-8)
    same(loadings["mean"], wide.mean(), 1e-12)
    fitted = spark.createDataFrame(loadings.reset_index()[["series", "mean", "weight"]], LOADINGS)
    same(to_pandas(project(symbols, fitted), "bar_ts")["vwap_pca1"], x @ axis, 1e-9)


def test_spread_of_a_missing_group(spark):
    rng = np.random.default_rng(5)
    rows = [(None if i % 2 else "g", float(v)) for i, v in enumerate(rng.normal(0, 1, 120))]
    df = spark.createDataFrame(rows, "g string, v double")
    arrays = tail_spread(df.groupBy("g").agg(F.collect_list("v").alias("a")), {"a": "s"})
    want = {r.g: r.s for r in arrays.collect()}
    for group_rows in (10, 1000):
        got = {r.g: r.s for r in tail_spread_by_rank(df, ["g"], "v", "s", pieces=4, group_rows=group_rows).collect()}
        assert got.keys() == want.keys() == {None, "g"}
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_spread_narrows_ranges_of_one_hot_group(spark, monkeypatch):
    """A skewed group of 30,000 distinct values and ties, ranked 50 values at a time at most."""
    from tapewright.operators import spread as module

    rng = np.random.default_rng(11)
    hot = np.exp(rng.normal(0, 6, 30_000))
    ties = np.repeat(hot[:40], 25)
    small = rng.normal(0, 1, 30)
    frame = pd.DataFrame(
        {"g": ["hot"] * (len(hot) + len(ties)) + ["small"] * 30 + ["none"] * 3,
         "v": [*hot, *ties, *small, *[None] * 3]}
    )
    df = spark.createDataFrame(frame, "g string, v double").withColumn("v", F.nanvl("v", F.lit(None)))
    levels, ranked = [], []
    narrow, within = module._narrow, module._within

    def narrow_seen(counted, ranges, *rest):
        levels.append(ranges.count())
        return narrow(counted, ranges, *rest)

    def within_seen(counted, ranges, group):
        found = within(counted, ranges, group)
        if "_distinct" in ranges.columns:
            ranked.append(found.groupBy(*group, "_below").count().agg(F.max("count")).first()[0])
        return found

    monkeypatch.setattr(module, "_narrow", narrow_seen)
    monkeypatch.setattr(module, "_within", within_seen)
    got = {r.g: r.s for r in tail_spread_by_rank(df, ["g"], "v", "s", pieces=16, group_rows=50).collect()}
    want = frame.dropna().groupby("g")["v"].apply(spread)
    assert got.keys() == {"hot", "small", "none"} and got["none"] is None
    for g, w in want.items():
        assert abs(got[g] - w) < 1e-9 * abs(w)
    assert 2 <= len(levels) <= 5 and max(levels) <= 4 and ranked[-1] <= 50
