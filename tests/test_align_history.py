from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from data import same, to_pandas, to_spark, walk
from tapewright.functions.clock import minutes
from tapewright.operators.align import asof_backward, complete_on_time, left_on_time
from tapewright.operators.bars import build_bars, merge_series
from tapewright.operators.history import (
    keep_first,
    keep_last,
    last_bar,
    newest,
    overlay,
    stack,
    upsert,
    with_min_history,
)
from tapewright.session import materialize


@pytest.mark.parametrize("span", [600, 3600, 10**7])
def test_asof_against_pandas(spark, span):
    rng = np.random.default_rng(1)
    left = pd.DataFrame({"bar_ts": pd.date_range("2024-01-01", periods=300, freq="5min")})
    left["series"] = np.where(rng.random(300) > 0.5, "A", "B")
    right = pd.DataFrame(
        {
            "bar_ts": pd.Timestamp("2024-01-01 02:00")
            + pd.to_timedelta(np.sort(rng.choice(1400, 60, replace=False)), unit="min"),
            "v": rng.normal(size=60),
        }
    )
    right["series"] = np.where(rng.random(60) > 0.3, "A", "B")
    got = asof_backward(
        to_spark(spark, left[["series", "bar_ts"]], "series string, bar_ts timestamp_ntz"),
        to_spark(spark, right[["series", "bar_ts", "v"]], "series string, bar_ts timestamp_ntz, v double"),
        by=["series"], columns=["v"], span_seconds=span,
    )
    want = pd.merge_asof(left, right, on="bar_ts", by="series").sort_values(["series", "bar_ts"])
    same(to_pandas(got, "series", "bar_ts")["v"], want["v"])
    near = asof_backward(
        to_spark(spark, left[["bar_ts"]], "bar_ts timestamp_ntz"),
        to_spark(spark, right[["bar_ts", "v"]], "bar_ts timestamp_ntz, v double"),
        columns=["v"], span_seconds=span, tolerance=minutes(15),
    )
    want = pd.merge_asof(left, right, on="bar_ts", tolerance=pd.Timedelta(minutes=15))
    same(to_pandas(near, "bar_ts")["v"], want["v"])


def test_asof_takes_equal_time(spark):
    t = pd.Timestamp("2024-01-01 10:00")
    left = to_spark(spark, pd.DataFrame({"bar_ts": [t]}), "bar_ts timestamp_ntz")
    right = pd.DataFrame({"bar_ts": [t - pd.Timedelta(minutes=5), t], "v": [1.0, 2.0]})
    got = asof_backward(
        left, to_spark(spark, right, "bar_ts timestamp_ntz, v double"), columns=["v"], span_seconds=60
    ).first()
    assert got["v"] == 2.0 and got["feature_ts"] == t.to_pydatetime()


def test_time_joins(spark):
    bars = to_spark(spark, walk(4, 1))
    times = [r["bar_ts"] for r in bars.orderBy("bar_ts").collect()]
    feats = spark.createDataFrame(
        [(times[0], 1.0, None), (times[2], 2.0, 3.0)], "bar_ts timestamp_ntz, a double, b double"
    )
    assert left_on_time(bars, feats).count() == 4
    done = complete_on_time(bars, feats, ["a", "b"]).collect()
    assert [r["bar_ts"] for r in done] == [times[2]]


def test_keep_first_and_last(spark):
    rows = spark.createDataFrame(
        [("A", 1, 5, 1.0), ("A", 1, 7, None), ("A", 1, 6, 3.0), ("B", 1, 1, 4.0)],
        "series string, k int, seq int, v double",
    ).repartition(3)
    first = {r["series"]: r["v"] for r in keep_first(rows, ["series", "k"], ["seq"]).collect()}
    last = {r["series"]: r["v"] for r in keep_last(rows, ["series", "k"], ["seq"]).collect()}
    assert first == {"A": 1.0, "B": 4.0} and last == {"A": None, "B": 4.0}


def test_newest_and_last(spark):
    frame = pd.concat([walk(500, 1, "A"), walk(30, 2, "B")])
    df = to_spark(spark, frame).repartition(4)
    got = to_pandas(newest(df, 120), "series", "bar_ts")
    want = frame.groupby("series").tail(120).sort_values(["series", "bar_ts"])
    assert got["bar_ts"].tolist() == want["bar_ts"].tolist()
    for back in (0, 1, 3):
        got = to_pandas(last_bar(df, back=back), "series")
        assert got["close"].tolist() == [
            frame[frame["series"] == s]["close"].iloc[-1 - back] for s in "AB"
        ]


def test_upsert_is_idempotent_and_capped(spark):
    frame = walk(50, 3)
    history = to_spark(spark, frame.iloc[:40])
    fresh_frame = frame.iloc[30:].assign(close=-1.0)
    fresh = to_spark(spark, fresh_frame)
    once = upsert(history, fresh, rows=25)
    twice = upsert(once, fresh, rows=25)
    a, b = (to_pandas(x, "bar_ts") for x in (once, twice))
    pd.testing.assert_frame_equal(a, b)
    assert len(a) == 25 and (a["close"] == -1).sum() == 20
    assert overlay(history, fresh).count() == 50
    assert overlay(history, history).count() == 40


def test_overlay_keeps_a_missing_fresh_value(spark):
    """A restated row replaces the old one whole, missing values included."""
    history = to_spark(spark, walk(3, 4))
    fresh = history.limit(1).withColumn("close", F.lit(None).cast("double"))
    assert overlay(history, fresh).where("close IS NULL").count() == 1


def test_stack_and_min_history(spark):
    a, b = to_spark(spark, walk(30, 1, "A")), to_spark(spark, walk(10, 2, "B"))
    both = stack(a, b.drop("volume"))
    assert both.columns == a.columns and both.where("volume IS NULL").count() == 10
    kept = with_min_history(both, 20)
    assert {r["series"] for r in kept.select("series").distinct().collect()} == {"A"}


def test_missing_keys_and_times_stay_in_the_history(spark):
    frames = [walk(40, seed=k, series=s) for k, s in enumerate(["A", None])]
    frames[0].loc[3, "bar_ts"] = pd.NaT
    bars = to_spark(spark, pd.concat(frames))
    assert newest(bars, 100).count() == with_min_history(bars, 40).count() == 80
    assert newest(bars, 5).where("series is null").count() == 5
    assert newest(bars, 5).where("bar_ts is null").count() == 0  # a missing time is the oldest


@pytest.mark.parametrize("files", [1, 3, 7])
def test_equal_times_don_t_depend_on_the_layout(spark, files):
    at = [datetime(2024, 1, 1, 9, m // 4, 0, 250_000 * (m % 2)) for m in range(40)]
    rows = [(int(i), t, "AB"[i % 2], float(i * 7 % 11)) for i, t in zip(np.random.default_rng(1).permutation(40), at, strict=True)]
    ddl = "event_id long, ts timestamp_ntz, event_type string, value double"
    df = spark.createDataFrame([*rows, (99, None, "A", 1.0)], ddl).repartition(files)
    bars = build_bars(df, "5 minutes", sequence="event_id")
    for series, got in (("A", bars), ("B", bars), (None, merge_series(bars, "ALL"))):
        for r in got.where(F.col("series") == (series or "ALL")).collect():
            mine = sorted((t, i, v) for i, t, s, v in rows if series in (None, s) and timedelta(0) <= t - r["bar_ts"] < timedelta(minutes=5))
            assert (r["open"], r["close"], r["volume"]) == (mine[0][2], mine[-1][2], len(mine))
    times = spark.createDataFrame([(datetime(2024, 1, 1, 9, m),) for m in range(0, 15)], "bar_ts timestamp_ntz")
    right = df.where(F.col("ts").isNotNull()).select(F.col("ts").alias("bar_ts"), "event_id", "value")
    for span in (60, 240):
        out = asof_backward(
            materialize(times, "l"), materialize(right, "r"), columns=["value"], span_seconds=span, sequence="event_id"
        )
        for r in out.collect():
            earlier = [(t, i, v) for i, t, _, v in rows if t <= r["bar_ts"]]
            assert r["value"] == (max(earlier)[2] if earlier else None)


def test_sequenced_bars_are_hash_aggregates(spark):
    df = spark.createDataFrame([], "event_id long, ts timestamp_ntz, event_type string, value double")
    text = build_bars(df, "1 hour", sequence="event_id")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in text and "SortAggregate" not in text and "ObjectHash" not in text
