from datetime import datetime, timedelta
from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from data import same, to_pandas, to_spark, walk
from tapewright import catalog
from tapewright.operators.bars import build_bars, merge_series
from tapewright.operators.instruments import resolve_tokens, with_series
from tapewright.operators.quality import coverage_summary, missing_profile
from tapewright.plans.backfill import backfill, session_rows
from tapewright.schemas import (
    BAR,
    INSTRUMENT,
    SIGNAL,
    TICK,
    XSECTION_COLUMNS,
    SessionSpec,
    history_schema,
    require_columns,
)
from tapewright.session import materialize, new_path, work_dir
from tapewright.sources.tables import (
    append_log,
    read_bars,
    read_instruments,
    read_seed_history,
    write_bars,
    write_seed_history,
)
from tapewright.streaming.live import (
    BACKFILL_BATCH,
    STORED_BAR,
    SignalJob,
    live_bars,
    read_store,
    read_tail,
    read_ticks,
    start_bar_store,
    store_batch,
)

T0 = pd.Timestamp("2024-01-01")


def ticks(n=4000, seed=0, minutes=60 * 24 * 6) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    at = T0 + pd.to_timedelta(np.sort(rng.choice(minutes * 60, n, replace=False)), unit="s")
    return pd.DataFrame(
        {
            "event_id": np.arange(n),
            "ts": at,
            "user_id": 1,
            "event_type": rng.choice(catalog.MEMBERS, n),
            "value": np.round(rng.exponential(50, n), 2) + 0.01,
            "props": "",
        }
    )


def test_work_dir_comes_from_the_session(spark):
    assert work_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_path(spark, "x") != new_path(spark, "x")


def test_bars_from_ticks(spark):
    frame = ticks(500)
    frame.loc[3, "value"] = np.nan
    df = to_spark(spark, frame, TICK.simpleString()[7:-1].replace(":", " "))
    got = to_pandas(build_bars(df, "1 hour"), "series", "bar_ts")
    good = frame.dropna(subset=["value"])
    by = good.groupby(["event_type", good["ts"].dt.floor("h")])["value"]
    want = by.agg(["first", "max", "min", "last", "count"]).reset_index(drop=True)
    for mine, theirs in zip(("open", "high", "low", "close", "volume"), want.columns, strict=True):
        same(got[mine], want[theirs])
    index = to_pandas(merge_series(build_bars(df, "1 hour"), "ALL"), "bar_ts")
    by = good.groupby(good["ts"].dt.floor("h"))["value"]
    same(index["open"], by.first())
    same(index["close"], by.last())
    weighted = build_bars(df.withColumn("q", F.lit(2)), "1 hour", volume="q")
    assert weighted.agg(F.sum("volume")).first()[0] == 2 * len(good)


def test_bar_table_round_trip_prunes_days(spark):
    path = new_path(spark, "bars")
    frame = walk(2000, 1)
    write_bars(to_spark(spark, frame), path)
    start, end = datetime(2024, 1, 3, 10), datetime(2024, 1, 5, 12)
    got = read_bars(spark, path, series=["A", "Z"], start=start, end=end)
    want = frame[frame["bar_ts"].between(start, end)]
    assert to_pandas(got, "bar_ts")["bar_ts"].tolist() == want["bar_ts"].tolist()
    assert got.schema.names == BAR.names
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(trade_date" in plan
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(bar_ts" in plan


def test_seed_history_csv(spark):
    path = new_path(spark, "seed")
    n = 20
    rows = pd.DataFrame({"bar_ts": pd.date_range("2024-01-01", periods=n, freq="5min")})
    for i, c in enumerate(history_schema().names[1:]):
        rows[c] = np.arange(n) + i / 10
    rows.loc[2, "vwap_pca1"] = np.nan
    df = to_spark(spark, rows, history_schema().simpleString()[7:-1].replace(":", " "))
    write_seed_history(df, path)
    got = to_pandas(read_seed_history(spark, path), "bar_ts")
    pd.testing.assert_frame_equal(got, rows, check_dtype=False)


def test_log_appends(spark):
    path = new_path(spark, "log")
    rows = spark.createDataFrame(
        [(datetime(2024, 1, 2, 9, 20), datetime(2024, 1, 2, 9, 20), 1, 1.0, 0.5, 2.0, 0.6, 0.7)],
        SIGNAL,
    )
    append_log(rows, path, "live")
    append_log(rows, path, "test")
    back = spark.read.parquet(path)
    assert back.columns[:2] == ["timestamp", "system"] and back.count() == 2


def test_log_without_signals(spark, monkeypatch):
    monkeypatch.setattr(catalog, "trade_signals", lambda spark, sf_dir: spark.createDataFrame([], SIGNAL))
    got = catalog.signal_log(spark, "")
    assert got.columns == ["timestamp", "system", "side", "entry", "stop", "target", "exp_p", "p_win"]
    assert dict(got.dtypes)["timestamp"] == "timestamp_ntz" and got.count() == 0


def test_instruments(spark):
    rows = [
        (1, "TCS", "NSE", "EQ", "NSE"), (2, "TCS", "BSE", "EQ", "BSE"), (3, "ITC", "NSE", "FUT", "NFO"),
        (4, "NIFTY 50", "NSE", "EQ", "INDICES"), (5, "NIFTY 50", "NSE", "EQ", None),
        (6, "INFY", "NSE", "EQ", "NSE"),
    ]
    path = new_path(spark, "instruments")
    spark.createDataFrame(rows, INSTRUMENT).write.parquet(path)
    tokens = resolve_tokens(read_instruments(spark, path))
    got = {r["series"]: r["instrument_token"] for r in tokens.collect()}
    assert got == {"TCS": 1, "INFY": 6, "NIFTY50": 4}
    candles = spark.createDataFrame([(1, 10.0), (2, 11.0)], "instrument_token long, close double")
    assert [r["series"] for r in with_series(candles, tokens).collect()] == ["TCS"]


def test_profiles(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 1, 1, h), float(h) if h % 2 else None, None) for h in range(24)],
        "bar_ts timestamp_ntz, a double, b double",
    )
    got = {r["column"]: r for r in missing_profile(df, ["a", "b"], "bar_ts").collect()}
    assert got["a"]["missing"] == 12 and got["a"]["present_recent"] == 5
    assert got["a"]["missing_in_last"] == 0 and got["b"]["all_missing"] == 1
    bars = to_spark(spark, pd.concat([walk(10, 1, "A"), walk(30, 2, "B")]))
    summary = coverage_summary(bars).first()
    assert summary["symbols"] == 2 and summary["median_bars"] == 20.0


def test_required_columns():
    require_columns(["a", "b"], ["a"])
    with pytest.raises(ValueError, match="c"):
        require_columns(["a", "b"], ["a", "c"])


def test_backfill_session_only(spark):
    frame = ticks(6000, 2)
    df = to_spark(spark, frame, TICK.simpleString()[7:-1].replace(":", " "))
    bars = materialize(build_bars(df, "30 minutes"), "bars")
    spec = SessionSpec(bar_minutes=30)
    rows = session_rows(
        merge_series(bars, "ALL"), bars, spec, universe=catalog.MEMBERS,
        loadings=catalog.example_loadings(spark),
    )
    rows = materialize(rows, "session")
    got = rows.toPandas()
    assert len(got) and (got["bar_ts"].dt.time >= datetime(2024, 1, 1, 9, 15).time()).all()
    assert got[XSECTION_COLUMNS].notna().all().all()
    once = backfill(rows, rows, rows=50)
    assert to_pandas(once, "bar_ts").equals(to_pandas(backfill(once, rows, rows=50), "bar_ts"))


# ---------------------------------------------------------------- streams


@pytest.fixture(scope="module")
def tick_files(spark):
    """Ticks in six files by time, each with some ticks of the file before (repeated) and a few
    that come late but within the delay."""
    frame = ticks()
    path = new_path(spark, "ticks")
    ddl = TICK.simpleString()[7:-1].replace(":", " ")
    parts = np.array_split(np.arange(len(frame)), 6)
    late = {i: parts[i][-15:] for i in range(5)}
    for i, part in enumerate(parts):
        own = part[:-15] if i in late else part
        rows = list(own) + (list(late[i - 1]) + list(parts[i - 1][:5]) if i else [])
        to_spark(spark, frame.iloc[rows], ddl).coalesce(1).write.mode("append").parquet(path)
    return path, to_spark(spark, frame, ddl)


def run_stream(spark, files, on_batch=None, final=True):
    path = new_path(spark, "stream")
    bars = live_bars(
        read_ticks(spark, files, files_per_batch=1), "1 hour", "1 hour", final=final,
        tick_key=["event_id"] if final else (),
    )
    handler = on_batch(path) if on_batch else None
    query = start_bar_store(
        bars, f"{path}/bars", f"{path}/state", mode="append" if final else "update",
        on_batch=handler, trigger={"availableNow": True},
    )
    query.awaitTermination()
    assert query.exception() is None
    return path


def signal_job(spark, path):
    return SignalJob(f"{path}/bars", f"{path}/signals", SIGNAL, catalog.example_plan(spark))


def test_stream_equals_batch(spark, tick_files):
    files, frame = tick_files
    path = run_stream(spark, files, partial(signal_job, spark))
    stored = spark.read.parquet(f"{path}/bars")
    assert stored.select("batch_id").distinct().count() > 3
    closed = F.lit(frame.agg(F.max("ts")).first()[0] - timedelta(hours=2))
    want = to_pandas(build_bars(frame, "1 hour").where(F.col("bar_ts") <= closed), "series", "bar_ts")
    got = to_pandas(read_store(spark, f"{path}/bars", STORED_BAR), "series", "bar_ts")
    assert got["is_final"].all()
    for c in ("bar_ts", "series", "open", "high", "low", "close", "volume"):
        assert got[c].tolist() == want[c].tolist(), c

    batch = build_bars(frame, "1 hour").withColumn("is_final", F.lit(True))
    times = batch.where(F.col("bar_ts") <= closed).select("bar_ts").distinct()
    want = to_pandas(catalog.example_plan(spark)(batch, times), "bar_ts")
    live = signal_job(spark, path).read(spark)
    got = to_pandas(live, "bar_ts")
    assert got["bar_ts"].tolist() == want["bar_ts"].tolist() and len(got) > 0
    for c in ("side", "entry", "stop", "target", "exp_p", "p_win"):
        same(got[c], want[c])
    assert got["feature_ts"].tolist() == want["feature_ts"].tolist()


def test_replayed_batch_and_restatement(spark):
    path = new_path(spark, "store")
    bars = to_spark(spark, walk(20, 1)).select(
        "*", F.col("bar_ts").alias("open_ts"), F.col("bar_ts").alias("close_ts"),
        F.lit(True).alias("is_final"),
    )
    store_batch(bars, BACKFILL_BATCH, path)
    store_batch(bars.withColumn("close", F.lit(7.0)).limit(3), 0, path)
    store_batch(bars.withColumn("close", F.lit(7.0)).limit(3), 0, path)   # replay
    got = read_store(spark, path, STORED_BAR).toPandas()
    assert len(got) == 20 and (got["close"] == 7.0).sum() == 3
    assert spark.read.parquet(path).count() == 23


def test_tail_falls_back_to_whole_store(spark):
    path = new_path(spark, "store")
    frame = walk(900, 2, minutes=60)
    bars = to_spark(spark, frame).select(
        "*", F.col("bar_ts").alias("open_ts"), F.col("bar_ts").alias("close_ts"),
        F.lit(True).alias("is_final"),
    )
    store_batch(bars, 0, path)
    until = frame["bar_ts"].max().date()
    for wanted in (5, 100, 5000):
        got = read_tail(spark, path, wanted, until=until, span_days=3)
        edge = frame["bar_ts"].nlargest(min(wanted, 900)).min().floor("D")
        assert got.count() == (frame["bar_ts"] >= edge).sum()


def test_provisional_bars_follow_the_ticks(spark, tick_files):
    files, frame = tick_files
    path = run_stream(spark, files, final=False)
    seen = read_store(spark, f"{path}/bars", STORED_BAR)
    assert not seen.where("is_final").count()
    assert seen.count() == build_bars(frame, "1 hour").count()




def test_restart_continues_where_it_stopped(spark):
    """Half of the files, a stop, the rest: the store equals that of one run."""
    frame = ticks(1500, 5)
    ddl = TICK.simpleString()[7:-1].replace(":", " ")
    files, path = new_path(spark, "ticks"), new_path(spark, "stream")
    for part in (frame.iloc[:700], frame.iloc[700:]):
        to_spark(spark, part, ddl).coalesce(1).write.mode("append").parquet(files)
        bars = live_bars(
            read_ticks(spark, files), "1 hour", "1 hour", final=True, tick_key=["event_id"]
        )
        query = start_bar_store(
            bars, f"{path}/bars", f"{path}/state", trigger={"availableNow": True}
        )
        query.awaitTermination()
        assert query.exception() is None
    closed = F.lit(frame["ts"].max().to_pydatetime() - timedelta(hours=2))
    batch = build_bars(to_spark(spark, frame, ddl), "1 hour").where(F.col("bar_ts") <= closed)
    want = to_pandas(batch, "series", "bar_ts")
    got = to_pandas(read_store(spark, f"{path}/bars", STORED_BAR), "series", "bar_ts")
    for c in ("series", "bar_ts", "open", "close", "volume"):
        assert got[c].tolist() == want[c].tolist()
    assert spark.read.parquet(f"{path}/bars").count() == len(want)  # each bar stored once
