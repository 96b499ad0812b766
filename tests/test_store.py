"""The versioned store of bars and signals, open bars and repeated ticks."""

import glob
import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from data import to_pandas, to_spark, walk
from test_sources_streaming import ticks
from tapewright.operators.bars import build_bars
from tapewright.schemas import TICK
from tapewright.session import materialize, new_path, scratch
from tapewright.sources import commits as commits_module
from tapewright.sources.commits import NO_DAY, Commits
from tapewright.streaming.live import (
    GONE,
    STORED_BAR,
    backfill_store,
    merge_store,
    read_open_bars,
    read_store,
    read_tail,
    read_ticks,
    run_epoch,
    start_open_bars,
    store_batch,
)

DDL = TICK.simpleString()[7:-1].replace(":", " ")


@pytest.fixture(scope="module")
def bars(spark):
    rows = to_spark(spark, walk(120, 1, minutes=60)).select(
        "*", F.col("bar_ts").alias("open_ts"), F.col("bar_ts").alias("close_ts"), F.lit(True).alias("is_final")
    )
    return materialize(rows.select(*STORED_BAR.names), "bars")


def day(n):
    return F.to_date("bar_ts") == F.date_add(F.lit(date(2024, 1, 1)), n)


def closes(spark, path, **kw):
    return {r["bar_ts"]: r["close"] for r in read_store(spark, path, STORED_BAR, **kw).collect()}


def test_later_commits_count_and_replays_keep_their_place(spark, bars):
    path = new_path(spark, "store")
    store_batch(bars, 0, path, epoch="a")
    first = min(closes(spark, path))
    store_batch(bars.where(F.col("bar_ts") == first).withColumn("close", F.lit(-1.0)), 0, path, epoch="b")
    store_batch(bars, 0, path, epoch="a")  # again: still the one before "b"
    assert closes(spark, path)[first] == -1.0
    backfill_store(bars.withColumn("close", F.lit(-2.0)), path, name="session")
    assert set(closes(spark, path).values()) == {-2.0}
    store_batch(bars.withColumn("close", F.lit(-3.0)).limit(1), 1, path, epoch="a")
    assert sorted(set(closes(spark, path).values())) == [-3.0, -2.0]


def test_a_replay_with_fewer_days_leaves_none_behind(spark, bars):
    path = new_path(spark, "store")
    days = bars.select(F.to_date("bar_ts").alias("d")).distinct().orderBy("d").collect()
    store_batch(bars, 3, path, epoch="a")
    store_batch(bars.where(F.to_date("bar_ts") == days[0]["d"]), 3, path, epoch="a")
    assert {t.date() for t in closes(spark, path)} == {days[0]["d"]}
    assert Commits(spark, path).dates() == [days[0]["d"]]
    assert not glob.glob(f"{path.removeprefix('file:')}/batch_id=3/commit=*-0000")  # the old files are gone
    store_batch(bars.limit(0), 3, path, epoch="a")
    assert closes(spark, path) == {}


def test_what_no_manifest_names_is_not_read(spark, bars):
    path = new_path(spark, "store")
    store_batch(bars.limit(5), 0, path)
    bars.withColumn("trade_date", F.to_date("bar_ts")).write.partitionBy("trade_date").parquet(
        f"{path}/batch_id=1/commit=000000000001-0000"  # a batch that died before its manifest
    )
    assert len(closes(spark, path)) == 5
    store_batch(bars.limit(2), 1, path)  # and runs again
    assert read_store(spark, path, STORED_BAR).count() == 5
    assert read_store(spark, new_path(spark, "nothing"), STORED_BAR).count() == 0


def test_withdrawn_keys(spark):
    path = new_path(spark, "store")
    ddl = "bar_ts timestamp_ntz, side int"
    schema = spark.createDataFrame([], ddl).schema
    at = [datetime(2024, 1, 1, h) for h in range(3)]
    store_batch(spark.createDataFrame([(t, 1) for t in at], ddl), 0, path)
    gone = spark.createDataFrame([(at[1], None, True)], f"{ddl}, {GONE.name} boolean")
    store_batch(gone, 1, path)
    assert {r["bar_ts"] for r in read_store(spark, path, schema, ["bar_ts"]).collect()} == {at[0], at[2]}
    store_batch(spark.createDataFrame([(at[1], -1)], ddl), 2, path)  # given again later
    assert {r["bar_ts"]: r["side"] for r in read_store(spark, path, schema, ["bar_ts"]).collect()} == {
        at[0]: 1, at[1]: -1, at[2]: 1
    }


def test_many_manifests_become_one(spark, bars, monkeypatch):
    monkeypatch.setattr(commits_module, "SNAPSHOT_EVERY", 3)
    path = new_path(spark, "store")
    times = [r["bar_ts"] for r in bars.select("bar_ts").orderBy("bar_ts").limit(9).collect()]
    for k, t in enumerate(times):
        store_batch(bars.where(F.col("bar_ts") == t), k, path)
    names = os.listdir(f"{path.removeprefix('file:')}/_commits")
    assert sum(n.startswith("snapshot-") and n.endswith("json") for n in names) == 1
    assert sorted(closes(spark, path)) == times and [c.batch for c in Commits(spark, path).all] == list(range(9))
    store_batch(bars.where(F.col("bar_ts") == times[0]).withColumn("close", F.lit(9.0)), 0, path)  # one in the snapshot
    assert closes(spark, path)[times[0]] == 9.0 and Commits(spark, path).all[0].attempt == 1


def test_merge_rewrites_touched_days_only(spark, bars):
    path = new_path(spark, "store")
    store_batch(bars, 0, path)
    store_batch(bars.limit(7).withColumn("close", F.lit(1.0)), 1, path)
    days = Commits(spark, path).dates()
    before = Commits(spark, path).by_day()
    fresh = bars.where(F.to_date("bar_ts") == days[1]).limit(3).withColumn("close", F.lit(5.0))
    want = {**closes(spark, path), **{r["bar_ts"]: 5.0 for r in fresh.collect()}}
    merge_store(spark, path, STORED_BAR, fresh, epoch="m")
    after = Commits(spark, path).by_day()
    assert closes(spark, path) == want
    changed = [d for d in after if after[d] != before[d]]
    assert changed == [days[1].isoformat()] and len(after[changed[0]]) == 1
    merge_store(spark, path, STORED_BAR, fresh, epoch="m")
    assert closes(spark, path) == want


def test_tail_reads_only_the_days_it_needs(spark, bars):
    path = new_path(spark, "store")
    store_batch(bars, 0, path)
    days = Commits(spark, path).dates()
    assert Commits(spark, path).days_back(days[-1].isoformat(), 1) == [days[-1].isoformat()]
    tail = read_tail(spark, path, 1, until=days[-1])
    assert {f.split("trade_date=")[1][:10] for f in tail.inputFiles()} == {days[-1].isoformat()}
    since = datetime.combine(days[2], datetime.min.time()).replace(hour=12)
    got = {r["bar_ts"] for r in read_tail(spark, path, 15, until=days[-1], since=since).collect()}
    times = sorted(closes(spark, path))
    before = [t for t in times if t < since]
    assert {t for t in times if t >= before[-15]} <= got


def test_rows_without_a_time_are_kept(spark, bars):
    path = new_path(spark, "store")
    store_batch(bars.limit(1).withColumn("bar_ts", F.lit(None).cast("timestamp_ntz")), 0, path)
    assert NO_DAY in Commits(spark, path).by_day() and list(closes(spark, path)) == [None]


def test_scratch_tables_are_deleted(spark, bars):
    with scratch(spark):
        table = materialize(bars, "inside")
        files = [f.removeprefix("file://") for f in table.inputFiles()]
        assert all(map(os.path.exists, files))
    assert not any(map(os.path.exists, files))
    assert materialize(bars, "outside").count() == 120


def test_ticks_delivered_again_in_a_later_batch_count_once(spark):
    frame = ticks(900, 4)
    files, path = new_path(spark, "ticks"), new_path(spark, "open")
    for start in range(0, 900, 300):
        rows = frame.iloc[max(0, start - 120) : start + 300]  # 120 ticks of the file before again
        to_spark(spark, rows, DDL).coalesce(1).write.mode("append").parquet(files)
    query = start_open_bars(
        read_ticks(spark, files, files_per_batch=1), "1 hour", "1 day", f"{path}/bars", f"{path}/state",
        tick_key=["event_id"], trigger={"availableNow": True},
    )
    query.awaitTermination()
    assert query.exception() is None
    assert len(Commits(spark, f"{path}/bars").all) >= 3
    assert {c.epoch for c in Commits(spark, f"{path}/bars").all} == {run_epoch(spark, f"{path}/state")}
    got = to_pandas(read_open_bars(spark, f"{path}/bars"), "series", "bar_ts")
    want = to_pandas(build_bars(to_spark(spark, frame, DDL), "1 hour"), "series", "bar_ts")
    for c in ("series", "bar_ts", "open", "high", "low", "close", "volume", "open_ts", "close_ts"):
        assert got[c].tolist() == want[c].tolist(), c
