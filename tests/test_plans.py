"""Shapes of physical plans that matter at scale."""

import re
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from data import to_spark, walk
from tapewright import catalog
from tapewright.operators.bars import build_bars, merge_series
from tapewright.operators.blocks import ordered
from tapewright.operators.ewm import Ewm, ewm_means
from tapewright.operators.history import keep_last, newest, with_min_history
from tapewright.operators.windows import lag, rolling_mean
from tapewright.session import materialize, new_path
from tapewright.sources.tables import read_newest, write_bars

SF_DIR = "/root/testdata/sf0.01"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bars_read_three_columns_and_combine_before_the_shuffle(spark):
    text = plan(build_bars(catalog.events(spark, SF_DIR), "1 hour"))
    read = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {"ts", "event_type", "value"}
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_min_by" in text


def test_index_bars_scan_ticks_once(spark):
    bars = build_bars(catalog.events(spark, SF_DIR), "1 hour")
    text = plan(merge_series(bars, "ALL"))
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 2


def test_filters_reach_the_scan(spark, capsys):
    catalog.scan_range(spark, SF_DIR).explain("formatted")
    pushed = re.search(r"PushedFilters: (.*)", capsys.readouterr().out).group(1)
    assert "GreaterThanOrEqual(ts" in pushed and "In(event_type" in pushed


def test_series_windows_share_one_shuffle(spark):
    bars = materialize(to_spark(spark, walk(300, 1)), "bars")
    line = ordered(bars, bar_seconds=300)
    out = line.derive(
        20,
        lambda w: {"a": lag("close", 1, w), "b": rolling_mean("close", 6, w)},
        lambda w: {"c": rolling_mean("b", 6, w)},
    )
    text = plan(out.df)
    assert text.count("Exchange hashpartitioning") == 1


def test_split_layout_spreads_one_series(spark):
    """A table that is one single series is worked on in blocks of equal size."""
    bars = materialize(to_spark(spark, walk(3000, 2)), "bars")
    line = ordered(bars, bar_seconds=300, task_rows=0, block_rows=200)
    sizes = []

    def count_block(w):
        return {"n": F.count(F.lit(1)).over(w.rowsBetween(-10**6, 10**6))}

    out = line.derive(64, count_block).df
    sizes = [r["n"] for r in out.select("n").distinct().collect()]
    assert out.count() == 3000 and max(sizes) <= 200 + 64
    assert "hashpartitioning(series#" in plan(out) and "_block" in plan(out)


def test_dedupe_combines_before_the_shuffle(spark):
    rows = catalog.table(spark, SF_DIR, "lineitem")
    text = plan(keep_last(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate"]))
    assert "partial_max" in text and "Window" not in text


def test_newest_ranks_only_days_that_matter(spark):
    frame = walk(4000, 3)
    bars = materialize(to_spark(spark, frame), "bars")
    out = newest(bars, 10)
    assert out.count() == 10
    ranked = re.findall(r"Window \[row_number\(\).*", plan(out))
    assert ranked and all("_day" in r for r in ranked)


def test_newest_prunes_days_of_a_partitioned_table(spark):
    path = new_path(spark, "bars")
    frame = walk(4000, 3)
    write_bars(to_spark(spark, frame), path)
    out = newest(spark.read.parquet(path), 10)
    assert "dynamicpruning" in plan(out)
    got = out.toPandas().sort_values("bar_ts")
    assert got["bar_ts"].tolist() == frame["bar_ts"].tail(10).tolist()


@pytest.mark.parametrize("name", ["feature_frame", "signals", "xsection_any_size", "asof_features"])
def test_no_cross_joins_or_python(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert bad not in text


def test_table_in_work_folder_is_read_back_whole(spark):
    df = to_spark(spark, walk(10, 1))
    stored = materialize(df, "t")
    assert "FileScan parquet" in plan(stored)
    pd.testing.assert_frame_equal(
        stored.toPandas().sort_values("bar_ts").reset_index(drop=True),
        df.toPandas().sort_values("bar_ts").reset_index(drop=True),
    )


def test_stored_counts_give_the_scan_its_days(spark):
    path = new_path(spark, "bars")
    frame = pd.concat([walk(4000, 3, "A"), walk(30, 4, "B")])
    bars = materialize(to_spark(spark, frame), "bars")
    early = bars.where(F.col("bar_ts") < "2024-01-03")
    write_bars(early, path)
    write_bars(bars.join(early, ["series", "bar_ts"], "left_anti").select(*bars.columns), path)
    out = read_newest(spark, path, 10)
    scans = re.findall(r"PartitionFilters: \[([^\]]*)", plan(out))
    days = sorted({str(t)[:10] for t in frame.groupby("series")["bar_ts"].nlargest(10)})
    assert any("trade_date" in f and "IN" in f.upper() for f in scans) or any(d in f for f in scans for d in days)
    got = out.toPandas().sort_values(["series", "bar_ts"])
    want = frame.sort_values(["series", "bar_ts"]).groupby("series").tail(10)
    assert got["bar_ts"].tolist() == want["bar_ts"].tolist()
    read = {f.split("trade_date=")[1][:10] for f in out.inputFiles() if "trade_date=" in f}
    assert set(days) <= read


def test_newest_keeps_rows_without_key_or_time(spark):
    rows = [(None, None, 1.0), (None, datetime(2024, 1, 1), 2.0), ("A", None, 3.0), ("A", None, 4.0), ("A", datetime(2024, 1, 2), 5.0)]
    df = spark.createDataFrame(rows, "series string, bar_ts timestamp_ntz, close double")
    path = new_path(spark, "bars")
    write_bars(df, path)
    for table in (df, spark.read.parquet(path)):
        assert sorted(r["close"] for r in newest(table, 2).collect() if r["series"] is None) == [1.0, 2.0]
        assert [r["close"] for r in newest(table, 1).collect() if r["series"] == "A"] == [5.0]
        assert newest(table, 3).count() == 5
    assert with_min_history(df, 3).count() == 3


def exchanges(df) -> int:
    return plan(df).count("Exchange hashpartitioning")


def test_a_frame_is_laid_out_once_for_window_and_join(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        bars = materialize(to_spark(spark, walk(500, 3)), "bars")
        assert exchanges(with_min_history(bars, 3)) == 2
        line = ordered(bars, bar_seconds=300)
        out = ewm_means(line, [Ewm("e", "close", 5, True)]).df
        text = plan(out)
        wide = [x for x in re.findall(r"Exchange hashpartitioning\(([^,]*)", text) if x.startswith("_key")]
        # Rows by run once for the window and once where the states are made from it; states once.
        assert len(wide) <= 3 and "coalesce(" not in "".join(re.findall(r"hashpartitioning\(.*", text))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
