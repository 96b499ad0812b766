"""Live bars and signals.

A store is a table of batches (``sources.commits``): each micro-batch, back-fill or restatement is
one commit, and of the rows with one key the last commit's counts. A batch that runs again takes
the place of its earlier attempt, so replays are harmless even if they yield other rows or fewer
days. A back-fill beats what is stored when it runs, and bars that come later beat the back-fill.

Event time is TIMESTAMP inside the stream (a watermark needs it) and zone-free at both ends;
run these jobs with ``spark.sql.session.timeZone=UTC``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.bars import bar_columns, build_bars, merge_bars, tick_columns
from ..operators.history import keep_last, overlay
from ..schemas import HISTORY_ROWS, TICK
from ..session import materialize, scratch
from ..sources.commits import NO_DAY, Commits, Files

_D, _NTZ = T.DoubleType(), T.TimestampNTZType()
STORED_BAR = T.StructType(
    [
        T.StructField("series", T.StringType()),
        T.StructField("bar_ts", _NTZ),
        *[T.StructField(c, _D) for c in ("open", "high", "low", "close", "volume")],
        T.StructField("open_ts", _NTZ),
        T.StructField("close_ts", _NTZ),
        T.StructField("is_final", T.BooleanType()),
    ]
)
BAR_KEYS = ("series", "bar_ts")
BACKFILL_BATCH = -1
#: Marks a row that withdraws its key.
GONE = T.StructField("_gone", T.BooleanType())


def read_ticks(
    spark: SparkSession, folder: str, *, schema: T.StructType = TICK, name: str = "*.parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Stream the tick files of a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def live_bars(
    ticks: DataFrame,
    width: str,
    delay: str,
    *,
    final: bool,
    series: str = "event_type",
    ts: str = "ts",
    price: str = "value",
    volume: str | None = None,
    tick_key: Sequence[str] = (),
) -> DataFrame:
    """Bars of a tick stream.

    ``final=True`` is for append mode: a bar appears once, when the watermark has passed its
    end. ``final=False`` is for update mode: a bar appears whenever it changes. State is one
    fixed-width row per open (series, bar), however many ticks arrive. With ``tick_key`` a tick
    delivered twice counts once.
    """
    timed = ticks.where(F.col(ts).isNotNull() & F.col(price).isNotNull()).withColumn(
        ts, F.col(ts).cast("timestamp")
    )
    timed = timed.withWatermark(ts, delay)
    if tick_key:
        timed = timed.dropDuplicatesWithinWatermark(list(tick_key))
    bars = (
        timed.select(F.col(series).alias("series"), ts, *tick_columns(ts, price, volume))
        .groupBy("series", F.window(ts, width))
        .agg(*bar_columns())
    )
    ntz = {c: F.col(c).cast("timestamp_ntz") for c in ("open_ts", "close_ts")}
    return (
        bars.withColumn("bar_ts", F.col("window.start").cast("timestamp_ntz"))
        .withColumns(ntz)
        .withColumn("is_final", F.lit(final))
        .select(*STORED_BAR.names)
    )


def store_batch(
    rows: DataFrame,
    batch_id: int,
    path: str,
    *,
    epoch: str = "",
    time: str = "bar_ts",
    whole: bool = False,
) -> None:
    """Commit one batch, replacing an earlier attempt at batch ``batch_id`` of run ``epoch``.

    ``whole`` says that the rows are all there is of their days (a merge of what was stored).
    """
    spark = rows.sparkSession
    commits = Commits(spark, path)
    commit, old = commits.next(epoch, batch_id)
    folder = f"{commits.path}/{commit.folder}"
    (
        rows.withColumn("trade_date", F.to_date(time))
        .hint("rebalance", "trade_date")
        .write.mode("overwrite")  # what a failed attempt has left
        .partitionBy("trade_date")
        .parquet(folder)
    )
    written = T.StructType([rows.schema[time], T.StructField("trade_date", T.DateType())])
    counted = (
        spark.read.schema(written).parquet(folder)
        .groupBy("trade_date").agg(F.countDistinct(time).alias("n"))
    )
    days = {r["trade_date"].isoformat() if r["trade_date"] else NO_DAY: r["n"] for r in counted.collect()}
    commits.add(replace(commit, days=days, whole=whole), old)


def stored_rows(
    spark: SparkSession, path: str, schema: T.StructType, days: Sequence[date] | None = None
) -> DataFrame:
    """All rows of the commits that count, with ``commit``; of some days only if ``days`` is given."""
    placed = T.StructType(
        [
            *schema.fields,
            T.StructField("commit", T.StringType()),
            T.StructField("trade_date", T.DateType()),
        ]
    )
    commits = Commits(spark, path)
    folders = commits.folders(None if days is None else [d.isoformat() for d in days])
    if not folders:
        return spark.createDataFrame([], placed)
    return spark.read.schema(placed).option("basePath", commits.path).parquet(*folders)


def read_store(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    keys: Sequence[str] = BAR_KEYS,
    days: Sequence[date] | None = None,
) -> DataFrame:
    """Stored rows, of each key the last one committed, unless that one withdraws it."""
    marked = T.StructType([*schema.fields, GONE])
    rows = keep_last(stored_rows(spark, path, marked, days), keys, ["commit"])
    return rows.where(~F.coalesce(GONE.name, F.lit(False))).select(*schema.names)


def merge_store(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fresh: DataFrame,
    *,
    epoch: str,
    batch_id: int = BACKFILL_BATCH,
    keys: Sequence[str] = BAR_KEYS,
) -> None:
    """Upsert by copy: the days ``fresh`` touches are rewritten whole, with its rows over what is
    stored. Files of other days are not touched, and readers of these days read one commit."""
    with scratch(spark):
        fresh = materialize(fresh.select(*schema.names), "fresh")
        touched = [r["d"] for r in fresh.select(F.to_date("bar_ts").alias("d")).distinct().collect()]
        days = [d for d in touched if d is not None]
        merged = overlay(read_store(spark, path, schema, keys, days), fresh, keys=keys)
        store_batch(merged.where(F.col("bar_ts").isNotNull()), batch_id, path, epoch=epoch, whole=True)


def read_tail(
    spark: SparkSession,
    path: str,
    bar_times: int,
    *,
    until: date,
    span_days: int = 0,
    since: datetime | None = None,
) -> DataFrame:
    """Bars of all series over the newest ``bar_times`` bar times up to ``until``, in whole days.

    The manifests tell how many bar times a day has, so only days that matter are read (and
    at least the last ``span_days``). With ``since`` the bar times before it are counted, and
    everything from it on is read too.
    """
    commits = Commits(spark, path)
    edge = until if since is None else since.date()
    # The day of ``since`` does not count: its bar times may lie after it.
    counted_to = edge if since is None else edge - timedelta(days=1)
    days = {date.fromisoformat(d) for d in commits.days_back(counted_to.isoformat(), bar_times)}
    days |= {until - timedelta(days=i) for i in range(span_days)}
    days |= {d for d in commits.dates() if edge <= d <= until}
    bars = read_store(spark, path, STORED_BAR, days=sorted(days))
    counted = bars if since is None else bars.where(F.col("bar_ts") < F.lit(since))
    newest_times = counted.select("bar_ts").distinct().orderBy(F.desc("bar_ts")).limit(bar_times)
    first = newest_times.agg(F.to_date(F.min("bar_ts")).cast("timestamp_ntz").alias("day")).first()["day"]
    if first is None:
        return bars
    return bars.where(F.col("bar_ts") >= F.lit(first))


def run_epoch(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that owns a checkpoint. It outlives restarts, and a new checkpoint,
    whose batches count from 0 again, has another one."""
    return json.loads(Files(spark, checkpoint).read(f"{checkpoint.rstrip('/')}/metadata"))["id"]


def start_bar_store(
    bars: DataFrame, path: str, checkpoint: str, *, mode: str = "append",
    on_batch: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Store live bars; ``on_batch`` runs after each batch is stored."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        epoch = run_epoch(batch.sparkSession, checkpoint)
        batch.persist()
        # An empty batch may stand for an earlier attempt that was not.
        if not batch.isEmpty() or Commits(batch.sparkSession, path).next(epoch, batch_id)[1]:
            store_batch(batch, batch_id, path, epoch=epoch)
            if on_batch is not None and not batch.isEmpty():
                job = replace(on_batch, epoch=epoch) if isinstance(on_batch, SignalJob) else on_batch
                job(batch, batch_id)
        batch.unpersist()

    return _start(bars, handle, checkpoint, mode, trigger)


def _start(rows: DataFrame, handle, checkpoint: str, mode: str, trigger: dict | None) -> StreamingQuery:
    return (
        rows.writeStream.outputMode(mode)
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def start_open_bars(
    ticks: DataFrame,
    width: str,
    delay: str,
    path: str,
    checkpoint: str,
    *,
    tick_key: Sequence[str],
    series: str = "event_type",
    ts: str = "ts",
    price: str = "value",
    volume: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the present state of bars that may still change, each tick counted once.

    Ticks delivered again are dropped by keyed state that the watermark clears. What is left of
    a batch becomes partial bars, one commit per batch: work and state follow the batch, not the
    length of a bar or of the history. ``read_open_bars`` puts the parts together.
    """
    timed = ticks.where(F.col(ts).isNotNull() & F.col(price).isNotNull()).withColumn(
        ts, F.col(ts).cast("timestamp")
    )
    once = timed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(tick_key))

    def handle(batch: DataFrame, batch_id: int) -> None:
        local = batch.withColumn(ts, F.col(ts).cast("timestamp_ntz"))
        parts = build_bars(local, width, series=series, ts=ts, price=price, volume=volume)
        rows = parts.withColumn("is_final", F.lit(False)).select(*STORED_BAR.names)
        store_batch(rows, batch_id, path, epoch=run_epoch(batch.sparkSession, checkpoint))

    return _start(once, handle, checkpoint, "append", trigger)


def read_open_bars(spark: SparkSession, path: str, days: Sequence[date] | None = None) -> DataFrame:
    """Bars as of the last batch, from the partial bars of all batches."""
    merged = merge_bars(stored_rows(spark, path, STORED_BAR, days), BAR_KEYS)
    return merged.withColumn("is_final", F.lit(False)).select(*STORED_BAR.names)


def live_view(final: DataFrame, provisional: DataFrame) -> DataFrame:
    """Final bars, plus the present state of bars that are not final yet."""
    open_bars = provisional.join(final.select(*BAR_KEYS), list(BAR_KEYS), "left_anti")
    return overlay(final, open_bars, keys=BAR_KEYS)


@dataclass(frozen=True)
class SignalJob:
    """Per batch: read the bounded tail of the bar store, build features, score and store signals.

    A batch in order scores its own bar times. If it restates or fills in earlier bars, all bar
    times from the first of them on are scored again, since their features look back on it.
    Signals that no longer hold are withdrawn. ``plan`` maps bars and the bar times to score to
    signal rows. Tables made on the way are deleted.
    """

    bars_path: str
    signals_path: str
    signal_schema: T.StructType
    plan: Callable[[DataFrame, DataFrame], DataFrame]
    history_rows: int = HISTORY_ROWS
    span_days: int = 0
    epoch: str = ""

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = batch.agg(F.min("bar_ts").alias("first")).first()
        if found["first"] is None:
            return
        last = max(Commits(spark, self.bars_path).dates())
        with scratch(spark):
            tail = read_tail(
                spark, self.bars_path, self.history_rows, since=found["first"],
                until=last, span_days=self.span_days,
            )
            tail = materialize(tail, "tail")
            times = tail.where(F.col("bar_ts") >= F.lit(found["first"])).select("bar_ts").distinct()
            fresh = materialize(self.plan(tail, times).select(*self.signal_schema.names), "signals")
            # Signals of the times that were scored again, and are not given any more.
            known = self.read(spark).where(F.col("bar_ts") >= F.lit(found["first"]))
            withdrawn = (
                known.join(fresh.select("bar_ts"), "bar_ts", "left_anti")
                .select("bar_ts", F.lit(True).alias(GONE.name))
            )
            marked = fresh.withColumn(GONE.name, F.lit(False))
            rows = materialize(marked.unionByName(withdrawn, allowMissingColumns=True), "marked")
            store_batch(rows, batch_id, self.signals_path, epoch=self.epoch)

    def read(self, spark: SparkSession) -> DataFrame:
        """One signal per bar, the last one written and not withdrawn."""
        return read_store(spark, self.signals_path, self.signal_schema, ["bar_ts"])


def backfill_store(fresh: DataFrame, path: str, *, name: str, signals: SignalJob | None = None) -> None:
    """Put the bars of a back-fill or a restatement over what is stored, and score again.

    ``name`` tells runs apart: the same one again replaces its earlier attempt. Bars the stream
    stores later count over these.
    """
    store_batch(fresh.select(*STORED_BAR.names), BACKFILL_BATCH, path, epoch=name)
    if signals is not None:
        replace(signals, epoch=name)(fresh, BACKFILL_BATCH)
