"""Mixing of sources by a time-varying curriculum.

Every source has a weight schedule over training time 0..1, linear between its knots. The
share of a source at a time is its weight over the weights of all sources; integrating it
gives its cumulative demand in words, scaled so that the demand at time 1 is its target. A
document's place in its shuffled source is a place on that demand curve, and inverting the
curve gives the time at which it is read. Sorting all documents by that time is the mix.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import WORD, text_or_empty

Schedule = Sequence[tuple[float, float]]  # (time, weight) knots, times rising from 0 to 1

CYCLE = (5.0, 2.0, 1.0)
BUCKET_ROWS = 4096


def word_count(name: str = "text") -> Column:
    return F.regexp_count(text_or_empty(name), F.lit(WORD)).cast("bigint")


def capped_shares(
    sizes: Sequence[int], weights: Sequence[float], total: float, most: float
) -> list[float]:
    """Targets in proportion to the weights, none above ``most`` times its size.

    A source over its limit is set to it and what it leaves is shared among the others, until
    none is above. Exact and order-free: sources meet their limit by falling weight per size.
    """
    limits = [most * s for s in sizes]
    target = [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    left = float(total)
    while open_:
        weight = sum(weights[i] for i in sorted(open_))
        if weight <= 0:
            break
        over = {i for i in open_ if left * weights[i] / weight >= limits[i]}
        if not over:
            for i in open_:
                target[i] = left * weights[i] / weight
            break
        for i in over:
            target[i] = float(limits[i])
        left -= sum(limits[i] for i in sorted(over))
        open_ -= over
    return target


def demand_curves(
    targets: Mapping[str | None, float], schedules: Mapping[str | None, Schedule], steps: int = 256
) -> tuple[np.ndarray, dict[str | None, np.ndarray]]:
    """Times, and the cumulative demand of each source at them (its target at time 1).

    Sources with equal schedules have equal shapes; a schedule that is constant for all
    sources gives straight lines.
    """
    times = np.linspace(0.0, 1.0, steps + 1)
    middle = (times[1:] + times[:-1]) / 2
    weight = {
        s: np.interp(middle, [t for t, _ in knots], [w for _, w in knots])
        for s, knots in schedules.items()
    }
    whole = np.sum(list(weight.values()), axis=0) if weight else np.ones(steps)
    curves = {}
    for s, w in weight.items():
        rise = np.divide(w, whole, out=np.zeros_like(w), where=whole > 0)
        total = rise.sum()
        shape = np.cumsum(rise) / total if total > 0 else np.cumsum(np.full(steps, 1 / steps))
        curves[s] = np.concatenate([[0.0], shape]) * targets[s]
    return times, curves


def source_targets(sized: DataFrame, share: float, most: float, cycle: Sequence[float]) -> DataFrame:
    """Source, size, weight, target: one row per source, the sources numbered by code point.

    Only the numbering and the resharing see all sources. Both are done on one row per source
    (a corpus has a catalogue of sources, not one per document); the result is a small table.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = sorted(
        ((r["source"], r["source_size"]) for r in totals.toLocalIterator()),
        key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8")),
    )
    weights = [cycle[i % len(cycle)] for i in range(len(rows))]
    total = share * sum(size for _, size in rows)
    targets = capped_shares([size for _, size in rows], weights, total, most)
    names, sizes = zip(*rows, strict=True) if rows else ((), ())
    columns = {
        "source": pa.array(names, pa.string()),
        "source_size": pa.array(sizes, pa.int64()),
        "weight": pa.array(weights, pa.float64()),
        "target": pa.array(targets, pa.float64()),
    }
    # As Arrow: a list of rows would start Python workers of another kind on the executors.
    return sized.sparkSession.createDataFrame(pa.table(columns))


def place(
    docs: DataFrame,
    *,
    share: float = 1.5,
    most: float = 2.0,
    cycle: Sequence[float] = CYCLE,
    schedules: Mapping[str | None, Schedule] | None = None,
    keep: Sequence[str] = (),
    seed: str = "mix",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per document with its place on the demand curve of its source.

    ``doc_id, source, size, source_size, target, _limit, _at``: ``_at`` words of the source
    come before it in an epoch, ``_limit`` is the target in whole words. ``keep`` names columns
    of ``docs`` that come along in ``_keep``; no other column is read, so clashing names do no
    harm.

    A null or blank text has size 0 and is never read; a null source is a source, ordered last.
    Repeated rows are documents of their own; equal ids are told apart by text, and rows equal
    in both are interchangeable. An empty table gives an empty mix.

    The order in a source is by MD5 of seed and id. Places come from sums per hash bucket of
    about ``bucket_rows`` documents and running sums over buckets, so a source with a third of
    all rows is as parallel as many small ones. Reruns agree: nothing depends on partitions.
    """
    doc_id = F.col("doc_id")
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    sized = docs.select(
        doc_id,
        F.col("source").cast("string").alias("source"),
        word_count().alias("size"),
        draw.alias("_draw"),
        F.xxhash64("text").alias("_text"),
        F.struct(*[F.col(c) for c in keep] or [F.lit(0)]).alias("_keep"),
    )
    narrow = materialize(sized.drop("_keep"), "sized")
    plan = source_targets(narrow, share, most, cycle)
    buckets = max(1, -(-narrow.count() // bucket_rows))
    # One key that is never null, so that the join and the window share one shuffle.
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    bucket = F.floor(
        F.conv(F.substring("_draw", 1, 8), 16, 10).cast("bigint") * F.lit(buckets) / (1 << 32)
    )
    keyed = {"_source": key, "_bucket": bucket}
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    curves = plan.select(
        key.alias("_source"), "source_size", "target", _curve(plan, schedules).alias("_curve")
    )
    bases = (
        narrow.withColumns(keyed)
        .groupBy("_source", "_bucket")
        .agg(F.sum("size").alias("_sum"))
        .withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .drop("_sum")
        .join(curves, "_source")
    )
    inside = Window.partitionBy("_source", "_bucket").orderBy("_draw", "doc_id", "_text")
    earlier = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = sized if keep else narrow
    return (
        rows.withColumns(keyed)
        .join(materialize(bases, "bases"), ["_source", "_bucket"])
        .withColumn("_at", F.col("_base") + F.coalesce(earlier, F.lit(0)))
        .withColumn("_limit", F.round("target").cast("bigint"))
        .drop("_source", "_bucket", "_base", "_draw", "_text")
    )


def _read_words(at: Column) -> Column:
    """Words of a reading that starts at ``at``: all of them up to the source's limit."""
    return F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), F.col("_limit") - at))


def _readings() -> Column:
    """The readings of a document in the epochs that the source's demand reaches, in order: ``words`` of
    it at training time ``position``, where the demand curve reaches the words before it."""
    last = F.ceil((F.col("_limit") - F.col("_at")) / F.greatest(F.col("source_size"), F.lit(1))) - 1
    epochs = F.when(
        (F.col("size") > 0) & (last >= 0), F.sequence(F.lit(0).cast("bigint"), last)
    ).otherwise(F.expr("cast(array() as array<bigint>)"))
    knots, steps = F.col("_curve"), F.size("_curve") - 1

    def reading(epoch: Column) -> Column:
        at = F.col("_at") + epoch * F.col("source_size")
        k = F.least(steps, F.greatest(F.lit(1), F.size(F.filter(knots, lambda v: v <= at))))
        low, high = F.element_at(knots, k), F.element_at(knots, k + 1)
        part = F.when(high > low, (at - low) / (high - low)).otherwise(0.0)
        return F.struct(_read_words(at).alias("words"), ((k - 1 + part) / steps).alias("position"))

    return F.filter(F.transform(epochs, reading), lambda r: r["words"] > 0)


def taken(placed: DataFrame) -> DataFrame:
    """Each document with the words that the mix takes of it, its readings added up, and the
    ``position`` of its first reading (null: never read), in the order of these positions."""
    read = placed.withColumn("_readings", _readings())
    words = F.aggregate("_readings", F.lit(0).cast("bigint"), lambda sum_, r: sum_ + r["words"])
    first = F.get("_readings", F.lit(0))["position"]
    rows = read.select(
        "doc_id", "size", "source_size", "target", words.alias("taken"), first.alias("position")
    )
    return rows.orderBy(F.asc_nulls_last("position"), "doc_id")


def readings(placed: DataFrame) -> DataFrame:
    """One row per reading of a document: ``words`` of it at training time ``position`` (0 to 1).

    All readings are whole but the one that meets its source's target; it is cut there.
    """
    read = placed.withColumn("_reading", F.explode(_readings()))
    return read.select("*", "_reading.*").drop("_reading")


def ordered_texts(placed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix as documents in reading order: ``columns`` of each reading, its text cut to its
    words. ``placed`` must keep these columns. Sorted by range of position over all partitions.
    """
    parts = F.slice(
        F.regexp_extract_all(F.col("_keep.text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)),
        F.lit(1),
        F.col("words").cast("int"),
    )
    text = F.when(F.col("words") < F.col("size"), F.array_join(parts, "")).otherwise(
        F.col("_keep.text")
    )
    mixed = readings(placed).orderBy("position", "doc_id")
    return mixed.select(
        *[text.alias(c) if c == "text" else F.col(f"_keep.{c}").alias(c) for c in columns]
    )


def _curve(plan: DataFrame, schedules: Mapping[str | None, Schedule] | None) -> Column:
    """Cumulative demand of the row's source at equal steps of time, as an array.

    Constant weights give a straight line. Scheduled sources get literal arrays of a few
    hundred numbers each, joined on one row per source and bucket.
    """
    straight = F.array(F.lit(0.0), F.col("target"))
    if not schedules:
        return straight
    rows = plan.collect()  # one row per source
    every = {
        r["source"]: schedules.get(r["source"], ((0.0, r["weight"]), (1.0, r["weight"])))
        for r in rows
    }
    _, curves = demand_curves({r["source"]: r["target"] for r in rows}, every)
    out = straight
    for source, curve in curves.items():
        knots = F.array(*[F.lit(float(v)) for v in curve])
        out = F.when(F.col("source").eqNullSafe(F.lit(source)), knots).otherwise(out)
    return out
