"""What several operators share: word rule, shared files, streaming over sorted rows."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path

#: White space of all word and line rules.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
FILTER_BITS = 1 << 26  # 8 MB; with more keys than a sixteenth of it, more rows pass by chance
PART_ROWS = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def importable_by_tasks(spark: SparkSession) -> None:
    """Let Python tasks import this package from where the driver has it.

    For local sessions and shared installations; a cluster without either gets the package by
    ``--py-files``, and then this path is just not there.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one, with its scheme, so that tasks find it where Spark does."""
    path = spark._jvm.org.apache.hadoop.fs.Path(new_path(spark, label))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def likely_in(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` is no ``wanted_key``; none that has one is lost."""
    return split_likely(rows, key, wanted, wanted_key)[0]


def split_likely(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``key`` may be a ``wanted_key``, and those whose key is surely none.

    The first are to be joined afterwards: this keeps wide rows without a partner out of the
    shuffle. One bit per hash of a wanted key, at most ``FILTER_BITS``, in a file of the shared
    folder. Null is a key.
    """
    spark, names = rows.sparkSession, rows.columns
    bits = 1 << max(10, min(FILTER_BITS.bit_length() - 1, (16 * wanted.count()).bit_length()))
    cell = lambda c: F.xxhash64(c).bitwiseAND(F.lit(bits - 1))
    mask = F.bit_or(F.expr("shiftleft(1L, cast(_cell & 63 as int))"))
    folder = shared_folder(spark, "filter")
    words = wanted.select(cell(wanted_key).alias("_cell")).groupBy(F.expr("_cell >> 6").alias("word")).agg(mask.alias("mask"))
    words.repartition(1).write.parquet(folder)  # at most FILTER_BITS / 64 rows
    extra = "_cell"
    while extra in names:
        extra += "_"

    def filtered(likely: bool) -> DataFrame:
        def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, root = open_folder(folder)
            stored = pq.read_table(root, filesystem=system)
            held = np.zeros(bits // 64, np.int64)
            held[stored.column("word").to_numpy()] = stored.column("mask").to_numpy()
            for batch in batches:
                at = batch.column(batch.num_columns - 1).to_numpy()
                set_ = ((held[at >> 6] >> (at & 63)) & 1).astype(bool)
                yield batch.select(names).filter(pa.array(set_ == likely))

        return rows.withColumn(extra, cell(key)).mapInArrow(giving_back(keep), rows.schema)

    return filtered(True), filtered(False)


def shared_file(folder: str, label: str) -> tuple[pafs.FileSystem, str, str]:
    """File system, path there and URI of a new file in a shared folder, made on any executor.

    Each attempt of a task gets a name of its own. Only names that a committed result
    carries are read, so files of lost or doubled attempts do no harm.
    """
    system, root = open_folder(folder)
    system.create_dir(root, recursive=True)
    name = f"{label}-{uuid.uuid4().hex}"
    return system, f"{root}/{name}", f"{folder.rstrip('/')}/{name}"


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder.rstrip("/")
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/").rstrip("/")
    return pafs.FileSystem.from_uri(folder.rstrip("/"))


Batches = Iterable[pa.RecordBatch]


def give_back() -> None:
    """Memory that is free goes back to the system."""
    gc.collect()  # closures that know each other hold caches until then
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def giving_back(work: Callable[[Batches], Iterator[pa.RecordBatch]]) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """``work`` for the batches of a task, whose memory goes back to the system at its end: Spark
    keeps the Python worker for later tasks and stages, which need the room."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def parts(batches: Batches, rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut into parts of at most ``rows`` rows, so that a task holds the values of few
    rows as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def runs(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of whole key groups from batches sorted by ``keys`` (null keys are equal).

    Every table holds at least one group and ends at a group border, so many small groups
    are handled at once. Only the group that a batch border cuts is kept between batches.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
        for k in keys:
            changed |= differs(batch.column(batch.schema.get_field_index(k)))
        cuts = np.flatnonzero(changed) + 1
        first = batch.slice(0, 1).select(list(keys)).to_pylist()
        if held and held[-1].slice(held[-1].num_rows - 1).select(list(keys)).to_pylist() != first:
            yield pa.Table.from_batches(held)
            held = []
        if len(cuts):
            held.append(batch.slice(0, int(cuts[-1])))
            yield pa.Table.from_batches(held)
            held = [batch.slice(int(cuts[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def differs(column: pa.Array) -> np.ndarray:
    """For each row but the first: is it another value than the row before it?"""
    null = column.is_null().to_numpy(zero_copy_only=False)
    if pa.types.is_integer(column.type):
        values = column.fill_null(0).to_numpy(zero_copy_only=False)
    else:
        values = column.to_numpy(zero_copy_only=False)
    return (null[1:] != null[:-1]) | (~null[1:] & ~null[:-1] & (values[1:] != values[:-1]))


def borders(table: pa.Table, keys: Sequence[str]) -> list[tuple[int, int]]:
    """Start and end of each key group in a table sorted by ``keys``."""
    if not table.num_rows:
        return []
    changed = np.zeros(table.num_rows - 1, dtype=bool)
    for k in keys:
        changed |= differs(table.column(k).combine_chunks())
    at = [0, *(np.flatnonzero(changed) + 1).tolist(), table.num_rows]
    return list(zip(at[:-1], at[1:], strict=True))
