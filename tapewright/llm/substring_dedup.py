"""Removal of word passages that an earlier document already has.

A window is ``size`` consecutive words. Three passes over the documents:

1. Tasks count windows in count-min sketches and send what they touched, segment by segment. The
   merged sketch never underestimates, so a window it has seen once occurs once. All that is
   stored of it is one bit per cell: seen twice or more.
2. Tasks take the windows whose cells all have that bit, as 128-bit hashes, one entry per chunk of
   documents and distinct window. Entries are grouped exactly, shard by shard; those that a
   smaller ``doc_id`` holds as well go back to their chunk as positions.
3. Positions become word spans per document, and the documents lose these words.

Entries travel as packed arrays of one chunk and shard, not as rows. A window that a third of all
documents have is one entry per chunk. Words and windows are hashed by whole arrays over the
bytes of a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, new_path
from .common import open_folder, shared_file, text_or_empty

SIZE = 13
NO_ID = np.iinfo(np.int64).min
ROWS = 2  # of the sketch


@dataclass(frozen=True)
class Limits:
    """Sizes of the pieces the work is cut into. They bound memory and don't change results."""

    slab_bytes: int = 1 << 20      # text hashed at a time (or one document, if longer)
    chunk_windows: int = 1 << 21   # windows a task holds: some 100 MB
    shard_windows: int = 1 << 21   # windows of the corpus per shard of the exact grouping
    segment_cells: int = 1 << 22   # cells of a stored piece of the sketch: half a MB
    row_cells: int = 1 << 33       # most cells of a sketch row: 1 GB; beyond it more windows pass, none is lost


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _numbers(n: int, stream: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers that look random, another sequence for each stream."""
    with np.errstate(over="ignore"):
        steps = np.arange(1, n + 1, dtype=np.uint64) + np.uint64(stream << 40)
        return _mix(steps * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


class Hasher:
    """128-bit hashes of the windows of documents, from the bytes of their texts."""

    def __init__(self, size: int, limits: Limits = Limits()):  # noqa: B008
        self.size, self.limits = size, limits
        self.factors = [_numbers(size, 3), _numbers(size, 4)]
        self.places = [_numbers(256, 1), _numbers(256, 2)]

    def words(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Start byte and two hashes of each word; ``starts`` are the documents' first bytes."""
        solid = ~SPACES[data]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        inner = starts[starts < len(data)]
        first[inner] = solid[inner]
        at = np.flatnonzero(first)
        if not len(at):
            return at, [np.zeros(0, np.uint64)] * 2
        body = np.flatnonzero(solid)
        word = np.cumsum(first)[body] - 1
        place = body - at[word]
        heads = np.searchsorted(body, at)
        values = data[body].astype(np.uint64) + np.uint64(1)
        longest = int(place.max()) + 1
        hashes = []
        for stream in (0, 1):
            if longest > len(self.places[stream]):
                self.places[stream] = _numbers(2 * longest, stream + 1)
            with np.errstate(over="ignore"):
                hashes.append(_mix(np.add.reduceat(values * self.places[stream][place], heads)))
        return at, hashes

    def windows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of each text, and the two hashes of all windows in order."""
        offsets, data = _buffers(texts)
        counts, parts = np.zeros(len(texts), np.int64), ([], [])
        begin = 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + self.limits.slab_bytes, "right")) - 1)
            slab = data[offsets[begin] : offsets[end]]
            starts = offsets[begin:end] - offsets[begin]
            at, hashes = self.words(slab, starts)
            # Words of each text, and of them those that start a window.
            words = np.diff(np.append(np.searchsorted(at, starts), len(at)))
            counts[begin:end] = np.maximum(words - self.size + 1, 0)
            n = len(at) - self.size + 1
            if n > 0:
                left = np.repeat(np.cumsum(words), words) - np.arange(len(at))
                whole = np.flatnonzero(left[:n] >= self.size)
                for stream in (0, 1):
                    h, total = hashes[stream], np.zeros(n, np.uint64)
                    with np.errstate(over="ignore"):
                        for j, f in enumerate(self.factors[stream]):
                            total += h[j : j + n] * f
                    parts[stream].append(_mix(total[whole]))
            begin = end
        joined = [np.concatenate(p) if p else np.zeros(0, np.uint64) for p in parts]
        return counts, joined[0], joined[1]


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


class Chunk:
    """Documents with about ``chunk_windows`` windows."""

    def __init__(self):
        self.counts: list[np.ndarray] = []
        self.hashes: tuple[list, list] = ([], [])
        self.keys: list[list[np.ndarray]] = []
        self.windows = 0

    def hashed(self, stream: int) -> np.ndarray:
        return np.concatenate(self.hashes[stream]) if self.windows else np.zeros(0, np.uint64)


def chunks(batches: Iterable[pa.RecordBatch], hasher: Hasher) -> Iterator[Chunk]:
    held = Chunk()
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index("text"))
        offsets, _ = _buffers(texts)
        begin = 0
        while begin < len(texts):
            # A window takes two bytes at least.
            room = 2 * hasher.limits.chunk_windows
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + room, "right")) - 1)
            counts, h1, h2 = hasher.windows(texts.slice(begin, end - begin))
            held.counts.append(counts)
            held.hashes[0].append(h1)
            held.hashes[1].append(h2)
            held.windows += len(h1)
            held.keys.append([
                batch.column(batch.schema.get_field_index(k)).slice(begin, end - begin).to_numpy(zero_copy_only=False)
                for k in ("_id", "_k1", "_k2") if k in batch.schema.names
            ])
            if held.windows >= hasher.limits.chunk_windows:
                yield held
                held = Chunk()
            begin = end
    if held.counts:
        yield held


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; ascending unsigned ones shrink as differences."""
    body = b"".join(np.int64([len(a)]).tobytes() + a.tobytes() for a in arrays)
    return np.int64([len(body)]).tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    size = int(np.frombuffer(blob, np.int64, 1)[0])
    body = pa.decompress(blob[8:], size, codec="zstd", asbytes=True)
    out, at = [], 0
    for kind in kinds:
        n = int(np.frombuffer(body, np.int64, 1, at)[0])
        out.append(np.frombuffer(body, kind, n, at + 8))
        at += 8 + n * np.dtype(kind).itemsize
    return out


def steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, in two bytes each if they fit."""
    gaps = np.diff(ascending, prepend=0)
    return gaps.astype(np.uint16 if not len(gaps) or gaps.max() < 1 << 16 else np.uint32)


def pack_ascending(ascending: np.ndarray) -> bytes:
    gaps = steps(ascending)
    return bytes([gaps.itemsize]) + pack(gaps)


def unpack_ascending(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob[1:], f"u{blob[0]}")[0], dtype=np.int64)


# ---------------------------------------------------------------- sketch


def sizes(docs: DataFrame, limits: Limits) -> tuple[int, int]:
    """Cells of a sketch row (a power of two, some four per window of usual prose), and shards."""
    chars = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    cells = min(limits.row_cells, max(limits.segment_cells, 1 << int(chars // 2).bit_length()))
    return cells, 1 + chars // 6 // limits.shard_windows


def cell(h1: np.ndarray, h2: np.ndarray, row: int, cells: int) -> np.ndarray:
    """Cell of each window in a sketch row, from hash bits that the rows don't share."""
    return ((h1, h2)[row] >> np.uint64(64 - cells.bit_length() + 1)).astype(np.int64)


def build_sketch(docs: DataFrame, cells: int, size: int, limits: Limits) -> list[str]:
    """Files of the merged sketch's segments, row by row: one bit per cell, set from count 2 on.

    At most ``ROWS * row_cells / segment_cells`` paths come to the driver.
    """
    spark = docs.sparkSession
    segment = limits.segment_cells
    per_row = cells // segment
    folder = new_path(spark, "window-sketch")

    def touch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(size, limits)
        for chunk in chunks(batches, hasher):
            h = [chunk.hashed(0), chunk.hashed(1)]
            for row in range(ROWS):
                # Within a chunk counts above 2 need no more than 2 entries.
                at = np.sort(cell(*h, row, cells))
                twice = np.flatnonzero(at[2:] == at[:-2]) + 2
                at = np.delete(at, twice)
                part = at // segment
                cuts = np.flatnonzero(np.diff(part)) + 1
                groups = [g for g in np.split(at, cuts) if len(g)]
                if groups:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row * per_row + int(g[0]) // segment for g in groups], pa.int32()),
                            pa.array([pack_ascending(g % segment) for g in groups], pa.binary()),
                        ],
                        ["segment", "cells"],
                    )

    def merge(touched: pa.Table) -> pa.Table:
        counts = np.zeros(segment, np.uint8)
        for blob in touched.column("cells"):
            at, n = np.unique(unpack_ascending(blob.as_py()), return_counts=True)
            counts[at] = np.minimum(counts[at] + n, 2)
        system, path, _ = shared_file(folder, "segment")
        with system.open_output_stream(path) as out:
            out.write(np.packbits(counts >= 2).tobytes())
        return pa.table({"segment": touched.column("segment").slice(0, 1), "path": [path]})

    touched = docs.select("text").mapInArrow(touch, "segment int, cells binary")
    merged = touched.groupBy("segment").applyInArrow(merge, "segment int, path string")
    paths = {r["segment"]: r["path"] for r in materialize(merged, "segments").collect()}
    return [paths.get(i, "") for i in range(ROWS * per_row)]


class Sketch:
    """Tells for the windows of a chunk whether they may occur twice; reads a segment at a time."""

    def __init__(self, folder: str, paths: list[str], cells: int):
        self.system, self.paths, self.cells = open_folder(folder)[0], paths, cells
        self.segment = cells * ROWS // len(paths)

    def repeated(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Positions of the windows with an estimate of two or more."""
        keep = np.arange(len(h1))
        for row in range(ROWS):
            at = cell(h1[keep], h2[keep], row, self.cells)
            order = np.argsort(at, kind="stable")
            part = at[order] // self.segment
            hit = np.zeros(len(keep), bool)
            for group in np.split(order, np.flatnonzero(np.diff(part)) + 1):
                if len(group):
                    path = self.paths[(row * self.cells + int(at[group[0]])) // self.segment]
                    if path:
                        with self.system.open_input_stream(path) as f:
                            bits = np.frombuffer(f.readall(), np.uint8)
                        inside = at[group] % self.segment
                        hit[group] = (bits[inside >> 3] >> (7 - (inside & 7)).astype(np.uint8)) & 1 > 0
            keep = keep[hit]
        return keep


# ---------------------------------------------------------------- exact grouping


def entries(
    docs: DataFrame, sketch: tuple[str, list[str], int], size: int, shards: int, limits: Limits
) -> DataFrame:
    """Per chunk: one value with its documents, and per shard the entries to be grouped.

    Windows that a smaller id of the same chunk holds are settled here.
    """

    def collect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(size, limits), Sketch(*sketch)
        for chunk in chunks(batches, hasher):
            h1, h2 = chunk.hashed(0), chunk.hashed(1)
            counts = np.concatenate(chunk.counts)
            ids, k1, k2 = (np.concatenate([k[i] for k in chunk.keys]) for i in range(3))
            at = seen.repeated(h1, h2)
            owner = np.repeat(ids, counts)[at]
            h1, h2 = h1[at], h2[at]
            order = np.lexsort((owner, h2, h1))
            h1, h2, owner, at = h1[order], h2[order], owner[order], at[order]
            new = np.ones(len(at), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            least = owner[new][np.cumsum(new) - 1] if len(at) else owner
            open_ = owner == least
            # Named after its content: a task that runs again gives its chunks the same names.
            about = pack(ids, k1, k2, counts, np.sort(at[~open_]))
            name = hashlib.sha256(about).hexdigest()
            rows = [(name, shards + int(name[:8], 16) % shards, about)]
            h1, h2, owner, at = h1[open_], h2[open_], owner[open_], at[open_]
            shard = ((h1 >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
            # By position within a shard: ids repeat and positions are close, which packs well.
            order = np.lexsort((at, shard))
            for group in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                if len(group):
                    blob = pack(h1[group], h2[group], owner[group], at[group].astype(np.uint32))
                    rows.append((name, int(shard[group[0]]), blob))
            for row in rows:
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("chunk", "shard", "packed"), row, strict=True))],
                    pa.schema([("chunk", pa.string()), ("shard", pa.int32()), ("packed", pa.binary())]),
                )

    return docs.mapInArrow(collect, "chunk string, shard int, packed binary")


def settle(entered: pa.Table) -> pa.Table:
    """Positions, per chunk, of the entries of one shard that a smaller id holds too."""
    names = entered.column("chunk").to_pylist()
    arrays = [unpack(b.as_py(), "u8", "u8", "i8", "u4") for b in entered.column("packed")]
    h1, h2, owner, at = (np.concatenate([a[i] for a in arrays]) for i in range(4))
    chunk = np.repeat(np.arange(len(arrays)), [len(a[0]) for a in arrays])
    order = np.lexsort((owner, h2, h1))
    h1, h2, owner = h1[order], h2[order], owner[order]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    later = order[owner > owner[new][np.cumsum(new) - 1]]
    later = np.sort(later)
    cuts = np.searchsorted(chunk[later], np.arange(len(arrays) + 1))
    found = [(names[i], pack_ascending(np.sort(at[later[a:b]]).astype(np.int64))) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
    return pa.table(
        {
            "chunk": pa.array([f[0] for f in found], pa.string()),
            "shard": pa.array([0] * len(found), pa.int32()),
            "packed": pa.array([f[1] for f in found], pa.binary()),
        }
    )


def span_maker(size: int, shards: int):
    """Word spans of each document of a chunk, from the positions that were settled."""

    def spans(rows: pa.Table) -> pa.Table:
        later, about = [], None
        for shard, blob in zip(rows.column("shard").to_pylist(), rows.column("packed"), strict=True):
            if shard >= shards:
                about = unpack(blob.as_py(), "i8", "i8", "i8", "i8", "i8")
            else:
                later.append(unpack_ascending(blob.as_py()))
        ids, k1, k2, counts, local = about
        at = np.unique(np.concatenate([local, *later]))
        ends = np.cumsum(counts)
        doc = np.searchsorted(ends, at, "right")
        start = at - (ends - counts)[doc]
        # Windows that overlap or touch are one span.
        new = np.ones(len(at), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + size)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at))[: len(first)] - 1
        edges = np.stack([start[first], start[last] + size], 1).astype(np.int32).ravel()
        owners = doc[first]
        heads = np.flatnonzero(np.diff(owners, prepend=-1))
        offsets = np.append(2 * heads, len(edges)).astype(np.int32)
        held = owners[heads]
        return pa.table(
            {
                "_id": pa.array(ids[held], pa.int64()),
                "_k1": pa.array(k1[held], pa.int64()),
                "_k2": pa.array(k2[held], pa.int64()),
                "spans": pa.ListArray.from_arrays(pa.array(offsets), pa.array(edges)),
            }
        )

    return spans


def repeated_spans(keyed: DataFrame, size: int, limits: Limits) -> DataFrame:
    """Spans of words (start, end, start, end, ...) to remove, one row per document that has any.

    ``keyed`` has ``_id``, ``_k1``, ``_k2`` (id and hashes of the text, which are the key of the
    result) and ``text``, none of them null.
    """
    spark = keyed.sparkSession
    cells, shards = sizes(keyed, limits)
    folder = new_path(spark, "window-sketch")
    paths = build_sketch(keyed, cells, size, limits)
    entered = entries(keyed, (folder, paths, cells), size, shards, limits)
    packed = "chunk string, shard int, packed binary"

    def by_shard(rows: pa.Table) -> pa.Table:
        # What chunks say of themselves passes through.
        return rows if rows.column("shard")[0].as_py() >= shards else settle(rows)

    settled = entered.groupBy("shard").applyInArrow(by_shard, packed)
    spans = settled.groupBy("chunk").applyInArrow(
        span_maker(size, shards), "_id bigint, _k1 bigint, _k2 bigint, spans array<int>"
    )
    # Equal rows have equal spans.
    return spans.groupBy("_id", "_k1", "_k2").agg(F.first("spans").alias("spans"))


def remove_repeats(docs: DataFrame, *, size: int = SIZE, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """All rows and columns of ``docs``, without the words of windows that a smaller id holds.

    ``text`` is the kept words joined by one space; ``n_words`` and ``n_removed`` are new (columns
    of that name are replaced). A word goes if any window of ``size`` words that covers it also
    starts in a row with a smaller ``doc_id`` (an integer); windows are judged on the input. A
    null id is smaller than any other; rows of one id, or two null ids, don't take words from
    each other, nor does a document from itself. A null or empty text has no words and becomes
    ''. Repeated rows stay, each cut alike. An empty table stays empty. ``docs`` should be a stored
    table: it is read three times, and a task that runs again must find the same rows.
    """
    docs = docs.drop("n_words", "n_removed")
    schema = docs.withColumns(
        {"text": F.lit(""), "n_words": F.lit(0).cast("bigint"), "n_removed": F.lit(0).cast("bigint")}
    ).schema
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, doc_id = (names[docs.columns.index(c)] for c in ("text", "doc_id"))
    # Named by place, so that no name of ``docs`` can clash with those made here.
    plain = docs.toDF(*names).withColumn(text, text_or_empty(text))
    keyed = plain.withColumns(
        {
            "_id": F.coalesce(F.col(doc_id).cast("bigint"), F.lit(int(NO_ID))),
            "_k1": F.xxhash64(text),
            "_k2": F.xxhash64(F.lit(1), F.col(text)),
        }
    )
    found = repeated_spans(keyed.select("_id", "_k1", "_k2", F.col(text).alias("text")), size, limits)
    joined = keyed.join(found, ["_id", "_k1", "_k2"], "left").select(*names, "spans")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_words, n_removed = [], [], []
            texts = batch.column(names.index(text)).cast(pa.binary()).to_pylist()
            for whole, spans in zip(texts, batch.column(len(names)).to_pylist(), strict=True):
                words = whole.split()  # splits bytes at the six ASCII white spaces only
                stay = words
                if spans:
                    edges = [0, *spans, len(words)]
                    stay = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
                kept.append(b" ".join(stay))
                n_words.append(len(words))
                n_removed.append(len(words) - len(stay))
            columns = list(batch.columns[:-1])
            columns[names.index(text)] = pa.array(kept, pa.binary()).cast(pa.string())
            columns += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return joined.mapInArrow(cut, schema)
