"""Removal of lines that many documents share.

Distinct line keys are counted as 128-bit hashes. Those that recur are split over shards by
hash, and each shard is stored as a minimal perfect hash with two arrays in its order: the
fingerprint of the key at that slot, and its count (with the document that keeps the line).
Documents are then read once more and probe the arrays, shard by shard: neither lines nor
texts are shuffled to find out what goes.
"""

from __future__ import annotations

import io
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, new_path
from .common import SPACE, ascii_lower, giving_back, open_folder, parts, shared_file, text_or_empty

MIN_LENGTH, MIN_DOCUMENTS = 40, 5
SHARD_KEYS = 1 << 18       # keys of a shard: some 6 MB of arrays
CACHED_SHARDS = 16         # shards a task holds at most
SLOTS_PER_KEY = 2.0        # bits per remaining key at each level of the hash
NO_ID = np.iinfo(np.int64).min
SEED = 42                  # of Spark's xxhash64


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """An independent 64-bit hash of 64-bit hashes for each level."""
    with np.errstate(over="ignore"):
        x = keys ^ (np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash: each of n distinct keys gets its own number below n.

    Level by level, keys that fall alone into a slot of a bit array stay there; the others go
    on to the next level. A key's number is the rank of its bit. Other keys get any number or
    none, which their fingerprint tells.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = []
        base = 0
        for bits in levels:
            counts = np.cumsum(bits, dtype=np.int64)
            self.ranks.append(base + counts - bits)
            base += int(counts[-1]) if len(counts) else 0

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            size = max(64, int(len(left) * SLOTS_PER_KEY))
            slots = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(slots, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[slots]]
        return cls(levels)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 where no level has its bit."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            slots = (_mix(keys[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[slots]
            out[open_[hit]] = ranks[slots[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


def pack_shard(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> bytes:
    hashed = PerfectHash.build(h1)
    number = hashed.numbers(h1)
    order = np.empty(len(h1), np.int64)
    order[number] = np.arange(len(h1))
    out = io.BytesIO()
    np.savez(
        out,
        fingerprints=h2[order],
        counts=counts[order].clip(max=2**32 - 1).astype(np.uint32),
        keepers=keepers[order],
        sizes=np.array([len(b) for b in hashed.levels], np.int64),
        bits=np.packbits(np.concatenate([*hashed.levels, np.zeros(0, bool)])),
    )
    return out.getvalue()


class Shard:
    def __init__(self, blob: bytes):
        data = np.load(io.BytesIO(blob))
        sizes = data["sizes"]
        bits = np.unpackbits(data["bits"])[: int(sizes.sum())].astype(bool)
        self.hash = PerfectHash(np.split(bits, np.cumsum(sizes)[:-1]) if len(sizes) else [])
        self.fingerprints, self.keepers = data["fingerprints"], data["keepers"]
        self.counts = data["counts"]

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and keeping document of each key; count 0 if the shard doesn't have it."""
        number = self.hash.numbers(h1)
        known = number >= 0
        known[known] = self.fingerprints[number[known]] == h2[known]
        counts = np.zeros(len(h1), np.int64)
        keepers = np.full(len(h1), NO_ID)
        counts[known] = self.counts[number[known]]
        keepers[known] = self.keepers[number[known]]
        return counts, keepers


def line_counts(docs: DataFrame, min_length: int, min_documents: int) -> DataFrame:
    """128-bit hash, number of documents and largest id of the keys that recur."""
    lines = F.split(text_or_empty(), "\n", -1)
    keys = F.transform(lines, lambda x: ascii_lower(F.btrim(x, F.lit(SPACE))))
    keys = F.array_distinct(F.filter(keys, lambda x: F.char_length(x) >= min_length))
    ids = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    return (
        docs.select(ids.alias("_id"), F.explode(keys).alias("_key"))
        .groupBy(F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit(1), F.col("_key")).alias("h2"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("_id").alias("keeper"))
        .where(F.col("n") >= min_documents)
    )


def build_shards(
    counted: DataFrame, shard_keys: int = SHARD_KEYS
) -> list[str]:
    """Files with the shards' arrays, in order of the shard number.

    What comes back to the driver is one path per ``shard_keys`` recurring lines.
    """
    spark = counted.sparkSession
    stored = materialize(counted, "lines")
    shards = max(1, -(-stored.count() // shard_keys))
    folder = new_path(spark, "line-shards")

    def build(group: pd.DataFrame) -> pd.DataFrame:
        # Equal first halves of different keys (rare) can't share a slot: numbered apart.
        h1, h2 = (group[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2"))
        _, first = np.unique(h1, return_index=True)
        extra = np.setdiff1d(np.arange(len(h1)), first)
        system, path, _ = shared_file(folder, "shard")
        blobs = [
            pack_shard(h1[i], h2[i], group["n"].to_numpy()[i], group["keeper"].to_numpy()[i])
            for i in [first, *([[j] for j in extra.tolist()])]
        ]
        with system.open_output_stream(path) as out:
            out.write(np.array([len(blobs), *map(len, blobs)], "<i8").tobytes() + b"".join(blobs))
        return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "path": [path]})

    keyed = stored.withColumn("shard", F.pmod(F.shiftrightunsigned("h1", 20), F.lit(shards)))
    built = keyed.groupBy("shard").applyInPandas(build, "shard bigint, path string")
    paths = {r["shard"]: r["path"] for r in materialize(built, "shards").collect()}
    return [paths.get(i, "") for i in range(shards)]


class Shards:
    """Reads shards as they are asked for; at most ``CACHED_SHARDS`` are held."""

    def __init__(self, folder: str, paths: list[str]):
        self.system, self.paths = open_folder(folder)[0], paths
        self.held: OrderedDict[int, list[Shard]] = OrderedDict()

    def get(self, number: int) -> list[Shard]:
        if number not in self.held:
            with self.system.open_input_stream(self.paths[number]) as f:
                data = f.readall()
            sizes = np.frombuffer(data, "<i8", int.from_bytes(data[:8], "little"), 8)
            ends = np.cumsum(sizes) + 8 + 8 * len(sizes)
            self.held[number] = [Shard(data[e - n : e]) for e, n in zip(ends, sizes, strict=True)]
            if len(self.held) > CACHED_SHARDS:
                self.held.popitem(last=False)
        self.held.move_to_end(number)
        return self.held[number]

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, keepers = np.zeros(len(h1), np.int64), np.full(len(h1), NO_ID)
        number = ((h1 >> np.uint64(20)) % np.uint64(len(self.paths))).astype(np.int64)
        order = np.argsort(number, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
            if len(part) and self.paths[shard := int(number[part[0]])]:
                for arrays in self.get(shard):
                    n, keeper = arrays.probe(h1[part], h2[part])
                    found = n > 0
                    counts[part[found]], keepers[part[found]] = n[found], keeper[found]
        return counts, keepers


def _second_seed(spark: SparkSession) -> int:
    """The seed that makes a plain XXH64 equal to ``xxhash64(1, text)``."""
    return spark.range(1).select(F.xxhash64(F.lit(1)).alias("s")).first()["s"] % (1 << 64)


def drop_shared_lines(
    docs: DataFrame,
    *,
    min_length: int = MIN_LENGTH,
    min_documents: int = MIN_DOCUMENTS,
    shard_keys: int = SHARD_KEYS,
) -> DataFrame:
    """All rows and columns of ``docs``; ``text`` without shared lines, ``n_lines``, ``n_dropped``.

    A line's key is the line without white space at both ends, A-Z in lower case. Keys of at
    least ``min_length`` code points that ``min_documents`` rows hold lose all their lines but
    in the rows of the largest ``doc_id`` among them. A null or empty text is one empty line. A
    repeated row counts as a document of its own; a null id is smaller than any other (and a
    key held by such rows alone stays in them). Columns of ``docs`` that are called ``n_lines``
    or ``n_dropped`` are replaced. An empty table stays empty.
    """
    spark = docs.sparkSession
    paths = build_shards(line_counts(docs, min_length, min_documents), shard_keys)
    folder = new_path(spark, "line-shards")
    second = _second_seed(spark)
    docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    schema = docs.withColumns(
        {"n_lines": F.lit(0).cast("bigint"), "n_dropped": F.lit(0).cast("bigint"), "text": F.lit("").cast("string")}
    ).schema

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(folder, paths)
        for batch in parts(batches):
            texts = batch.column(names.index("text")).to_pylist()
            ids = batch.column(names.index("doc_id")).cast(pa.int64()).fill_null(NO_ID)
            split = [(t or "").split("\n") for t in texts]
            row_of, line_of, h1, h2 = [], [], [], []
            for row, lines in enumerate(split):
                for k, line in enumerate(lines):
                    if len(line) >= min_length and len(key := line.strip(SPACE)) >= min_length:
                        data = key.encode().lower()
                        row_of.append(row)
                        line_of.append(k)
                        h1.append(xxhash.xxh64_intdigest(data, SEED))
                        h2.append(xxhash.xxh64_intdigest(data, second))
            counts, keepers = shards.probe(np.array(h1, np.uint64), np.array(h2, np.uint64))
            owner = ids.to_numpy(zero_copy_only=False)[np.array(row_of, np.int64)]
            go = np.flatnonzero((counts >= min_documents) & (keepers != owner))
            gone: dict[int, set[int]] = {}
            for i in go.tolist():
                gone.setdefault(row_of[i], set()).add(line_of[i])
            kept = list(texts)
            for row, drop in gone.items():
                kept[row] = "\n".join(x for k, x in enumerate(split[row]) if k not in drop)
            new = {
                "text": pa.array(["" if t is None else t for t in kept], pa.string()),
                "n_lines": pa.array([len(x) for x in split], pa.int64()),
                "n_dropped": pa.array([len(gone.get(r, ())) for r in range(len(split))], pa.int64()),
            }
            columns = dict(zip(names, batch.columns, strict=True)) | new
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(giving_back(probe), schema)
