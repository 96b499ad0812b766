"""Near-duplicate join: Jaccard similarity of word shingles, candidates pruned by a posterior.

1. Each text becomes the set of its shingles and a MinHash signature of it; texts with equal
   sets are one node from here on.
2. Nodes that share a band of their signatures are compared value by value. After each ``STEP``
   values the posterior probability that the pair reaches the threshold (uniform prior) is
   looked up, and the pair goes if it is under ``tolerance``. Survivors are joined to candidate
   groups. Bands that hold the same nodes as another are left out, and a large band group is
   compared across its blocks only where blocks and hub did not join it already.
3. Inside each candidate group all pairs are verified exactly on the shingle sets.

No step emits the pairs of a group: a task compares at most two blocks of ``block`` nodes and
returns one row per node, so large groups cost row counts that are linear in them (times the
number of their blocks) and bounded memory. Many small groups are compared at once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from ..session import materialize, scratch
from .common import borders, giving_back, likely_in, runs, split_likely, text_or_empty

SHINGLE, THRESHOLD = 5, 0.8
VALUES, BAND = 128, 4       # 32 bands of 4 values: a pair at 0.8 shares none with 5e-8
STEP, TOLERANCE = 16, 1e-6
BLOCK = 512
CHUNK = 1 << 20             # bytes of text whose words are hashed at once
GOLDEN = np.uint64(0x9E3779B97F4A7C15)

_random = np.random.Generator(np.random.PCG64(5))
FACTORS = _random.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = _random.integers(0, 1 << 32, VALUES, dtype=np.uint32)


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """Per text the sorted hashes of its runs of ``shingle`` words; a shorter text is one shingle
    of all its words, a text without words has none. Words are hashed for many texts at once."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + CHUNK, side="right")))
        yield from chunk_sets(texts.slice(at, stop - at), shingle)
        at = stop


def chunk_sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = split.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    held = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    cuts = split.offsets.to_numpy()
    starts = held[cuts - cuts[0]]
    coded = words.filter(real).dictionary_encode()
    known = coded.dictionary.to_numpy(zero_copy_only=False)
    hashed = pd.util.hash_array(known, categorize=False) if len(known) else np.empty(0, np.uint64)
    hashed = hashed[coded.indices.to_numpy()]
    whole = rolled(hashed, shingle)
    for first, last in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if last - first >= shingle:
            yield np.unique(whole[first : last - shingle + 1])
        else:
            yield rolled(hashed[first:last], last - first)


def rolled(hashed: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    out = np.zeros(max(len(hashed) - width + 1, 0) if width else 0, np.uint64)
    for k in range(width):
        out = scramble(out * GOLDEN + hashed[k : k + len(out)] + np.uint64(width))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of the smallest of each hash function's values; a long set is read in parts."""
    low = np.full(VALUES, np.iinfo(np.uint32).max, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 4096):
        part = short[at : at + 4096]
        low = np.minimum(low, (part[None, :] * FACTORS[:, None] + OFFSETS[:, None]).min(axis=1))
    return scramble(low.astype(np.uint64)).astype(np.uint16)


def fewest_matches(threshold: float, tolerance: float, step: int = STEP) -> list[tuple[int, int]]:
    """(values compared, fewest matches to go on): with m of n matching, the posterior is
    Beta(m + 1, n - m + 1), and its mass above the threshold is a binomial sum."""
    out = []
    for n in range(step, VALUES + 1, step):
        mass, m = 0.0, -1
        while m < n and mass < tolerance:
            m += 1
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def linked_roots(
    starts: np.ndarray, sizes: np.ndarray, values: np.ndarray, bounds: list[tuple[int, int]]
) -> np.ndarray:
    """Per row the first row of the rows of its group that surviving pairs join to it.

    Groups are runs of rows. Each round compares one row of every group with all rows of the
    group not reached yet: a reached row if there is one, else the next row as a new start. A
    row that was reached is not compared with as a target again: enough to connect.
    """
    n = int(sizes.sum())
    group = np.repeat(np.arange(len(sizes)), sizes)
    root, state = np.arange(n), np.zeros(n, np.int8)  # 0 not reached, 1 reached, 2 compared
    live = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while len(live):
        first = np.flatnonzero(np.append(True, group[live][1:] != group[live][:-1]))
        probe = np.minimum.reduceat(live + n * (state[live] == 0), first) % n
        state[probe] = 2
        one = np.repeat(probe, np.diff(np.append(first, len(live))))
        left = state[live] == 0
        row, one = live[left], one[left]
        matches, done = np.zeros(len(row), np.int64), 0
        for at, fewest in bounds:
            matches = matches + (values[row, done:at] == values[one, done:at]).sum(axis=1)
            stays = matches >= fewest
            row, one, matches, done = row[stays], one[stays], matches[stays], at
            if not len(row):
                break
        state[row], root[row] = 1, root[one]
        waits = np.bincount(group[live], weights=state[live] == 0, minlength=len(sizes)) > 0
        live = live[(state[live] < 2) & waits[group[live]]]
    return root


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id (and ``_key``, if there), digest of the shingle set, and the signature of sets that
    are not empty."""
    kept = [c for c in ("doc_id", "_key") if c in docs.columns]

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, values = [], []
            for found in shingle_sets(batch.column("text"), shingle):
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                values.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, kept), pa.array(digests, pa.binary()), pa.array(values, pa.binary())],
                [*kept, "digest", "signature"],
            )

    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in kept)
    rows = docs.select(*kept, text_or_empty().alias("text"))
    return rows.mapInArrow(giving_back(sketch), f"{kinds}digest binary, signature binary")


def block_pairs(members: DataFrame, group: list[str], block: int) -> DataFrame:
    """``members`` dealt to tasks ``(_group, _left, _right)`` so that each pair of a group meets
    in exactly one of them; ``_side`` is the block a row is from. Groups of one are left out."""
    sizes = members.groupBy(*group).agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    blocks = F.ceil(F.col("_size") / block).cast("int")
    # A row's block does not depend on its partition, so a lost task gives the same rows again.
    side = F.pmod(F.xxhash64("node"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return (
        members.join(sizes, group)
        .withColumns({"_blocks": blocks, "_side": side})
        .select("*", other.alias("_other"))
        .withColumns({"_left": F.least("_side", "_other"), "_right": F.greatest("_side", "_other")})
        .drop("_size", "_blocks", "_other")
    )


def band_groups(nodes: DataFrame) -> DataFrame:
    """(key, node, _size, _hub): the nodes that share a band, one band for each set of nodes.

    Groups are told apart by their number of nodes, smallest node and the XOR of hashes of the
    nodes, so that bands shared by just the same nodes are compared once.
    """
    band = lambda b: F.xxhash64(b, F.substring(F.col("signature"), b * (2 * BAND) + 1, F.lit(2 * BAND)))
    keys = F.transform(F.sequence(F.lit(0), F.lit(VALUES // BAND - 1)), band)
    banded = nodes.where("signature is not null").select("node", F.explode(keys).alias("key"))
    groups = banded.groupBy("key").agg(
        F.count(F.lit(1)).alias("_size"), F.min("node").alias("_hub"), F.bit_xor(F.xxhash64("node")).alias("_nodes")
    )
    chosen = groups.where("_size > 1").groupBy("_size", "_hub", "_nodes").agg(F.min("key").alias("key")).drop("_nodes")
    return materialize(banded.join(chosen, "key"), "band-groups")


def candidate_edges(nodes: DataFrame, bounds: list[tuple[int, int]], block: int) -> DataFrame:
    """(node, root): per band group, nodes joined by pairs that survive the posterior.

    First each block of a group by itself, with the group's hub (its smallest node) in every
    block. A group of several blocks that this leaves in several parts is then compared across
    blocks, but for pairs of nodes that are both joined to the hub.
    """
    rows, values = band_groups(nodes), nodes.select("node", "signature")
    blocks = lambda size: F.ceil(size / block).cast("bigint")
    # A row's block does not depend on its partition, so a lost task gives the same rows again.
    dealt = rows.where("node <> _hub").select("node", "key", F.pmod(F.xxhash64("node"), blocks(F.col("_size"))).alias("_left"))
    hubs = rows.where("node = _hub").select("node", "key", F.explode(F.sequence(F.lit(0), blocks(F.col("_size")) - 1)).alias("_left"))
    inside = materialize(joined(dealt.unionByName(hubs).withColumn("_right", F.lit(-1)), values, bounds), "inside")
    large = rows.where(F.col("_size") > block)
    if large.isEmpty():
        return inside
    label = components(inside)
    large = materialize(
        large.join(label, "node", "left")
        .join(label.select(F.col("node").alias("_hub"), F.col("label").alias("_hub_label")), "_hub", "left")
        .select("key", "node", F.coalesce(F.col("label") == F.col("_hub_label"), F.col("node") == F.col("_hub")).alias("_in")),
        "large",
    )
    sizes = large.groupBy("key").agg(F.count_if("_in").alias("_n"), F.count_if(~F.col("_in")).alias("_m")).where("_m > 0")
    parts = large.join(sizes, "key").withColumns({"_n": blocks(F.col("_n")), "_m": blocks(F.col("_m"))})
    mine = lambda count: F.pmod(F.xxhash64("node"), F.col(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))
    hub, rest = parts.where("_in"), parts.where("not _in")
    # Blocks of the hub's part are numbered down from -1, all others up from 0.
    across = hub.select("node", "key", (-1 - mine("_n")).alias("_left"), every("_m").alias("_right")).unionByName(
        rest.select("node", "key", mine("_m").alias("_right"), every("_n").alias("_o")).select("node", "key", (-1 - F.col("_o")).alias("_left"), "_right")
    )
    among = rest.select("node", "key", mine("_m").alias("_s"), every("_m").alias("_o")).select(
        "node", "key", F.least("_s", "_o").alias("_left"), F.greatest("_s", "_o").alias("_right")
    )
    return inside.unionByName(joined(across.unionByName(among), values, bounds)).distinct()


def joined(rows: DataFrame, values: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """(node, root) within each ``key, _left, _right``; many small groups are compared at once."""
    keys = ["key", "_left", "_right"]

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, keys):
            cuts = borders(table, keys)
            starts = np.array([a for a, _ in cuts])
            sizes = np.array([b - a for a, b in cuts])
            node = table.column("node").to_numpy()
            held = b"".join(table.column("signature").to_pylist())
            root = linked_roots(starts, sizes, np.frombuffer(held, np.uint16).reshape(len(node), VALUES), bounds)
            moved = np.flatnonzero(root != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], ["node", "root"])

    sorted_ = rows.join(values, "node").repartition(*keys).sortWithinPartitions(*keys, "node")
    return sorted_.select(*keys, "node", "signature").mapInArrow(giving_back(link), "node bigint, root bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of an edge; the label is the smallest node of the component.

    Alternates large-star and small-star steps, each a minimum per node joined back to the
    edges, until the edges stay as they are. Each round is a table in the shared folder.
    """
    now = materialize(
        edges.where("node <> root")
        .select(F.greatest("node", "root").alias("u"), F.least("node", "root").alias("v"))
        .distinct(),
        "edges",
    )
    mark = None
    while True:
        rows = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(rows) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        mark = tuple(rows)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = materialize(both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
            .where("u <> v")
            .distinct()
        )
        now = materialize(small, "edges")


def verified_links(members: DataFrame, docs: DataFrame, threshold: float, shingle: int, block: int) -> DataFrame:
    """(node, root, links) per pair of blocks: exact links of each node with at least one."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for s in shingle_sets(batch.column("text"), shingle)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("label"), pa.array(found, pa.binary())], ["node", "label", "shingles"]
            )

    texts = members.join(docs, "node").mapInArrow(giving_back(sets), "node bigint, label bigint, shingles binary")
    tasks = block_pairs(materialize(texts, "sets"), ["label"], block)

    keys = ["label", "_left", "_right"]

    def links(group: pa.Table) -> pa.RecordBatch:
        node, side = group.column("node").to_numpy(), group.column("_side").to_numpy()
        one_block = group.column("_left")[0] == group.column("_right")[0]
        each = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in each])
        distinct, codes = np.unique(np.concatenate(each), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        count, low = np.zeros(len(node), np.int64), np.arange(len(node))
        present = np.zeros(len(distinct), np.int32)

        def find(k: int) -> int:
            while low[k] != k:
                low[k] = low[low[k]]
                k = low[k]
            return k

        for i in range(len(node)):
            mine = codes[starts[i] : starts[i] + sizes[i]]
            present[mine] = 1
            shared = np.add.reduceat(present[codes], starts)
            present[mine] = 0
            near = shared >= threshold * (sizes + sizes[i] - shared) - 1e-9
            near[: i + 1] = False
            if not one_block:
                near &= side != side[i]
            hits = np.flatnonzero(near)
            count[i] += len(hits)
            count[hits] += 1
            for j in hits:
                a, b = find(i), find(int(j))
                low[max(a, b)] = min(a, b)
        has = np.flatnonzero(count)
        root = node[[find(int(k)) for k in has]] if len(has) else node[:0]
        return pa.RecordBatch.from_arrays([pa.array(node[has]), pa.array(root), pa.array(count[has])], ["node", "root", "links"])

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, keys):
            for first, last in borders(table, keys):
                yield links(table.slice(first, last - first))

    sorted_ = tasks.repartition(*keys).sortWithinPartitions(*keys, "node")
    return sorted_.select(*keys, "node", "_side", "shingles").mapInArrow(giving_back(verify), "node bigint, root bigint, links bigint")


def near_duplicates(
    docs: DataFrame,
    *,
    threshold: float = THRESHOLD,
    shingle: int = SHINGLE,
    tolerance: float = TOLERANCE,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, links, copies``.

    Two texts are linked if the Jaccard similarity of their sets of ``shingle`` words (ASCII
    lower case) is at least ``threshold``; a class is a connected component, named by its smallest
    ``doc_id``. ``links`` counts the other different sets linked to the row's, ``copies`` the
    rows with the same set. Texts without words (null, empty, blank) are copies of each other. A
    row without id is in the class and counts of its text; a class only of such rows has no id.
    Other columns are not read. An empty table gives an empty result.

    A pair at the threshold is missed if it shares no band (5e-8) or is pruned (under
    ``tolerance`` by the posterior), and even then only if no chain of other pairs joins it.
    """
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sketched, per_set = classified(ids, threshold, shingle, tolerance, block)
    return sketched.select("doc_id", "digest").join(per_set, "digest").select("doc_id", "class_id", "links", "copies")


def classified(
    ids: DataFrame, threshold: float, shingle: int, tolerance: float, block: int
) -> tuple[DataFrame, DataFrame]:
    """The sketch of each row of ``ids``, and per set ``digest, label, class_id, links, copies``.

    ``label`` tells classes apart, also where they have the same ``class_id`` (an id that
    repeats) or none. If ``ids`` has a column ``_key``, a key of its rows, texts are found by it.
    """
    sketched = materialize(sketches(ids, shingle), "sketches")
    # One node per set. Its number is stored with it, so it stays the same at each reading.
    named = sketched.groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.min("signature").alias("signature")
    )
    nodes = materialize(named.withColumn("node", F.monotonically_increasing_id()), "nodes")
    bounds = fewest_matches(threshold, tolerance)
    groups = components(candidate_edges(nodes, bounds, block))
    # The text of each node that is in a group: one row of the node's digest.
    members = groups.join(nodes.select("node", "digest", "first"), "node")
    if "_key" in ids.columns:
        chosen = sketched.join(members.select("node", "digest"), "digest").groupBy("node").agg(F.min("_key").alias("_key"))
        chosen = materialize(chosen, "chosen")
        rows = likely_in(ids.select("_key", text_or_empty().alias("text")), "_key", chosen, "_key")
        texts = rows.join(chosen, "_key").select("node", "text")
    else:
        chosen = (
            sketched.select("doc_id", "digest")
            .join(members.select("node", "digest", "first"), "digest")
            .where(F.col("doc_id").eqNullSafe(F.col("first")))
            .select("doc_id", "digest", "node")
            .distinct()
        )
        texts = texts_of(ids, materialize(chosen, "chosen"), shingle)
    found = materialize(verified_links(groups, texts, threshold, shingle, block), "links")
    classes = components(found.select("node", "root"))
    totals = found.groupBy("node").agg(F.sum("links").alias("links"))
    labelled = nodes.select("digest", "first", "copies", "node").join(totals, "node", "left").join(
        classes, "node", "left"
    )
    labelled = labelled.withColumn("label", F.coalesce("label", "node"))
    smallest = labelled.groupBy("label").agg(F.min("first").alias("class_id"))
    return sketched, labelled.join(smallest, "label").select(
        "digest", "label", "class_id", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"), "copies"
    )


def texts_of(ids: DataFrame, chosen: DataFrame, shingle: int) -> DataFrame:
    """(node, text), one per node. Only rows with a repeated id need their digest checked."""

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [
                hashlib.blake2b(found.tobytes(), digest_size=16).digest() == digest
                for found, digest in zip(shingle_sets(batch.column("text"), shingle), batch.column("digest").to_pylist(), strict=True)
            ]
            yield batch.filter(pa.array(same, pa.bool_())).select(["node", "text"])

    wanted = chosen.withColumnRenamed("doc_id", "_id")
    rows = likely_in(ids.select("doc_id", text_or_empty().alias("text")), "doc_id", wanted, "_id").join(
        wanted, F.col("doc_id").eqNullSafe(F.col("_id"))
    )
    return (
        rows.select("node", "digest", "text")
        .mapInArrow(giving_back(check), "node bigint, text string")
        .dropDuplicates(["node"])
    )


def one_of_each(
    docs: DataFrame,
    *,
    threshold: float = THRESHOLD,
    shingle: int = SHINGLE,
    tolerance: float = TOLERANCE,
    block: int = BLOCK,
) -> DataFrame:
    """``docs`` with one row of each class: the one of the smallest id (ties: smallest text, then
    the smallest other columns).

    Columns stay as they are. Rows without id come after all others of their class; a class only
    of such rows keeps one of them. Ids may repeat: rows are told apart by a key stored with them.
    Only the keyed rows and the keys of those that go stay in the shared folder.
    """
    key = "_key"
    while key in docs.columns:
        key += "_"
    keyed = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    ids = keyed.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col(key).alias("_key"))
    with scratch(docs.sparkSession) as keep:
        sketched, sets = classified(ids, threshold, shingle, tolerance, block)
        # The rows of each class with its smallest id; class_id is null where no row has one.
        first = materialize(
            sketched.select("doc_id", "_key", "digest")
            .join(sets.select("digest", "label", "class_id"), "digest")
            .where(F.col("doc_id").eqNullSafe(F.col("class_id")))
            .select("label", F.col("_key").alias(key)),
            "first",
        )
        counted = first.groupBy("label").agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_one"))
        tied = first.join(counted.where("_n > 1").select("label"), "label").select(F.col("label").alias("_label"), key)
        others = [f.name for f in docs.schema if f.name not in ("doc_id", "text") and isinstance(f.dataType, AtomicType)]
        least = (
            keyed.join(tied, key)
            .groupBy("_label")
            .agg(F.min(F.struct("text", *others, key))[key].alias("_one"))
            .select("_one")
        )
        keepers = counted.where("_n = 1").select("_one").unionByName(least)
        # The rows that go are fewer than those that stay: only rows that may be among them are joined.
        gone = keep(sketched.select("_key").join(keepers, F.col("_key") == F.col("_one"), "left_anti"), "gone")
    likely, sure = split_likely(keyed, key, gone, "_key")
    staying = likely.join(gone.select(F.col("_key").alias(key)), key, "left_anti").select(*keyed.columns)
    return sure.unionByName(staying).select(*docs.columns)
