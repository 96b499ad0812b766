"""How far the sources of a language diverge in their words.

Every (lang, source) group is a vector of counts over the kept terms of its language, held as a
segment tree over term ids. Trees are hash-consed: equal subtrees, of whatever group and at
whatever place, are one node. Two trees are then walked at the same time from their roots; a pair
of nodes met several times is expanded and priced once, with its multiplicity.

Term ids are dealt to blocks by hash, and a task holds the trees of two tiles of groups over one
block. So no task holds a whole language or a whole group, a frequent word is one id like any
other, and what a task emits is one partial sum per pair of groups.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import LOWER, UPPER, giving_back

#: Bytes of terms: letters, and all bytes of code points beyond ASCII. Others become spaces.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b) in LOWER else ord(chr(b).lower()) if chr(b) in UPPER else 0x20 for b in range(256))
MIN_DOCUMENTS, TOP, UNIT = 3, 200, 10**9
BLOCK_TERMS = 1024  # term ids of a block
TILE_GROUPS = 64    # groups of a tile: a block of two tiles is a matrix of 1 MB
PART_BYTES = 4 << 20  # text whose terms are counted at once
BATCH_ROWS = 50_000   # rows handed back to Spark at once
PRICED = "lang string, ga int, gb int, source string, term string, value bigint"


def term_counts(texts: pa.Array) -> pa.Table:
    """Occurrences ``n`` and documents ``df`` of each term of some texts, each a document."""
    texts = pc.cast(texts, pa.large_string())
    _, offsets, data = texts.buffers()
    spaced = pa.py_buffer((data.to_pybytes() if data else b"").translate(TERM_BYTES))
    # Bytes of other characters stay, so the rewritten texts are UTF-8 again.
    rewritten = pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, spaced], offset=texts.offset)
    split = pc.ascii_split_whitespace(rewritten)
    terms, parents = split.flatten(), pc.list_parent_indices(split)
    real = pc.not_equal(terms, "")  # spaces at the ends of a text
    coded = terms.filter(real).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    document = parents.filter(real).to_numpy(zero_copy_only=False)
    at = np.arange(len(code))
    newest, last = np.zeros(len(coded.dictionary), np.int64), np.zeros(len(code), bool)
    borders = [0, *(np.flatnonzero(np.diff(document)) + 1).tolist(), len(code)]
    for start, end in zip(borders[:-1], borders[1:], strict=True):
        # Of the places of a term in one document, the one written last stays.
        mine = code[start:end]
        newest[mine] = at[start:end]
        last[start:end] = newest[mine] == at[start:end]
    size = len(coded.dictionary)
    n, df = np.bincount(code, minlength=size), np.bincount(code[last], minlength=size)
    return pa.table({"term": coded.dictionary.cast(pa.string()), "n": pa.array(n, pa.int64()), "df": pa.array(df, pa.int64())})


def group_counts(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Occurrences ``n`` and documents ``df`` of each term in each group.

    Tasks add up a batch of documents before anything is shuffled, parts of about ``part_bytes``
    at a time. Each group also has a row with a null term, so that one without any term is there.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple[str, str], list[int]] = {}
            for i, group in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                rows.setdefault(group, []).append(i)
            sizes = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            for (lang, source), mine in rows.items():
                filled = np.cumsum(sizes[mine]) // part_bytes
                cuts = (np.flatnonzero(np.diff(filled)) + 1).tolist()
                parts = [term_counts(batch.column(2).take(pa.array(part))) for part in np.split(np.array(mine), cuts)]
                added = pa.concat_tables(parts)
                if len(parts) > 1:
                    added = added.group_by("term", use_threads=False).aggregate([("n", "sum"), ("df", "sum")])
                    added = added.rename_columns({"n_sum": "n", "df_sum": "df"}).select(["term", "n", "df"])
                head = pa.table({"term": pa.nulls(1, pa.string()), "n": [0], "df": [0]})
                for part in pa.concat_tables([head, added]).to_batches(max_chunksize=BATCH_ROWS):
                    names = [pa.repeat(pa.scalar(x, pa.string()), part.num_rows) for x in (lang, source)]
                    yield pa.RecordBatch.from_arrays([*names, *part.columns], ["lang", "source", "term", "n", "df"])

    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = rows.mapInArrow(giving_back(count), "lang string, source string, term string, n bigint, df bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), by long division so that no product overflows."""
    rest, out = count + 1, np.zeros(np.broadcast(count, total).shape, np.int64)
    for digit in (1, 1000, 1000, 1000):
        rest = rest * digit
        out = out * digit + rest // total
        rest = rest % total
    return out + 1


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Forest:
    """Segment trees over the rows of a count matrix, with equal subtrees as one node.

    ``leaves[i]`` is the count of leaf node i (-1 beyond the block), ``levels[l]`` the (left,
    right) children of the nodes l + 1 steps above the leaves, ``roots`` one node per row.
    """

    def __init__(self, counts: np.ndarray):
        wide = 1 << max(0, int(counts.shape[1] - 1).bit_length())
        padded = np.full((counts.shape[0], wide), -1, np.int64)
        padded[:, : counts.shape[1]] = counts
        self.leaves, nodes = np.unique(padded, return_inverse=True)
        nodes = nodes.reshape(padded.shape)
        self.levels: list[np.ndarray] = []
        while nodes.shape[1] > 1:
            size = int(nodes.max()) + 1
            pairs, above = np.unique(nodes[:, 0::2] * size + nodes[:, 1::2], return_inverse=True)
            self.levels.append(np.stack([pairs // size, pairs % size]))
            nodes = above.reshape(counts.shape[0], -1)
        self.roots = nodes[:, 0]

    def leaf_pairs(self, one: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct leaf pairs met on the walks of row ``one`` with each of ``others``.

        Returned are the place in ``others``, the two counts and how often the pair was met.
        """
        which = np.arange(len(others))
        a, b, times = np.full(len(others), self.roots[one]), self.roots[others], np.ones(len(others), np.int64)
        for children in reversed(self.levels):
            size = int(children.max()) + 1
            met = (which * size + children[:, a]) * size + children[:, b]
            pairs, place = np.unique(met.ravel(), return_inverse=True)
            # Exact: the numbers of visits stay under the size of the block.
            times = np.bincount(place.ravel(), weights=np.concatenate([times, times])).astype(np.int64)
            which, a, b = pairs // size // size, pairs // size % size, pairs % size
        return which, self.leaves[a], self.leaves[b], times


def price_block(rows: pd.DataFrame, tile_groups: int) -> pd.DataFrame:
    """Partial sums of all pairs of one block and two tiles, and the best terms of its groups.

    Rows without a term name the groups of the tiles, with their totals.
    """
    lang, tile_a, tile_b = rows["lang"].iloc[0], int(rows["ta"].iloc[0]), int(rows["tb"].iloc[0])
    heads, cells = rows[rows["term"].isna()].sort_values("g"), rows[rows["term"].notna()]
    group, bound = heads["g"].to_numpy(), heads["bound"].to_numpy()
    at, terms = pd.factorize(cells["term"].to_numpy(object))
    place = np.searchsorted(group, cells["g"].to_numpy())
    # Terms in order of their total: rare ones lie together, where most subtrees are empty.
    total = np.zeros(len(terms), np.int64)
    total[at] = cells["total"].to_numpy()
    order = np.argsort(total, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    # Terms of the block that none of these groups has come first.
    absent = int(heads["terms"].iloc[0]) - len(terms)
    counts = np.zeros((len(group) + 1, absent + len(terms)), np.int64)
    counts[place, absent + rank[at]] = cells["n"].to_numpy()
    counts[-1, absent:] = total[order]
    out: list[tuple] = []
    if counts.shape[1]:
        forest = Forest(counts)
    side, names = group // tile_groups, [""] * absent + terms[order].tolist()
    for i in np.flatnonzero(side == tile_a):
        others = np.flatnonzero((side == tile_b) & (group > group[i]))
        sums = np.zeros((2, len(others)), np.int64)
        if counts.shape[1] and len(others):
            which, a, b, times = forest.leaf_pairs(i, others)
            real = a >= 0
            which, a, b, times = which[real], a[real], b[real], times[real]
            p, q = share(a, bound[i]), share(b, bound[others][which])
            np.add.at(sums[0], which, price(p, q) * times)
            np.add.at(sums[1], which, price(q, p) * times)
        for k, j in enumerate(others):
            out.append((lang, group[i], group[j], None, None, sums[0, k]))
            out.append((lang, group[j], group[i], None, None, sums[1, k]))
        if tile_a == tile_b and len(terms):
            out += best_terms(forest, counts, i, names, (bound[i], heads["lang_bound"].iloc[0]), (lang, group[i]))
    return pd.DataFrame(out, columns=["lang", "ga", "gb", "source", "term", "value"])


def best_terms(
    forest: Forest, counts: np.ndarray, i: int, terms: list[str], bounds: tuple[int, int], group: tuple[str, int]
) -> list[tuple]:
    """The ``TOP`` terms of one group in this block: its tree against that of the language."""
    _, a, b, _ = forest.leaf_pairs(i, np.array([len(counts) - 1]))
    real = a >= 0
    a, b = a[real], b[real]
    p, q = share(a, np.int64(bounds[0])), share(b, np.int64(bounds[1]))
    # The distinct pairs, priced once, are looked up for the terms that have them.
    pair = lambda x, y: np.searchsorted(forest.leaves, x) * len(forest.leaves) + np.searchsorted(forest.leaves, y)
    known = pair(a, b)
    by_key = np.argsort(known)
    found = by_key[np.searchsorted(known[by_key], pair(counts[i], counts[-1]))]
    better = np.flatnonzero((counts[i] > 0) & (p > q)[found])
    values = price(p, q)[found]
    # Python compares strings by code point, which is the order of their UTF-8 bytes.
    best = sorted(better.tolist(), key=lambda t: (-int(values[t]), terms[t]))[:TOP]
    return [(*group, None, None, terms[t], int(values[t])) for t in best]


def audit(docs: DataFrame, *, block_terms: int = BLOCK_TERMS, tile_groups: int = TILE_GROUPS) -> DataFrame:
    """Divergence of each (lang, source) group from the other sources, and its typical terms.

    ``docs`` has ``lang``, ``source`` and ``text``; other columns are ignored, nulls are read as
    ''. A repeated row counts as a document of its own. A language keeps the terms of at least
    ``MIN_DOCUMENTS`` of its documents; without any, its pairs have value 0. A language with one
    source has no pairs. Equal values are ordered by the item's UTF-8 bytes. An empty table
    gives an empty result. All arithmetic is exact while every count is under 9 * 10**15.
    ``block_terms`` and ``tile_groups`` bound what a task holds and don't change results.

    Columns: lang, source, part (``pair`` or ``term``), item, value, rank.
    """
    counted = materialize(group_counts(docs), "group-terms")
    kept = (
        counted.where(F.col("term").isNotNull())
        .groupBy("lang", "term")
        .agg(F.sum("df").alias("df"), F.sum("n").alias("total"))
        .where(F.col("df") >= MIN_DOCUMENTS)
        .drop("df")
    )
    cells = materialize(counted.drop("df").join(kept, ["lang", "term"]), "kept-terms")
    totals = materialize(
        cells.groupBy("lang", "source").agg(F.sum("n").alias("of_group")), "group-totals"
    )
    terms = cells.groupBy("lang", "term").agg(F.max("total").alias("total"))
    langs = terms.groupBy("lang").agg(
        F.count(F.lit(1)).alias("v"),
        F.sum("total").alias("of_lang"),
        F.ceil(F.count(F.lit(1)) / block_terms).cast("int").alias("blocks"),
    )
    numbered = Window.partitionBy("lang").orderBy("source")
    zero = F.lit(0).cast("bigint")
    groups = materialize(
        counted.where(F.col("term").isNull())
        .select("lang", "source")
        .join(totals, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .select(
            "lang",
            "source",
            (F.row_number().over(numbered) - 1).alias("g"),
            (F.coalesce("of_group", zero) + F.coalesce("v", zero)).alias("bound"),
            (F.coalesce("of_lang", zero) + F.coalesce("v", zero)).alias("lang_bound"),
            # A language without any term still has one block, which names its groups.
            F.coalesce("blocks", F.lit(1)).alias("blocks"),
            F.count(F.lit(1)).over(Window.partitionBy("lang")).alias("sources"),
        ),
        "groups",
    )
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    in_block = (
        cells.select("lang", "term").distinct()
        .join(groups.select("lang", "blocks").distinct(), "lang")
        .groupBy("lang", block).agg(F.count(F.lit(1)).alias("terms"))
    )
    tile = F.floor(F.col("g") / tile_groups).cast("int")
    last = F.floor((F.col("sources") - 1) / tile_groups).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), last), lambda t: F.struct(F.least(t, tile).alias("ta"), F.greatest(t, tile).alias("tb"))
    )
    placed = groups.select("*", F.explode(pairs).alias("_pair")).select("*", "_pair.*").drop("_pair")
    shared = ["lang", "block", "ta", "tb", "g", "bound", "lang_bound", "terms", "term", "n", "total"]
    heads = (
        placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .join(in_block, ["lang", "block"], "left")
        .withColumns({"terms": F.coalesce("terms", zero), "term": F.lit(None).cast("string"), "n": zero, "total": zero})
    )
    body = cells.join(placed, ["lang", "source"]).select("*", block, F.lit(None).cast("bigint").alias("terms"))
    priced = materialize(
        heads.select(*shared).unionByName(body.select(*shared))
        .groupBy("lang", "block", "ta", "tb")
        .applyInPandas(lambda rows: price_block(rows, tile_groups), PRICED),
        "priced",
    )
    names = groups.select("lang", F.col("g").alias("ga"), F.col("source").alias("_source"))
    others = groups.select("lang", F.col("g").alias("gb"), F.col("source").alias("item"))
    pair = (
        priced.where(F.col("term").isNull())
        .groupBy("lang", "ga", "gb")
        .agg(F.sum("value").alias("value"))
        .join(others, ["lang", "gb"])
        .select("lang", "ga", F.lit("pair").alias("part"), "item", "value")
    )
    term = priced.where(F.col("term").isNotNull()).select(
        "lang", "ga", F.lit("term").alias("part"), F.col("term").alias("item"), "value"
    )
    best = Window.partitionBy("lang", "ga").orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(best).alias("rank")
    # The cut on the rank is applied by every task before its rows are shuffled.
    both = pair.select("*", ranked).unionByName(term.select("*", ranked).where(F.col("rank") <= TOP))
    return both.join(names, ["lang", "ga"]).select(
        "lang", F.col("_source").alias("source"), "part", "item", "value", "rank"
    )
