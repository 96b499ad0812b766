"""SimHash fingerprints and the search for close ones, on built-in functions only.

A term is a word with the words after it (``SHINGLE`` in all, fewer at the end of a text). Each
occurrence votes with the signed bits of the term's hash, so a term weighs as much as it is
frequent; the majority of each bit is the fingerprint. Fingerprints within a Hamming radius are
found with permuted block tables: of ``blocks`` blocks of bits, at most ``radius`` differ, so some
``blocks - radius`` of them are equal and serve as an equality key, one table per choice.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, text_or_empty

SHINGLE = 3
RADIUS = 3
HALVES = 2              # a fingerprint is this many 64-bit halves
BITS = 64 * HALVES
LANES = (1 << 32) | 1   # bits j and j + 32 of a hash, counted in one sum


def term_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    words = F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))
    first = F.transform(words, lambda w: F.xxhash64(w))
    out = first
    for k in range(1, shingle):
        out = F.zip_with(
            out, F.slice(first, F.lit(k + 1), F.greatest(F.size(first) - k, F.lit(0))),
            lambda a, b: F.xxhash64(a, b),
        )
    return out


def votes(term: str = "_term") -> list[Column]:
    """Sums over terms from which ``majority`` takes the fingerprint."""
    sums = [F.count(term).alias("_n")]
    for half in range(HALVES):
        h = F.col(term)
        if half:  # a hash is never null, so a missing term must be kept out
            h = F.when(h.isNotNull(), F.xxhash64(h, F.lit(half)))
        lanes = [F.shiftrightunsigned(h, j).bitwiseAND(F.lit(LANES)) for j in range(32)]
        sums += [F.sum(v).alias(f"_v{half}_{j}") for j, v in enumerate(lanes)]
    return sums


def majority() -> list[Column]:
    """The 64-bit halves; a bit is set if more than half of the votes are for it. No term: 0."""
    halves = []
    for half in range(HALVES):
        out = F.lit(0).cast("bigint")
        for j in range(32):
            both = F.coalesce(F.col(f"_v{half}_{j}"), F.lit(0).cast("bigint"))
            for bit, count in ((j, both.bitwiseAND(F.lit(0xFFFFFFFF))), (j + 32, F.shiftrightunsigned(both, 32))):
                ballot = F.when(count * 2 > F.col("_n"), F.shiftleft(F.lit(1).cast("bigint"), bit))
                out = out.bitwiseOR(F.coalesce(ballot, F.lit(0).cast("bigint")))
        halves.append(out.alias(f"_h{half}"))
    return halves


def hexadecimal(halves: list[Column]) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in halves]))


def likeness(a: list[Column], b: list[Column]) -> Column:
    """Share of equal bits."""
    differing = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)), F.lit(0))
    return F.lit(1.0) - differing / F.lit(float(BITS))


def fingerprint_texts(rows: DataFrame, keys: list[str], text: str, shingle: int = SHINGLE) -> DataFrame:
    """``keys`` and the halves ``_h0, _h1`` of each row's text; ``keys`` tell the rows apart."""
    terms = rows.select(*keys, F.explode_outer(term_hashes(text_or_empty(text), shingle)).alias("_term"))
    return terms.groupBy(*keys).agg(*votes()).select(*keys, *majority())


def order_buckets(docs: DataFrame, buckets: int) -> Column:
    """Number of the range of ``doc_id`` a row is in; about equal numbers of rows in each."""
    at = [i / buckets for i in range(1, buckets)]
    if not at:
        return F.lit(0)
    cuts = docs.agg(F.percentile_approx("doc_id", at, 100 * buckets).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    if not cuts:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("doc_id"))), F.lit(0))


def fingerprint_edits(docs: DataFrame, *, shingle: int = SHINGLE, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last half replaced by the beginning of the next document's text, in
    the order of ``doc_id`` (null first; equal ids by text); the first follows the last. Null
    text is empty; a text without words has fingerprint 0; repeated rows each give a row; an
    empty table gives none. Only ``doc_id`` and ``text`` are read.

    Rows are dealt once, by ranges of ``doc_id``. Each range also gets the first row of the
    range after it, so the next document is always in the same task.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = order_buckets(rows, n)
    # One row per range: its first id. At most ``n`` rows, as many as there are ranges.
    firsts = [
        (r["b"], r["first"], r["null"])
        for r in rows.groupBy(bucket.alias("b"))
        .agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("null"))
        .orderBy("b")
        .collect()
    ]
    # Array lookups: a chain of conditions, one per range, would nest too deep to be planned.
    before = F.array(*[F.lit(int(firsts[k - 1][0])) for k in range(len(firsts))])
    first_ids = F.array(*[F.lit(first).cast("bigint") for _, first, null in firsts])
    at = F.array_position(first_ids, F.col("doc_id").cast("bigint"))
    halo = F.when(at > 0, F.get(before, (at - 1).cast("int")))
    if firsts and firsts[0][2]:  # rows without id come first
        wrap = F.lit(int(firsts[-1][0]))
        halo = F.when(F.col("doc_id").isNull(), wrap).when(at > 1, F.get(before, (at - 1).cast("int")))
    places = F.filter(
        F.array(
            F.struct(bucket.cast("int").alias("b"), F.lit(0).alias("lap")),
            F.struct(halo.alias("b"), F.lit(1).alias("lap")),
        ),
        lambda p: p["b"].isNotNull(),
    )
    dealt = rows.select("doc_id", "text", F.explode(places).alias("p")).select(
        "doc_id", "text", F.col("p.b").alias("_b"), F.col("p.lap").alias("_lap")
    )
    order = Window.partitionBy("_b").orderBy("_lap", F.col("doc_id").asc_nulls_first(), "text")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.length("text") - half),
        F.substring(F.coalesce(F.col("_next"), F.lit("")), F.lit(1), half),
    )
    pairs = (
        dealt.withColumn("_next", F.lead("text").over(order))
        .withColumn("_row", F.row_number().over(order))
        .select("_b", "_row", "_lap", "doc_id", "text", edited.alias("_edited"))
        .select(
            "_b", "_row", "_lap", "doc_id", F.length("text").cast("bigint").alias("n_chars"),
            F.sha2("_edited", 256).alias("edited_sha256"),
            F.posexplode(F.array("text", "_edited")).alias("_kind", "_text"),
        )
    )
    keys = ["_b", "_row", "_lap", "doc_id", "n_chars", "edited_sha256", "_kind"]
    prints = fingerprint_texts(pairs, keys, "_text", shingle)
    both = prints.groupBy(*keys[:-1]).agg(
        *[
            F.max(F.when(F.col("_kind") == k, F.col(f"_h{h}"))).alias(f"{name}{h}")
            for k, name in ((0, "_own"), (1, "_edit"))
            for h in range(HALVES)
        ]
    )
    by_row = Window.partitionBy("_b").orderBy("_row")
    own = [F.col(f"_own{h}") for h in range(HALVES)]
    edit = [F.col(f"_edit{h}") for h in range(HALVES)]
    after = [F.lead(c).over(by_row) for c in own]
    return (
        both.select(
            "doc_id", "n_chars", "edited_sha256", "_lap",
            hexadecimal(own).alias("fingerprint"), hexadecimal(edit).alias("edited_fingerprint"),
            likeness(own, edit).alias("near_edited"), likeness(own, after).alias("near_next"),
        )
        .where("_lap = 0")
        .drop("_lap")
    )


def block_keys(fingerprint: Column, radius: int, blocks: int) -> Column:
    """The keys of a hexadecimal fingerprint in all block tables, as (table, key)."""
    digits = BITS // 4
    cuts = [digits * k // blocks for k in range(blocks + 1)]
    part = [F.substring(fingerprint, cuts[k] + 1, cuts[k + 1] - cuts[k]) for k in range(blocks)]
    return F.array(
        *[
            F.struct(F.lit(t).alias("table"), F.concat(*[part[k] for k in chosen]).alias("key"))
            for t, chosen in enumerate(combinations(range(blocks), blocks - radius))
        ]
    )


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two hexadecimal fingerprints."""
    parts = [
        F.bit_count(F.conv(F.substring(a, k, 8), 16, 10).cast("bigint").bitwiseXOR(
            F.conv(F.substring(b, k, 8), 16, 10).cast("bigint")))
        for k in range(1, BITS // 4, 8)
    ]
    return sum(parts[1:], parts[0])


def search(queries: DataFrame, prints: DataFrame, *, radius: int = RADIUS, blocks: int = RADIUS + 2) -> DataFrame:
    """All ``(query, fingerprint, distance)`` within ``radius`` bits; exact.

    Both tables have a column ``fingerprint``; equal fingerprints are searched once and null ones
    not at all. Join the result with the tables to get documents.
    """
    def keyed(df: DataFrame, name: str) -> DataFrame:
        distinct = df.where(F.col("fingerprint").isNotNull()).select(F.col("fingerprint").alias(name)).distinct()
        return distinct.select(name, F.inline(block_keys(F.col(name), radius, blocks)))

    found = keyed(queries, "query").join(keyed(prints, "fingerprint"), ["table", "key"])
    apart = found.select("query", "fingerprint", distance(F.col("query"), F.col("fingerprint")).alias("distance"))
    return apart.where(F.col("distance") <= radius).distinct()
