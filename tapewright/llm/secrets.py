"""Secrets in texts, told from copied examples by who else has them.

Patterns find candidates. A candidate's value is hashed, and over the whole corpus each hash
gets the number of distinct repositories and of distinct owners that hold it. A value that many
owners share is an example out of some manual; a random-looking value of few owners is
live-looking. Each candidate's value becomes a further span with that verdict.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import text_or_empty

ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

KINDS = ("assign", "access", "hex", "live", "example", "weak")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
EXAMPLE_OWNERS = 3      # owners from which on a value counts as copied
EXAMPLE_REPOSITORIES = 50   # repositories from which on it does, whoever owns them
RANDOM_BITS = 2.5       # bits per character from which on a value looks random
HEAVY_PARTS = 1000      # a value is heavy if it has more than 1/1000 of all candidates



def candidates(text: str) -> list[tuple[int, int, int, int, int]]:
    """Kind, start, end, and start and end of the value, in code points."""
    found = []
    low = text.lower()  # only to skip texts: it can add letters, not lose them
    if any(w in low for w in WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= MIN_ASSIGN:
                found.append((0, m.start(), m.end(), m.start(2), m.end(2)))
    if "AKIA" in text:
        found += [(1, *m.span(), *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    if first := LONG_HEX.search(text):
        # The first run of 24 starts at its leftmost digit, so nothing before it can match.
        found += [
            (2, *m.span(), *m.span()) for m in HEX.finditer(text, first.start()) if len(m[0]) >= MIN_HEX
        ]
    return found


def bits_per_character(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = []
        for text in batch.column("text").to_pylist():
            rows = []
            for kind, start, end, a, b in candidates(text):
                value = text[a:b]
                digest = hashlib.blake2b(value.encode(), digest_size=8).digest()
                rows.append(
                    {
                        "kind": kind,
                        "start": start,
                        "end": end,
                        "value_start": a,
                        "value_end": b,
                        "value": int.from_bytes(digest, "little", signed=True),
                        "random": bits_per_character(value) >= RANDOM_BITS,
                    }
                )
            spans.append(rows)
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        names = batch.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, SPANS)], [*names, "spans"])


SPANS = pa.list_(
    pa.struct(
        [
            ("kind", pa.int32()),
            ("start", pa.int64()),
            ("end", pa.int64()),
            ("value_start", pa.int64()),
            ("value_end", pa.int64()),
            ("value", pa.int64()),
            ("random", pa.bool_()),
        ]
    )
)
SPANS_SQL = (
    "array<struct<kind:int,start:bigint,end:bigint,value_start:bigint,value_end:bigint,"
    "value:bigint,random:boolean>>"
)


def ownership(held: DataFrame) -> DataFrame:
    """Distinct repositories and owners of each value; one row per value.

    Counted in steps (value, owner, repository), then (value, owner), then value, each of which
    combines before its shuffle: a value in a third of all rows is no heavier than others.
    """
    return (
        held.select("value", "_owner", "_repository")
        .distinct()
        .groupBy("value", "_owner")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("value")
        .agg(F.sum("_n").alias("repositories"), F.count(F.lit(1)).alias("owners"))
    )


def find_secrets(
    docs: DataFrame,
    *,
    repository: Column | str = "doc_id",
    owner: Column | str = "source",
    example_owners: int = EXAMPLE_OWNERS,
    example_repositories: int = EXAMPLE_REPOSITORIES,
) -> DataFrame:
    """One row per document: ``doc_id`` and ``spans`` (kind, start, end, repositories, owners).

    Spans are in code points, end exclusive, ordered by start, then kind as in ``KINDS``. Kinds
    ``assign``, ``access`` and ``hex`` are the matches. Each of them brings a span over its value
    (for ``assign`` what is assigned) with the verdict of the corpus: ``example`` if
    ``example_owners`` owners or more hold the value, or if it is in ``example_repositories``
    repositories or more (boilerplate of one owner is no credential either), else ``live`` if it
    looks random, else ``weak``.

    A null or empty text has no spans; null repositories or owners count as one. Repeated rows
    are documents of their own, but one repository. Other columns are not read. An empty table
    gives an empty result.
    """
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    rows = docs.select(
        "doc_id",
        F.xxhash64(F.coalesce(as_column(repository).cast("string"), F.lit(""))).alias("_repository"),
        F.xxhash64(F.coalesce(as_column(owner).cast("string"), F.lit(""))).alias("_owner"),
        text_or_empty().alias("text"),
    )
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, _repository bigint, _owner bigint, spans {SPANS_SQL}"
    found = materialize(
        rows.mapInArrow(scan, schema).withColumn("_row", F.monotonically_increasing_id()), "secrets"
    )
    held = found.select("_row", "_repository", "_owner", F.explode("spans").alias("s")).select(
        "_row", "_repository", "_owner", "s.*"
    )
    owned = materialize(ownership(held), "owners")
    # At most HEAVY_PARTS values can each hold more than that share of the candidates, so this
    # table has a proven bound; all other values are joined by a shuffle on the value.
    total = found.select(F.sum(F.size("spans"))).first()[0] or 0
    counts = held.groupBy("value").agg(F.count(F.lit(1)).alias("_n"))
    heavy = counts.where(F.col("_n") > max(1, total // HEAVY_PARTS)).select("value")
    heavy = F.broadcast(
        materialize(owned.join(heavy, "value", "left_semi").withColumn("_heavy", F.lit(True)), "heavy")
    )
    marked = held.drop("_repository", "_owner").join(heavy, "value", "left")
    light = marked.where("_heavy is null").drop("repositories", "owners")
    judged = marked.where("_heavy").unionByName(light.join(owned, "value"))
    verdict = (
        F.when(
            (F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories),
            KINDS.index("example"),
        )
        .when(F.col("random"), KINDS.index("live"))
        .otherwise(KINDS.index("weak"))
    )
    own = F.struct("start", "kind", "end", "repositories", "owners")
    added = F.struct(
        F.col("value_start").alias("start"),
        verdict.alias("kind"),
        F.col("value_end").alias("end"),
        "repositories",
        "owners",
    )
    spans = judged.groupBy("_row").agg(
        F.array_sort(F.array_union(F.collect_set(own), F.collect_set(added))).alias("spans")
    )
    kind = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform(
        F.col("spans"),
        lambda s: F.struct(
            F.element_at(kind, s["kind"] + 1).alias("kind"), s["start"], s["end"], s["repositories"], s["owners"]
        ),
    )
    empty = F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint,repositories:bigint,owners:bigint>>)")
    return found.select("_row", "doc_id").join(spans, "_row", "left").select(
        "doc_id", F.coalesce(named, empty).alias("spans")
    )


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
