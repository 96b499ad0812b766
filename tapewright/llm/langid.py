"""Language of a text by bit-sliced Bloom filters over character n-grams.

Each language has a Bloom filter of its typical n-grams. The filters share their hash functions
and lie beside each other: a cell holds one bit per language, so one look-up of an n-gram (the
AND of its cells) gives a bitmask of all languages that have it. A text's score for a language
is the number of its n-grams whose mask has that bit, less the number expected by chance.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import giving_back, parts


SIZES = (2, 3, 4, 5)          # characters of an n-gram
TRAIN_ROWS = 40_000           # labelled rows the filters are learnt from, shared by the languages
LEAST_ROWS = 100              # rows of a language that its share is not cut below
MAX_GRAMS = 400_000           # n-grams kept, shared by the languages; of each the most frequent ones
LEAST_GRAMS = 40_000          # n-grams of a language that its share is not cut below
MIN_ROWS = 3                  # rows of a language that hold an n-gram, at least; or a tenth of its rows
SHARE = 0.3                   # of the highest rate of any language, at least
DOUBT_ROWS = 10               # rows without the n-gram that a rate must outweigh to claim it from others
CELLS_PER_GRAM, HASHES = 16, 3
PIECE_CHARS = 1 << 19         # characters handled at once
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text)) if len(text) < 64 else bool(
        _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any()
    )


def _scramble(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def grams(text: str) -> np.ndarray:
    """Hashes of all n-grams in lower case; whatever is no letter counts as one space.

    N-grams may start or end with a space, but have none inside.
    """
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    codes = np.where(letter, codes, 32)[keep].astype(np.uint64)
    space = codes == 32
    out = []
    with np.errstate(over="ignore"):
        for n in SIZES:
            m = len(codes) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, np.uint64)
            inside = np.zeros(m, bool)
            for i in range(n):
                h = h * np.uint64(0x100000001B3) + codes[i : i + m]
                if 0 < i < n - 1:
                    inside |= space[i : i + m]
            out.append(_scramble(h[~inside]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def pieces(text: str) -> Iterator[str]:
    """Pieces of a very long text; each n-gram lies in one of them."""
    if len(text) <= PIECE_CHARS:
        yield text
        return
    start = 0
    while start < len(text):
        end = start + PIECE_CHARS
        while end < len(text) and text[end].isalpha() and end < start + 2 * PIECE_CHARS:
            end += 1  # words stay whole
        yield text[start:end]
        start = end


@dataclass(frozen=True)
class Model:
    """Languages in order of their bit; ``cells`` has a word of bits per 64 languages."""

    languages: list[str]
    cells: np.ndarray          # (cells, words) uint64
    chance: np.ndarray         # chance of a foreign n-gram to have the bit of a language

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """The languages that have each n-gram, as bits."""
        size = np.uint64(len(self.cells))
        second = _scramble(hashes ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
        out = None
        with np.errstate(over="ignore"):
            for i in range(HASHES):
                found = self.cells[((hashes + np.uint64(i) * second) % size).astype(np.int64)]
                out = found if out is None else out & found
        return out

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """Popcount of each language's bits over the text's n-grams, and the number of these."""
        total, n = np.zeros(len(self.languages)), 0
        for piece in pieces(text):
            masks = self.masks(grams(piece))
            n += len(masks)
            for k in range(len(self.languages)):
                bits = (masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
                total[k] += int(bits.sum())
        return total, n

    def decide(self, text: str | None) -> tuple[str, float]:
        """Language and the share of the text's n-grams that it has beyond chance, 0 to 1.

        Without a letter (or any language) the answer is ``und`` with score 0. Equal scores go
        to the language whose name comes first.
        """
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        counts, n = self.counts(text)
        sure = np.clip((counts / max(n, 1) - self.chance) / (1 - self.chance), 0.0, 1.0)
        best = int(np.argmax(sure))
        return self.languages[best], float(sure[best])


def _spread(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    second = _scramble(hashes ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(HASHES):
            yield ((hashes + np.uint64(i) * second) % np.uint64(size)).astype(np.int64)


def shares(sizes: dict, room: int, least: int) -> dict:
    """``room`` dealt evenly to keys of the given sizes; what small ones leave goes to the others.

    None gets less than ``least`` of its own, so many keys may get more than ``room`` together.
    """
    out = {}
    for k, key in enumerate(sorted(sizes, key=sizes.get)):
        out[key] = min(sizes[key], max(least, room // (len(sizes) - k)))
        room = max(0, room - out[key])
    return out


def by_language(values: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("lang"))


def train(rows: DataFrame, *, train_rows: int = TRAIN_ROWS, max_grams: int = MAX_GRAMS) -> Model:
    """Learns from ``text`` and ``lang`` of ``rows``; rows where either is null are left out.

    Each language has its own share of about ``train_rows`` different texts (a hash of the text
    chooses them; a language with fewer is read whole), each to its end, and its own share of about ``max_grams`` n-grams: what reaches the driver, and
    every task, is bounded per language at any size of the corpus, and no language or label takes
    room from another below ``LEAST_ROWS`` and ``LEAST_GRAMS``. N-grams belong to each language
    whose rows hold them at ``SHARE`` of the rate of the language that holds them most, so a few
    wrong labels do no harm; a language of few rows claims less (``DOUBT_ROWS``). Without rows
    the model has no language.
    """
    usable = rows.select(F.col("text"), F.col("lang").cast("string").alias("lang")).where(
        "text is not null and lang is not null"
    )
    # A text counts once in its language. Hashes stand for the texts here, so that this is narrow.
    texts = materialize(
        usable.select("lang", F.xxhash64(F.lit(3), "text").alias("part"), F.xxhash64(F.lit(4), "text").alias("other")).distinct(),
        "texts",
    )
    all_sizes = _sizes(texts)
    if not all_sizes:
        return Model([], np.zeros((1, 1), np.uint64), np.zeros(0))
    drawn = shares(all_sizes, train_rows, LEAST_ROWS)
    part = F.pmod("part", F.lit(1 << 30)) < by_language({x: int((1 << 30) * (drawn[x] / n)) for x, n in all_sizes.items()})
    sizes = _sizes(texts.where(part))
    sample = usable.withColumn("part", F.xxhash64(F.lit(3), "text")).where(part).select("text", "lang").distinct()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                found, held = [], 0
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                for i, text in enumerate(own):
                    found.append(np.unique(np.concatenate([np.unique(grams(p)) for p in pieces(text)])))
                    held += len(found[-1])
                    if held > 1_000_000 or i == len(own) - 1:
                        h, n = np.unique(np.concatenate(found), return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(h)), pa.array(h.view(np.int64)), pa.array(n)],
                            ["lang", "gram", "n"],
                        )
                        found, held = [], 0

    counted = sample.mapInArrow(giving_back(count), "lang string, gram bigint, n bigint")
    counted = materialize(counted.groupBy("gram", "lang").agg(F.sum("n").alias("n")), "grams")
    fewest = F.least(F.lit(MIN_ROWS), F.greatest(F.lit(1), F.floor(by_language(sizes) / 10)))
    rate, claim = F.col("n") / by_language(sizes), F.col("n") / (by_language(sizes) + DOUBT_ROWS)
    owned = materialize(
        counted.where(F.col("n") >= fewest)
        .withColumns({"rate": rate, "claim": claim})
        .groupBy("gram")
        .agg(F.max("claim").alias("top"), F.collect_list(F.struct("lang", "n", "rate")).alias("langs"))
        .select("gram", F.inline(F.filter("langs", lambda x: x["rate"] >= SHARE * F.col("top"))))
        .select("gram", "lang", "n"),
        "owned",
    )
    kept = owned.where(_most_frequent(owned, max_grams)).select("gram", "lang").toPandas()
    languages = sorted(sizes, key=lambda x: x.encode())
    cells = np.zeros((max(64, CELLS_PER_GRAM * kept["gram"].nunique()), -(-len(languages) // 64)), np.uint64)
    chance = np.zeros(len(languages))
    for k, lang in enumerate(languages):
        own = kept["gram"][kept["lang"] == lang].to_numpy().astype(np.int64).view(np.uint64)
        bit = np.uint64(1) << np.uint64(k % 64)
        for at in _spread(own, len(cells)):
            cells[at, k // 64] |= bit
        chance[k] = (((cells[:, k // 64] & bit) > 0).mean()) ** HASHES
    return Model(languages, cells, np.minimum(chance, 0.99))


def _sizes(rows: DataFrame) -> dict[str, int]:
    return {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}


def _most_frequent(owned: DataFrame, max_grams: int) -> Column:
    """The share of each language: its n-grams above some count, and by hash those with that count.

    The counts of a language are few, so no task sorts its n-grams.
    """
    held = owned.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("grams")).toPandas().sort_values("n", ascending=False)
    room = shares(held.groupby("lang")["grams"].sum().to_dict(), max_grams, LEAST_GRAMS)
    count, share = {}, {}
    for lang, own in held.groupby("lang"):
        upto = own["grams"].cumsum()
        at = min(int((upto < room[lang]).sum()), len(own) - 1)
        count[lang], size = int(own["n"].iloc[at]), int(own["grams"].iloc[at])
        share[lang] = (room[lang] - (int(upto.iloc[at]) - size)) / size
    if not count:
        return F.lit(True)
    edge = by_language(count)
    drawn = F.pmod(F.xxhash64(F.lit(5), "gram"), F.lit(1 << 30)) < by_language(share) * (1 << 30)
    return (F.col("n") > edge) | ((F.col("n") == edge) & drawn)


def identify(docs: DataFrame, model: Model, *, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score; only ``text`` is looked at.

    A null text, or one without a letter, is ``und`` with score 0. All rows and columns stay
    (columns with the names of the two new ones are replaced); whole texts are read.
    """
    docs = docs.drop(lang, score)
    names = docs.columns
    schema = docs.withColumns({lang: F.lit(""), score: F.lit(0.0)}).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size, see train()

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            said = [shared.value.decide(t) for t in batch.column(names.index("text")).to_pylist()]
            new = [pa.array([x for x, _ in said], pa.string()), pa.array([y for _, y in said], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*names, lang, score])

    return docs.mapInArrow(giving_back(predict), schema)


def held_out() -> Column:
    """A quarter of the documents, by CRC of their id; a null id is not held out."""
    crc = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    return F.coalesce(crc % 4 == 2, F.lit(False))


def learn_and_identify(docs: DataFrame, **settings) -> DataFrame:
    """``identify`` by a model learnt from the documents that are not held out."""
    return identify(docs, train(docs.where(~held_out()), **settings))
