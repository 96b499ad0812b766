"""Packing of documents into fixed-size token sequences, first fit decreasing.

The texts of a batch are tokenized together: the borders of their words come from the classes of
their characters, and the merges are applied to all different words at once. A document becomes its token ids and an end id. Full sequences are cut off it; what is left
over is dealt to random groups of about ``GROUP_PIECES`` pieces, and each group is packed by
itself: pieces by falling length, each into the first bin with room. A tournament tree over
the bins' free space finds that bin in logarithmic time. Group sizes do not depend on the
data, so no key, source or length class can make one large.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import giving_back, text_or_empty

CAPACITY = 1024
GROUP_PIECES = 16_384
CACHED_WORDS = 250_000  # distinct words after which a task forgets those not used again
CACHED_CHARS = 64       # longer words are not kept
PART_BYTES = 1 << 21    # of texts that are tokenized together
LONG_WORD = 256         # bytes; longer words are left to the tokenizer
#: The word pattern whose borders are found from the classes of characters.
CLASSED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK, LETTER, DIGIT, OTHER, UNKNOWN = range(5)
NEVER = np.iinfo(np.int32).max
MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_{|}~"
SPACE_RUN = re.compile(r" \s")

PIECE = "doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class Cached(dict):
    """Values by text, made by ``make`` at their first use; ``words`` to twice as many stay.

    When it is full, what was not used since the last time goes, so frequent words are kept.
    """

    def __init__(self, make: Callable[[str], bytes], words: int = CACHED_WORDS):
        self.make, self.words, self.old = make, words, {}

    def __missing__(self, text: str) -> bytes:
        if len(self) >= self.words:
            self.old = dict(self)
            self.clear()
        value = self.old.get(text)
        if value is None:
            value = self.make(text)
        if len(text) <= CACHED_CHARS:
            self[text] = value
        return value


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for
    themselves, the others for code points from 256 on in their order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


def little_endian(ids: Sequence[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def encoder(path: str, pattern: str, cached_words: int = CACHED_WORDS) -> Callable[[str], bytes]:
    """Text to id bytes, equal to the tokenizer's own output.

    The merges of a byte-level tokenizer never cross the borders of ``pattern``, so the words
    between them are encoded once and looked up after that. A space before anything but white
    space always starts a word of ``pattern``; a text whose spaces are all of that kind is cut
    there first, which is faster than finding its words. A text that names a special token is
    left to the tokenizer as a whole.
    """
    from tokenizers import Tokenizer

    tokenizer, split, letters = Tokenizer.from_file(path), regex.compile(pattern).findall, byte_letters()
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    model = tokenizer.model

    def word(text: str) -> bytes:
        if text.isascii() and text.isprintable():  # only the space is not spelled as itself
            spelled = text.replace(" ", letters[32])
        else:
            spelled = text.encode("utf-8").decode("latin-1").translate(letters)
        return little_endian([t.id for t in model.tokenize(spelled)])

    def after_space(text: str) -> bytes:
        letters_only = text.rstrip(MARKS)
        if letters_only.isalpha():  # a word, and all marks after it are another
            marks = text[len(letters_only) :]
            return spaced[letters_only] + words[marks] if marks else word(f" {text}")
        return b"".join([words[w] for w in split(f" {text}")])

    words, spaced = Cached(word, cached_words), Cached(after_space, cached_words)

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            return little_endian(tokenizer.encode(text, add_special_tokens=False).ids)
        if SPACE_RUN.search(text):
            return b"".join([words[w] for w in split(text)])
        first, *rest = text.split(" ")
        return b"".join([*[words[w] for w in split(first)], *[spaced[x] for x in rest]])

    return encode


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of each code point, ``UNKNOWN`` until it is met."""
    return np.full(0x110000, UNKNOWN, np.uint8)


def class_of(character: str) -> int:
    kinds = ((BLANK, r"\s"), (LETTER, r"\p{L}"), (DIGIT, r"\p{N}"))
    return next((k for k, kind in kinds if regex.match(kind, character)), OTHER)


def classes(data: np.ndarray) -> np.ndarray:
    """The class of the character of each byte of UTF-8."""
    known = character_classes()

    def looked_up(points: np.ndarray) -> np.ndarray:
        found = known[points]
        if (found == UNKNOWN).any():
            for point in np.unique(points[found == UNKNOWN]).tolist():
                known[point] = class_of(chr(point))
            found = known[points]
        return found

    out = looked_up(np.arange(128))[data & 0x7F]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        more = 1 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
        point = data[lead].astype(np.int64) & (0x3F >> more)
        for k in (1, 2, 3):
            wide = more >= k
            point[wide] = (point[wide] << 6) | (data[lead[wide] + k] & 0x3F)
        kind = looked_up(point)
        out[lead] = kind
        for k in (1, 2, 3):
            wide = more >= k
            out[lead[wide] + k] = kind[wide]
    return out


def word_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the words of ``CLASSED`` start in the bytes ``data`` of texts that start at ``texts``
    (each in ascending order; no empty ones)."""
    kind = classes(data)
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    head = np.zeros(len(data) + 3, bool)  # no text goes on at its end
    head[texts] = head[len(data) :] = True
    change |= head[: len(data)]
    start = change.copy()
    # The last blank before anything else is a word, or with it if it is a space.
    after = np.flatnonzero(change[1:] & ~head[1 : len(data)] & (kind[:-1] == BLANK)) + 1
    last = after - 1
    for _ in range(3):
        last = last - ((data[last] & 0xC0) == 0x80)
    start[last] = True
    start[after[data[last] == 0x20]] = False
    # A lone apostrophe without a space before it takes the letters of a short form.
    mark = np.flatnonzero((data == 0x27) & start)
    mark = mark[~head[mark + 1]]
    one, two = data[mark + 1], data[np.minimum(mark + 2, len(data) - 1)]
    short = np.isin(one, list(b"stmd"))
    pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    pair &= ~head[mark + 2]
    start[mark[short | pair] + 1] = False
    for end in (mark[short] + 2, mark[pair] + 3):
        start[end[end < len(data)]] = True
    return np.flatnonzero(start)


class Merges:
    """The merges of a byte-level tokenizer as arrays: pairs of ids in order, with rank and result."""

    def __init__(self, vocab: dict[str, int], merges: Sequence[Sequence[str]]):
        letters = byte_letters()
        self.byte_ids = np.array([vocab[letters.get(b, chr(b))] for b in range(256)], np.int32)
        self.width = max(vocab.values()) + 1
        pairs = np.array([(vocab[a], vocab[b]) for a, b in merges], np.int64).reshape(-1, 2)
        self.result = np.array([vocab[a + b] for a, b in merges], np.int32)
        made = np.full(self.width, NEVER, np.int64)
        made[self.byte_ids] = -1
        np.minimum.at(made, self.result, np.arange(len(pairs)))
        #: Parts of a merge are made before it, so a pair that a merge brings about never comes before it.
        self.in_order = bool((made[pairs] < np.arange(len(pairs))[:, None]).all())
        keys = pairs[:, 0] * self.width + pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], NEVER * self.width), np.append(order, NEVER).astype(np.int32)
        self.byte_ranks = self.rank(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER).astype(np.int32)

    def encode(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of ``sizes`` bytes in ``data``, one after the other, and how many each has.

        A round joins the pair of least rank of every word, wherever the word has it; words
        without one are done.
        """
        ids, rank = self.byte_ids[data], np.full(len(data), NEVER, np.int32)
        rank[:-1] = self.byte_ranks[(data[:-1].astype(np.int32) << 8) | data[1:]]
        rank[np.cumsum(sizes) - 1] = NEVER
        word, sizes = np.arange(len(sizes)), sizes.copy()
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            first = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(rank, first)
            stays = least < NEVER
            if not stays.all():
                each = np.repeat(stays, sizes)
                done.append((word[~stays], sizes[~stays], ids[~each]))
                word, sizes, least, ids, rank = word[stays], sizes[stays], least[stays], ids[each], rank[each]
                if not len(word):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            # Of pairs that overlap (one id again and again) every other one is joined.
            run = np.flatnonzero(np.append(True, np.diff(hit) > 1))
            if len(run) < len(hit):
                place = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
                hit = hit[place % 2 == 0]
            ids[hit] = self.result[rank[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ends = np.zeros(len(ids), bool)
            ends[np.cumsum(sizes) - 1] = True
            ends[hit] = ends[hit + 1]
            sizes = np.add.reduceat(keep, np.cumsum(sizes) - sizes, dtype=np.int64)
            hit = hit - np.arange(len(hit))
            ids, rank, ends = ids[keep], rank[keep], ends[keep]
            before = hit[hit > 0] - 1
            for at in (hit, before):
                open_ = at[~ends[at]]
                rank[at] = NEVER
                rank[open_] = self.rank(ids[open_], ids[open_ + 1])
        if not done:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        word, counts, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        first, order = np.cumsum(counts) - counts, np.argsort(word)
        return ids[spans(first[order], counts[order])], counts[order]


def spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All indexes of ranges, in their order."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


@lru_cache(maxsize=2)
def merges_of(path: str) -> tuple[Merges | None, list[str]]:
    """The merges, if the tokenizer at ``path`` applies nothing else to a word, and its special tokens."""
    with open(path, encoding="utf-8") as source:
        settings = json.load(source)
    model = settings["model"]
    special = [t["content"] for t in settings["added_tokens"]]
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    if settings["normalizer"] or model["type"] != "BPE" or any(model.get(k) for k in odd):
        return None, special
    found = Merges(model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]])
    return (found if found.in_order else None), special


def batch_encoder(path: str, pattern: str, cached_words: int = CACHED_WORDS) -> Callable[[pa.Array], Iterator[bytes]]:
    """Texts to the id bytes of each, equal to ``encoder``. The different words of ``PART_BYTES`` of text
    are tokenized at once; what the merges alone don't settle is left to ``encoder``."""
    merges, special = merges_of(path)
    alone = lru_cache(maxsize=1)(lambda: encoder(path, pattern, cached_words))

    def together(texts: pa.Array) -> Iterator[bytes]:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(data):
            yield from [b""] * len(texts)
            return
        starts = word_starts(data, offsets[:-1][np.diff(offsets) > 0])
        ends = np.append(starts, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy()
        at = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1].astype(np.int64)
        sizes = np.diff(at)
        ids, counts = merges.encode(np.frombuffer(words.buffers()[2], np.uint8)[: at[-1]], sizes)
        first = np.cumsum(counts) - counts
        each = counts[codes]
        whole = ids[spans(first[codes], each)].astype("<u4", copy=False)
        cuts = np.append(0, np.cumsum(each))[np.searchsorted(starts, offsets)].tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield whole[a:b].tobytes()

    def is_plain(texts: pa.Array) -> np.ndarray:
        if merges is None or pattern != CLASSED:
            return np.zeros(len(texts), bool)
        odd = pc.match_substring_regex(texts, rf"[^ \t\r\n]{{{LONG_WORD}}}|[ \t\r\n]{{{LONG_WORD}}}")
        for token in special:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        return ~odd.to_numpy(zero_copy_only=False)

    def encode(texts: pa.Array) -> Iterator[bytes]:
        texts = texts.cast(pa.large_string())
        sizes = np.cumsum(pc.binary_length(texts).to_numpy())
        plain = is_plain(texts)
        cuts = np.flatnonzero((np.diff(sizes // PART_BYTES) > 0) | (plain[1:] != plain[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):
            if a < b and plain[a]:
                yield from together(texts.slice(a, b - a))
            else:
                yield from (alone()(t.as_py()) for t in texts.slice(a, b - a))

    return encode


def cut_pieces(
    docs: DataFrame, tokenizer: str, pattern: str, *, capacity: int, end_id: int, with_ids: bool, cached_words: int
) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = PIECE.format(id=id_type) + (", ids binary" if with_ids else "")
    end = np.asarray([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = batch_encoder(tokenizer, pattern, cached_words)
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for row, ids in enumerate(encode(batch.column(1))):
                ids += end
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    values = (row, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4)
                    for column, value in zip(rows, values, strict=False):
                        column.append(value)
                    if with_ids:
                        rows[5].append(piece)
            columns = [batch.column(0).take(pa.array(rows[0], pa.int64()))]
            columns += [pa.array(c, pa.int64()) for c in rows[1:5]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(rows[5], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(giving_back(cut), schema)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in the bin of each piece.

    ``room`` is a tournament tree: leaf b holds the free space of bin b, every inner node the
    larger of its children. Walking down, left child first, finds the first bin with room.
    """
    n = len(lengths)
    bins, places = np.zeros(n, np.int64), np.zeros(n, np.int64)
    leaves = 1 << max(n - 1, 0).bit_length()
    room = [capacity] * (2 * leaves)
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, node = sizes[i], 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i], places[i] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, places


def pack(
    docs: DataFrame,
    *,
    tokenizer: str,
    pattern: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    group_pieces: int = GROUP_PIECES,
    with_ids: bool = False,
    seed: int = 17,
    cached_words: int = CACHED_WORDS,
) -> DataFrame:
    """One row per piece: document, start, length, CRC of its ids, sequence and offset there.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. A null or empty text
    is a document of the end id alone. Rows are packed one by one: a repeated row is packed
    again, a null id stays null. An empty table gives an empty plan. ``with_ids`` adds the
    ids themselves (little-endian 32-bit), from which sequences are laid out. ``cached_words``
    weighs a task's memory against its time and changes no result.
    """
    spark = docs.sparkSession
    cut = cut_pieces(
        docs, tokenizer, pattern, capacity=capacity, end_id=end_id, with_ids=with_ids, cached_words=cached_words
    )
    # Stored: tokenizing is the costly part, and the random group must not change afterwards.
    pieces = materialize(cut.withColumn("_draw", F.rand(seed)), "pieces")
    names = [c for c in pieces.columns if c != "_draw"]
    full, rest = (pieces.where(c) for c in (F.col("length") == capacity, F.col("length") < capacity))
    groups = max(1, -(-rest.count() // group_pieces))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        bins, places = first_fit_decreasing(group["length"].to_numpy(), capacity)
        number = (group["_group"].to_numpy() << 32) + bins
        return group[names].assign(sequence_id=2 * number, offset=places)

    schema = spark.createDataFrame([], pieces.select(*names).schema).withColumns(
        {"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")}
    ).schema
    grouped = rest.withColumn("_group", F.floor(F.col("_draw") * groups).cast("bigint"))
    packed = grouped.drop("_draw").groupBy("_group").applyInPandas(place, schema)
    # Odd numbers for full pieces; the stored table gives the same numbers at each reading.
    alone = full.select(
        *names,
        (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )
    return packed.unionByName(alone)


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence (``pack`` with ``with_ids``), pieces in order of their offset."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("tokens"),
        F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
    )
