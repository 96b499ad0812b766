"""Chat formatting of records in many layouts.

The layout of a JSON record is known by its fingerprint: a hash of the paths of its nested
fields. Each fingerprint selects a declarative mapping that says where the conversation's id,
the position and the turns are. The turns, in one canonical form, are written with a template
that marks each turn; control strings inside texts are escaped so that reading gives them back.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


TURN, END = "<|turn|>", "<|end|>"
#: Control strings of common chat templates, and the own ones: none stands in a formatted text.
CONTROL = (
    TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
    "<|endoftext|>", "<|startoftext|>", "<|user|>", "<|assistant|>", "<|system|>",
)
#: What layouts with ``from`` and ``value`` call the roles.
ROLES = (("human", "user"), ("gpt", "assistant"))
PART_CHARS = 1 << 20


# ---------------------------------------------------------------- layouts


def paths(value: Any, at: str = "") -> set[str]:
    """Paths of all fields; elements of lists are ``[]``."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in {f"{at}.{k}", *paths(v, f"{at}.{k}")}}
    if isinstance(value, list):
        return {f"{at}[]"} | {p for v in value for p in paths(v, f"{at}[]")}
    return set()


def fingerprint(fields: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(fields)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """Where a layout has its parts; paths are tuples of field names.

    ``turns`` are (role, path of the text) in their order, or with ``each`` the paths of role and
    text inside each element of that list. ``optional`` fields need not be there: a layout has
    a fingerprint for every choice of them.
    """

    id: tuple[str, ...]
    position: tuple[str, ...] = ()
    each: tuple[str, ...] = ()
    role: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    join: tuple[tuple[str, ...], ...] = ()  # fields added to the first turn's text, if not empty
    optional: tuple[tuple[str, ...], ...] = field(default=())
    roles: tuple[tuple[str, str], ...] = ()  # its names of roles, with the canonical ones

    def fingerprints(self) -> list[str]:
        must, may = set(), []
        for path in (self.id, self.position, *(p for _, p in self.turns), *self.join):
            if path:
                found = {"." + ".".join(path[: i + 1]) for i in range(len(path))}
                if path in self.optional:
                    may.append(found)
                else:
                    must |= found
        if self.each:
            at = "." + ".".join(self.each)
            must |= {"." + ".".join(self.each[: i + 1]) for i in range(len(self.each))}
            must |= {f"{at}[]"}
            bare = set(must)  # a record without turns has an empty list
            for inner in (self.role, self.text):
                must |= {f"{at}[]." + ".".join(inner[: i + 1]) for i in range(len(inner))}
        every = [must, bare] if self.each else [must]
        for extra in may:
            every += [x | extra for x in every]
        return [fingerprint(x) for x in every]

    def read(self, record: dict) -> list[tuple[str, str]]:
        if self.each:
            names = dict(self.roles)
            turns = [(str_of(get(x, self.role)), str_of(get(x, self.text))) for x in get(record, self.each) or []]
            return [(names.get(role, role), text) for role, text in turns]
        out = [(r, str_of(get(record, p))) for r, p in self.turns if has(record, p)]
        for path in self.join:
            if out and (more := get(record, path)):
                out[0] = (out[0][0], f"{out[0][1]}\n\n{more}")
        return out


def get(record: Any, path: Sequence[str]) -> Any:
    for name in path:
        record = record.get(name) if isinstance(record, dict) else None
    return record


def has(record: Any, path: Sequence[str]) -> bool:
    return isinstance(get(record, path[:-1]), dict) and path[-1] in get(record, path[:-1])


def str_of(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value)


def whole_number(value: Any) -> bool:
    """Can the value be an id or a position? Missing ones can."""
    return value is None or (isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63)


LAYOUTS = (
    Layout(id=("conv_id",), position=("turn",), each=("messages",), role=("role",), text=("content",)),
    Layout(id=("id",), position=("index",), each=("conversations",), role=("from",), text=("value",), roles=ROLES),
    Layout(
        id=("meta", "conversation"),
        position=("meta", "turn"),
        turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))),
        optional=(("system",), ("prompt",), ("completion",)),
    ),
    Layout(
        id=("conversation",),
        position=("position",),
        turns=(("user", ("instruction",)), ("assistant", ("output",))),
        join=(("input",),),
        optional=(("instruction",), ("output",), ("input",)),
    ),
)


def by_fingerprint(layouts: Sequence[Layout] = LAYOUTS) -> dict[str, Layout]:
    return {f: layout for layout in layouts for f in layout.fingerprints()}


TURNS = "conv_id bigint, turn bigint, part int, role string, text string, layout string"


def canonical_turns(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Turns of the JSON records in column ``record``, in one form whatever their layout.

    ``conv_id, turn`` (position of the record), ``part`` (place in it), ``role, text, layout``
    (fingerprint). A missing text or role is empty; a role keeps its name unless its layout has
    another for it. A record whose fingerprint has no mapping, whose id or position is no whole
    number, or that is no JSON object, gives one row with a null role and the record as its
    text: nothing is dropped, and such rows are easily counted. A record with an empty list of
    turns has no rows.
    """
    known = by_fingerprint(layouts)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {}  # field paths to fingerprint
        for batch in batches:
            rows: list[tuple] = []
            for raw in batch.column(0).to_pylist():
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                if not isinstance(record, dict):
                    rows.append((None, None, 0, None, raw, None))
                    continue
                key = frozenset(paths(record))
                if key not in names:
                    names[key] = fingerprint(key)
                layout = known.get(names[key])
                place = ()
                if layout is not None:
                    place = get(record, layout.id), get(record, layout.position) if layout.position else 0
                if layout is None or not all(map(whole_number, place)):
                    rows.append((None, None, 0, None, raw, names[key]))
                    continue
                rows += [
                    (*place, k, role, text, names[key])
                    for k, (role, text) in enumerate(layout.read(record))
                ]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                ["conv_id", "turn", "part", "role", "text", "layout"],
            )

    return records.select("record").mapInArrow(read, TURNS)


# ---------------------------------------------------------------- template

_ANY = "|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
_PLAIN, _ESCAPED = re.compile(_ANY), re.compile(_ANY)


def escape(text: str) -> str:
    """A backslash more after the first character of everything that is, or looks like an
    escaped, control string. ``unescape`` takes it away again."""
    return _PLAIN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:] if m[0][1:2] == "\\" else m[0], text)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text starts and ends there.

    The role stands in the first line, as JSON without its quotes, so that no role breaks it."""
    head = f"{TURN}{escape(json.dumps(role, ensure_ascii=False)[1:-1])}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


_TURN = re.compile(re.escape(TURN) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    for m in _TURN.finditer(formatted):
        yield json.loads(f'"{unescape(m[1])}"', strict=False), unescape(m[2])


FORMATTED = "conv_id bigint, part bigint, formatted string, loss array<struct<start:bigint,end:bigint>>"
LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def by_conversation(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_turns(
    turns: DataFrame, *, learn: Sequence[str] = ("assistant",), part_chars: int = PART_CHARS
) -> DataFrame:
    """Formatted text of each conversation and its loss mask (spans of the ``learn`` roles' texts).

    Turns are in order of turn, part, role, text; null turns come first, and turns with equal
    values (repeated rows) all stay. A null role is an empty one, a null text an empty text;
    turns with a null ``conv_id`` are one conversation. A conversation of more than about
    ``part_chars`` code points comes in several rows, ``part`` 0, 1, ...: a task streams over
    its turns and holds one part at a time, however long a conversation is.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, texts, loss = 0, 0, [], []
        current: tuple | None = None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([current[0]], pa.int64()),
                    pa.array([number], pa.int64()),
                    pa.array(["".join(texts)], pa.string()),
                    pa.array([loss], LOSS),
                ],
                ["conv_id", "part", "formatted", "loss"],
            )

        for batch in batches:
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if current is not None and ((conv,) != current or size >= part_chars):
                    yield row()
                    number = number + 1 if (conv,) == current else 0
                    size, texts, loss = 0, [], []
                current = (conv,)
                formatted, start, end = write_turn(role or "", text or "")
                if (role or "") in learn:
                    loss.append({"start": size + start, "end": size + end})
                texts.append(formatted)
                size += len(formatted)
        if current is not None:
            yield row()

    sorted_ = by_conversation(turns, "turn", "part", "role", "text")
    return sorted_.select("conv_id", "role", "text").mapInArrow(write, FORMATTED)


READ = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string,"
    " formatted_chars bigint"
)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted text says: turns, digest of roles and texts, and
    digest of the texts under the loss mask, all unescaped.

    Parts of a conversation follow each other in one task, which holds one of them at a time.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        current: tuple | None = None
        done: list[tuple] = []
        n = chars = loss_chars = 0
        turns_sha, loss_sha = hashlib.sha256(), hashlib.sha256()

        def close() -> None:
            done.append((current[0], n, turns_sha.hexdigest(), loss_chars, loss_sha.hexdigest(), chars))

        def table() -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names
            )

        for batch in batches:
            for conv, text, loss in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (conv,) != current:
                    if current is not None:
                        close()
                    current, n, chars, loss_chars = (conv,), 0, 0, 0
                    turns_sha, loss_sha = hashlib.sha256(), hashlib.sha256()
                for role, said in read_turns(text):
                    n += 1
                    turns_sha.update(f"{role}\n{said}\n".encode())
                for span in loss:
                    learned = unescape(text[span["start"] : span["end"]])
                    loss_chars += len(learned)
                    loss_sha.update(learned.encode())
                chars += len(text)
            if len(done) >= 1000:
                yield table()
                done = []
        if current is not None:
            close()
        if done:
            yield table()

    sorted_ = by_conversation(formatted, "part")
    return sorted_.select("conv_id", "formatted", "loss").mapInArrow(read, READ)


# ---------------------------------------------------------------- layouts out of rows


def as_records(rows: DataFrame) -> DataFrame:
    """Rows by turn as JSON records, each in one of four layouts (by hash of its id and turn).

    A record holds one turn, so none grows with its conversation."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    foreign = {ours: theirs for theirs, ours in ROLES}
    other = F.when(role == "user", foreign["user"]).when(role == "assistant", foreign["assistant"])
    place = [F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint")]
    keep = {"ignoreNullFields": "false"}

    def record(*fields: Column) -> Column:
        return F.to_json(F.struct(*fields), keep)

    one = record(
        place[0].alias("conv_id"),
        place[1].alias("turn"),
        F.array(F.struct(role.alias("role"), text.alias("content"))).alias("messages"),
    )
    two = record(
        place[0].alias("id"),
        place[1].alias("index"),
        F.array(F.struct(F.coalesce(other, role).alias("from"), text.alias("value"))).alias("conversations"),
    )
    meta = F.struct(place[0].alias("conversation"), place[1].alias("turn")).alias("meta")
    flat = [place[0].alias("conversation"), place[1].alias("position")]
    draw = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    named = {
        (2, "system"): record(meta, text.alias("system")),
        (2, "user"): record(meta, text.alias("prompt")),
        (2, "assistant"): record(meta, text.alias("completion")),
        (3, "user"): record(*flat, text.alias("instruction")),
        (3, "assistant"): record(*flat, text.alias("output")),
    }
    out = F.when((draw == 1) & ~role.isin(*dict(ROLES)), two)
    for (k, name), made in named.items():
        out = out.when((draw == k) & (role == name), made)
    return rows.select(F.when(role.isin(*dict(ROLES)), one).otherwise(out.otherwise(one)).alias("record"))
