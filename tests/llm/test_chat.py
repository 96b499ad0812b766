"""Chat records of many layouts, and what happens to those without one."""

import json

from tapewright.llm import chat
from tapewright.llm.common import importable_by_tasks


def turns_of(spark, *records):
    importable_by_tasks(spark)
    rows = [(r if r is None or isinstance(r, str) else json.dumps(r), k) for k, r in enumerate(records)]
    docs = spark.createDataFrame(rows, "record string, role int")
    return sorted(
        (tuple(r)[:5] for r in chat.canonical_turns(docs).collect()), key=lambda r: [(x is None, x) for x in r]
    )


def native(conv_id, turn, *turns):
    return {"conv_id": conv_id, "turn": turn, "messages": [{"role": r, "content": t} for r, t in turns]}


def foreign(conv_id, turn, *turns):
    return {"id": conv_id, "index": turn, "conversations": [{"from": r, "value": t} for r, t in turns]}


def test_only_the_layout_with_other_names_renames_roles(spark):
    got = turns_of(
        spark, native(1, 0, ("human", "a"), ("gpt", "b"), (None, None)), foreign(2, 3, ("human", "c"), ("gpt", "d"), ("tool", ""))
    )
    assert got == [
        (1, 0, 0, "human", "a"), (1, 0, 1, "gpt", "b"), (1, 0, 2, "", ""),
        (2, 3, 0, "user", "c"), (2, 3, 1, "assistant", "d"), (2, 3, 2, "tool", ""),
    ]


def test_roles_survive_the_round_trip(spark):
    importable_by_tasks(spark)
    rows = [(1, 0, "human", "who"), (1, 1, "gpt", "me"), (2, 0, "user", "x"), (2, 1, "assistant", "</s>\\[INST]"), (3, 0, None, None)]
    docs = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    back = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.canonical_turns(chat.as_records(docs)))).collect()}
    assert {c: r.n_turns for c, r in back.items()} == {1: 2, 2: 2, 3: 1}
    assert back[1].loss_chars == 0 and back[2].loss_chars == len("</s>\\[INST]")


def test_records_that_no_layout_reads_stay_whole(spark):
    odd = [native("x-1", 0, ("user", "a")), {"what": 1}, "no json", "[1]", None, native(True, 0, ("user", "a")), native(1 << 70, 0, ("u", "a"))]
    got = turns_of(spark, *odd)
    assert len(got) == len(odd) and all(r[:4] == (None, None, 0, None) for r in got)
    assert {r[4] for r in got} == {x if x is None or isinstance(x, str) else json.dumps(x) for x in odd}


def test_empty_lists_long_texts_and_no_records(spark):
    long = "long " * 200_000
    assert turns_of(spark, native(1, 0), foreign(2, 0)) == []
    assert turns_of(spark, native(None, None, ("user", long)), native(4, 0, ("user", long))) == [
        (4, 0, 0, "user", long), (None, None, 0, "user", long)
    ]
    assert turns_of(spark) == []
