from __future__ import annotations

import hashlib
import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from sessionlake.llm import chat

T = chat.Template()
PIECES = [*T.controls, "\\", "\\-", "-", ">", "<", "[", " ", "a", "\n", "é", "</s>", "<turn", " </turn>"]
hard = st.lists(st.sampled_from(PIECES), max_size=8).map("".join)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), hard), hard), max_size=5))
@settings(max_examples=400, deadline=None)
def test_written_turns_read_back(turns):
    written = "".join(chat.render(r, t, T)[0] for r, t in turns)
    assert [(r, t) for r, t, *_ in chat.read_turns(written, T)] == turns


@given(hard)
@settings(max_examples=300, deadline=None)
def test_escaped_texts_hold_no_control_string(text):
    out = chat.escape(text, T.controls)
    assert chat.unescape(out) == text
    assert not any(c in out for c in T.controls)


RECORDS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}, "messages", [("user", "hi"), ("assistant", "yo")]),
    ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": None}]}, "conversations", [("user", "hi"), ("assistant", "")]),
    ({"instruction": "do", "input": "x", "output": "y"}, "instruction with input", [("user", "do"), ("user", "x"), ("assistant", "y")]),
    ({"instruction": "do", "output": "y", "extra": {"a": [1, 2]}}, "instruction", [("user", "do"), ("assistant", "y")]),
    ({"prompt": "p", "completion": ""}, "prompt", [("user", "p"), ("assistant", "")]),
    ({"prompt": "p", "response": "r", "system": "s"}, "prompt and response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"question": "q", "answer": "a"}, "question", [("user", "q"), ("assistant", "a")]),
]


def test_layouts(spark):
    rows = [(k, json.dumps(r)) for k, (r, *_) in enumerate(RECORDS)] + [(90, "not json"), (91, None), (92, "[1]"), (93, '{"a": 1}')]
    got: dict[int, list] = {}
    for r in chat.turns_of_records(spark.createDataFrame(rows, "id long, j string"), "id", "j").collect():
        got.setdefault(r.conv_id, []).append(r)
    for k, (_, name, turns) in enumerate(RECORDS):
        mine = sorted(got[k], key=lambda r: r.turn)
        assert {r.mapping for r in mine} == {name}
        assert [(r.role, r.text) for r in mine] == turns
    assert all(len(got[k]) == 1 and got[k][0].mapping is None for k in (90, 91, 92, 93))


def test_fingerprints_follow_paths_not_values():
    a, b = chat.paths({"x": [{"y": 1}, {"z": "t"}]}), chat.paths({"x": [{"z": "u"}, {"y": 2}]})
    assert chat.fingerprint(a) == chat.fingerprint(b)
    assert chat.fingerprint(a) != chat.fingerprint(chat.paths({"x": [{"y": "1"}, {"z": "t"}]}))
    assert chat.fingerprint(chat.paths({})) != chat.fingerprint(chat.paths({"x": []}))


def brute(turns):
    whole, learnt = hashlib.sha256(), ""
    for r, t in turns:
        whole.update(f"{r}\n{t}\n".encode())
        learnt += t if r == "assistant" else ""
    return len(turns), whole.hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), sum(len(chat.render(r, t, T)[0]) for r, t in turns)


def digests(df):
    return chat.chat_digests(chat.format_chats(chat.turns_of_records(chat.row_records(df), "conv_id", "record")))


def test_digests(spark):
    rng = random.Random(1)
    convs = {k: [(rng.choice(["user", "assistant", "system", "tool", ""]), "".join(rng.choice(PIECES) for _ in range(rng.randrange(9)))) for _ in range(rng.randrange(1, 9))] for k in range(40)}
    rows = [(k, n, r or None, t or None) for k, turns in convs.items() for n, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS seq", "'p' AS piece")
    got = {r.conv_id: tuple(r)[1:] for r in digests(df).collect()}
    assert got == {k: brute(t) for k, t in convs.items()}
    assert digests(df.limit(0)).collect() == []


def test_ties_nulls_and_unknown_tables(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:] for r in digests(df).collect()}
    assert got == {1: brute([("user", "a"), ("user", "a"), ("user", "b")]), None: brute([("", "")])}
    unknown = chat.turns_of_records(chat.row_records(df.select("conv_id")), "conv_id", "record").collect()
    assert [(r.mapping, r.turn, r.role, r.text) for r in unknown] == [(None, None, None, None)] * 4


def test_layouts_of_one_table_go_one_way(spark):
    """Records of all layouts in one table: fingerprints select, and what is written reads back as the turns."""
    own = {"conv_id": 70, "turn": 1, "role": "human", "text": "second"}
    records = [(k, r) for k, (r, *_) in enumerate(RECORDS)] + [(70, own), (70, own | {"turn": 0, "role": "user", "text": None, "more": {"a": [1]}})]
    rows = spark.createDataFrame([(k, json.dumps(r)) for k, r in records], "id long, j string").selectExpr("*", "1 AS turn", "'x' AS layout")
    turns = chat.turns_of_records(rows, "id", "j").persist()
    got = {r.conv_id: tuple(r)[1:] for r in chat.chat_digests(chat.format_chats(turns)).collect()}
    want = {k: brute(t) for k, (_, _, t) in enumerate(RECORDS)} | {70: brute([("user", ""), ("human", "second")])}
    assert got == want
    layouts = {r.conv_id: r.layout for r in turns.collect() if r.conv_id != 70}
    assert layouts == {k: chat.fingerprint(chat.paths(r)) for k, r in records if k != 70}
    assert len({r.layout for r in turns.collect() if r.conv_id == 70}) == 2
    turns.unpersist()
    nested = spark.createDataFrame([(1, ([("user", "hi"), ("assistant", "yo")],))], "id long, r struct<messages: array<struct<role: string, content: string>>>")
    assert [(r.mapping, r.turn, r.role, r.text) for r in chat.turns_of_records(nested, "id", "r").collect()] == [("messages", 0, "user", "hi"), ("messages", 1, "assistant", "yo")]


def test_registry_knows_layouts_and_keeps_others(monkeypatch):
    registry = chat.Registry()
    assert len(registry.known) == len(chat.MAPPINGS)
    tried = []
    monkeypatch.setattr(chat, "MAPPINGS", ())
    found = chat.paths({"prompt": "p", "completion": "c", "score": 1.5})
    first = registry.select(found)
    registry.mappings = tried  # a second look needs no mapping to be tried
    assert registry.select(found) == first
    assert first[1].name == "prompt"
    assert registry.select(chat.paths({"a": 1}))[1] is None
