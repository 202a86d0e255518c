import json
import random

import pytest

from ticketmill.plans import chat
from ticketmill.sources.schemas import CHAT_EVENTS

AGENTS = ("Metrics", "Orders", "Facts")
GROUPS = {"Analytics": "Metrics"}


def events(spark, rows):
    return spark.createDataFrame([(s, i, k, p if isinstance(p, str) or p is None else json.dumps(p)) for s, i, k, p in rows], CHAT_EVENTS)


def test_whole_answers_are_ordered_and_stripped(spark):
    log = events(
        spark,
        [("a", 2, "chunk", "world \n"), ("a", 1, "chunk", "\t hello "), ("b", 1, "chunk", "  "), ("b", 2, "chunk", None), ("c", 1, "trace", {})],
    )
    got = {tuple(r) for r in chat.session_text(log).collect()}
    assert got == {("a", 0, "hello world"), ("b", 0, "")}


@pytest.mark.parametrize("per_part,span", [(1, 3), (3, 1), (4, 1000), (100, 7)])
def test_parts_join_to_the_whole_answer(spark, per_part, span):
    rng = random.Random(per_part * 1000 + span)
    chunks = ["", " ", "\n", "x", " y ", "zz", " "]
    answers, rows = {}, []
    for s in range(25):
        seqs = sorted(rng.sample(range(-10, 60), rng.randrange(1, 20)))
        texts = [rng.choice(chunks if s % 5 else ["", " "]) for _ in seqs]
        answers[str(s)] = texts
        rows += [(str(s), i, "chunk", t) for i, t in zip(seqs, texts, strict=True)]
    rng.shuffle(rows)
    got = {}
    for r in chat.session_text(events(spark, rows), per_part, span).orderBy("session_id", "part").collect():
        got.setdefault(r.session_id, {})[r.part] = r.text
    assert {s: "".join(parts.values()) for s, parts in got.items()} == {s: "".join(t).strip() for s, t in answers.items()}
    for s, texts in answers.items():
        cut = ["".join(texts[i : i + per_part]) for i in range(0, len(texts), per_part)]
        filled = [i for i, t in enumerate(cut) if t.strip()]
        assert list(got[s]) == (list(range(filled[0], filled[-1] + 1)) if filled else [0])


def test_gaps_in_seq_do_not_change_the_parts(spark):
    texts = [f"t{i} " for i in range(40)]
    dense = events(spark, [("s", i, "chunk", t) for i, t in enumerate(texts)])
    gapped = events(spark, [("s", i * i * 1000 - 7, "chunk", t) for i, t in enumerate(texts)])
    assert sorted(chat.session_text(dense, 6).collect()) == sorted(chat.session_text(gapped, 6, 50).collect())


def test_tool_fields_take_the_first_filled_alias(spark):
    log = events(
        spark,
        [
            ("s", 1, "trace", {"actionGroup": "", "toolName": "T", "endpoint": "/e", "status": "200"}),
            ("s", 2, "trace", {"action_group": "G", "name": "N", "path": "/p", "httpMethod": "GET", "statusCode": 404}),
            ("s", 3, "trace", {"other": "x", "method": ""}),
            ("s", 4, "trace", "not json"),
            ("s", 5, "chunk", json.dumps({"name": "no"})),
            ("s", 6, "trace", {"status": "500"}),
        ],
    )
    got = sorted(tuple(r)[1:] for r in chat.tool_invocations(log).collect())
    assert got == [(1, "T", "/e", None, "200"), (2, "G", "/p", "GET", "404"), (6, None, None, None, "500")]
    usage = {tuple(r) for r in chat.tool_usage(log).collect()}
    assert usage == {("T", "/e", "200", 1, 0), ("G", "/p", "404", 1, 1), (None, None, "500", 1, 1)}


def fold(traces):
    """One session, trace after trace, as a plain loop."""
    agent = group = path = None
    notes = calls = 0
    for t in traces:
        notes += any("route" in k or "orchestrat" in k for k in t)
        tool = t.get("actionGroup") or t.get("name")
        where, how, status = t.get("apiPath"), t.get("method"), t.get("status")
        if tool or where or how or status:
            calls += 1
            group, path = group or tool or None, where or path or None
        if tool == "Analytics":
            agent = agent or "Metrics"
        agent = next((v for v in t.values() if v in AGENTS), agent)
    return agent, group, path, notes, calls


def test_summary_equals_a_fold(spark):
    rng = random.Random(11)
    options = {
        "actionGroup": ["", "Analytics", "Lookup"],
        "name": ["", "Orders", "n"],
        "apiPath": ["", "/a", "/b"],
        "method": ["", "GET"],
        "status": ["200", ""],
        "routeId": ["r"],
        "orchestration": ["Facts", "o"],
        "agent": ["Metrics", "Orders", "x"],
    }
    sessions = {}
    for s in range(60):
        traces = []
        for _ in range(rng.randrange(1, 6)):
            keys = rng.sample(list(options), rng.randrange(0, 4))
            traces.append({k: rng.choice(options[k]) for k in keys})
        sessions[str(s)] = traces
    rows = [(s, i, "trace", t) for s, traces in sessions.items() for i, t in enumerate(traces)]
    rows += [("silent", 1, "chunk", "hello")]
    rng.shuffle(rows)
    got = {r[0]: tuple(r)[1:] for r in chat.session_summary(events(spark, rows), AGENTS, GROUPS).collect()}
    expected = {s: fold(traces) for s, traces in sessions.items()}
    assert got == {**expected, "silent": (None, None, None, 0, 0)}
