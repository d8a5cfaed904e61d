"""Chat formatting: nothing of a call or result is lost, and arguments are checked against the whole schema."""

import json
import random

from tidemark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def test_keys_beside_calls_and_results_stay(spark):
    said = {"content": 'Let me "check"', "reason": {"z": 1, "a": [True, None]}, "tool_calls": [{"id": "x", "name": "f", "arguments": {"b": 1, "a": "é"}, "type": "function", "depends_on": []}, 7, {"id": 5, "name": "g"}]}
    back = {"tool_call_id": "x", "content": [2, {"k": None}], "is_error": False, "name": "f", "note": None}
    texts = [
        ("assistant", json.dumps(said)),
        ("tool", json.dumps(back)),
        ("assistant", json.dumps({"role": "critic", "tool_calls": [{"id": "y", "name": "f", "arguments": {}, "depends_on": "x"}]})),
        ("tool", json.dumps({"tool_call_id": "y", "role": "tool"})),
        ("assistant", json.dumps(said) + " and more"), ("assistant", json.dumps(said) + "]"), ("assistant", json.dumps(said) + "}"),
        ("assistant", '{"tool_calls": [{"id": "z"}], "a": 1, "a": 2}'),
        ("user", json.dumps(said)),
    ]
    df = spark.createDataFrame([(1, i, *t) for i, t in enumerate(texts)], SCHEMA)
    got = {r.turn: r for r in chat.format_chats(df).collect()}
    said["tool_calls"][2] |= {"id": "5", "arguments": None}
    assert json.loads(got[0].json) == said | {"role": "assistant"}
    assert got[0].json.startswith('{"content":"Let me \\"check\\"","reason":{"a":[true,null],"z":1},"role":"assistant","tool_calls":[{"arguments":{"a":"é","b":1},"depends_on":[],"id":"x","name":"f","type":"function"},7,')
    assert json.loads(got[1].json) == back | {"role": "tool"} and got[1].status == "ok"
    assert json.loads(got[2].json) == {"role": "assistant", "text.role": "critic", "tool_calls": [{"id": "y", "name": "f", "arguments": {}, "depends_on": "x"}]}
    assert json.loads(got[3].json) == {"content": None, "role": "tool", "tool_call_id": "y"}
    # more than one object, or one that isn't clear, is content as it stands
    for i in range(4, 9):
        assert json.loads(got[i].json) == {"content": texts[i][1], "role": texts[i][0]} and got[i].n_calls == 0


def test_arguments_are_checked_at_any_depth(spark):
    point = {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}, "additionalProperties": False}
    schema = {"type": "object", "required": ["unit"], "properties": {"unit": {"enum": ["m", 2, None]}, "at": {"type": ["object", "null"], "properties": {"deep": {"type": "array", "items": {"type": "array", "items": point}}}}}, "additionalProperties": {"type": "string"}}
    more = {"properties": {"n": {"type": "integer", "minimum": 3}}}
    cases = [
        ("f", {"unit": "m"}, "ok"), ("f", {"unit": 2, "at": None, "z": "text"}, "ok"), ("f", {"unit": None, "at": {"deep": [[{"x": 1}], []]}}, "ok"),
        ("f", {"unit": "km"}, "invalid"), ("f", {}, "invalid"), ("f", {"unit": "m", "z": 1}, "invalid"), ("f", {"unit": "m", "at": 3}, "invalid"),
        ("f", {"unit": "m", "at": {"deep": [[{"x": 1}, {}]]}}, "invalid"), ("f", {"unit": "m", "at": {"deep": [[{"x": "1"}]]}}, "invalid"),
        ("f", {"unit": "m", "at": {"deep": [[{"x": 1, "y": 2}]]}}, "invalid"), ("f", {"unit": "m", "at": {"deep": [{"x": 1}]}}, "invalid"), ("f", [], "invalid"),
        ("g", {"n": 1}, "unchecked"), ("g", {"n": "1"}, "invalid"), ("g", {}, "ok"), ("h", {"any": 1}, "ok"), ("i", {}, "unknown_tool"),
    ]
    tools = [{"name": "f", "parameters": schema}, {"name": "g", "parameters": more}, {"name": "h"}]
    rows = [(1, 0, "system", json.dumps({"tools": tools}))]
    for i, (name, arguments, _) in enumerate(cases):
        rows.append((1, 2 * i + 1, "assistant", json.dumps({"tool_calls": [{"id": f"c{i}", "name": name, "arguments": arguments}]})))
        rows.append((1, 2 * i + 2, "tool", json.dumps({"tool_call_id": f"c{i}", "content": i})))
    got = {r.turn: r for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[2 * i + 1].status for i in range(len(cases))] == [c[2] for c in cases]
    assert [got[2 * i + 1].n_invalid for i in range(len(cases))] == [int(c[2] in ("invalid", "unknown_tool")) for c in cases]


def test_calls_of_functions(spark):
    tools = {"tools": [{"type": "function", "function": {"name": "f", "parameters": {"required": ["x"], "properties": {"x": {"type": "integer"}}}}}]}
    call = lambda i, said: {"id": i, "type": "function", "function": {"name": "f", "arguments": said}}
    said = {"content": None, "tool_calls": [call("a", '{"y": 2, "x": 1}'), call("b", '{"x": "1"}'), call("c", '{"x": 1'), call("d", {"x": 3})]}
    rows = [(1, 0, "system", json.dumps(tools))] + [(1, 1 + i, "assistant", json.dumps(said | {"tool_calls": [c]})) for i, c in enumerate(said["tool_calls"])]
    rows += [(1, 10 + i, "tool", json.dumps({"tool_call_id": c["id"], "content": "r"})) for i, c in enumerate(said["tool_calls"])]
    got = {r.turn: r for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i].status for i in range(1, 5)] == ["ok", "invalid", "invalid", "ok"]
    assert got[1].json == '{"content":null,"role":"assistant","tool_calls":[{"function":{"arguments":"{\\"x\\":1,\\"y\\":2}","name":"f"},"id":"a","type":"function"}]}'
    assert json.loads(got[3].json)["tool_calls"][0] == call("c", '{"x": 1') and json.loads(got[4].json)["tool_calls"][0] == call("d", {"x": 3})


def plain_links(rows):
    """(conv, turn) -> (anchor, level, step, n_calls, n_linked, status) of conversations whose turns are all different."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == conv)
        objects = {t: json.loads(x) if role in ("assistant", "tool") and x.startswith("{") else {} for _, t, role, x in mine}
        owner, answer = {}, {}
        for _, t, role, _ in mine:
            for c in objects[t].get("tool_calls", ()) if role == "assistant" else ():
                owner.setdefault(c["id"], (t, c))
            if role == "tool" and "tool_call_id" in objects[t]:
                answer.setdefault(objects[t]["tool_call_id"], t)
        known = {}
        while True:
            new = {}
            for i, (t, c) in owner.items():
                needs = [n for n in c.get("depends_on", ()) if n in owner]
                if i not in known and all(n in known for n in needs):
                    new[i] = (max([known[n][0] + 1 for n in needs], default=0), max([t, *(max(known[n][1], answer.get(n, -1)) for n in needs)]))
            if not new:
                break
            known |= new
        worst = ["ok", "unanswered", "cycle", "duplicate"]
        for _, t, role, _ in mine:
            calls = objects[t].get("tool_calls", ()) if role == "assistant" else ()
            result = objects[t].get("tool_call_id") if role == "tool" else None
            if calls:
                states, levels, anchors = [], [], []
                for c in calls:
                    first = owner[c["id"]] == (t, c)
                    states.append("duplicate" if not first else "cycle" if c["id"] not in known else "ok" if c["id"] in answer else "unanswered")
                    if c["id"] in known:
                        levels.append(known[c["id"]][0])
                        anchors.append(known[c["id"]][1])
                linked = sum(c["id"] in answer and owner[c["id"]] == (t, c) for c in calls)
                out[conv, t] = (max(anchors, default=t), max(levels, default=0), 0, len(calls), linked, max(states, key=worst.index))
            elif result is not None:
                state = "orphan" if result not in owner else "ok" if answer[result] == t else "repeated"
                level, anchor = known.get(result, (0, owner[result][0] if result in owner else t))
                out[conv, t] = (max(t, anchor), level if result in owner else 0, 1, 0, 0, state)
            else:
                out[conv, t] = (t, 0, 0, 0, 0, None)
    return out


def test_links_levels_and_states_by_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for conv in range(60):
        ids = [f"i{k}" for k in range(rng.randint(1, 6))]
        for turn in range(rng.randint(2, 14)):
            role = rng.choice(["assistant", "tool", "user"])
            if role == "assistant":
                calls = [{"id": rng.choice(ids), "name": "f", "arguments": {"k": rng.random()}, "depends_on": rng.sample(ids, rng.randint(0, min(2, len(ids))))} for _ in range(rng.randint(1, 2))]
                rows.append((conv, turn, role, json.dumps({"tool_calls": calls})))
            else:
                rows.append((conv, turn, role, json.dumps({"tool_call_id": rng.choice([*ids, "none"])}) if role == "tool" else "said"))
    # a chain of ten calls, in the wrong order
    rows.append((100, 0, "assistant", json.dumps({"tool_calls": [{"id": f"{k}", "name": "f", "arguments": {}, "depends_on": [f"{k + 1}"] if k < 9 else []} for k in range(10)]})))
    got = {(r.conv_id, r.turn): (r.anchor, r.level, r.step, r.n_calls, r.n_linked, r.status) for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain_links(rows)
    assert got[100, 0][1] == 9 and {s for *_, s in got.values()} == {"ok", "unanswered", "cycle", "duplicate", "orphan", "repeated", None}
