"""Imports of traces: every format's odd shapes, ids against the plain rule, what is left out."""

import hashlib
import json

import pytest

from tracewright.sources import traces


def imported(spark, *values, **options):
    lines = spark.createDataFrame([(k, v if v is None or isinstance(v, str) else json.dumps(v)) for k, v in enumerate(values)], "ord long, value string")
    return {r["ord"]: r for r in traces.traces(lines, **options).collect()}, {r["ord"]: r["reason"] for r in traces.rejected(lines, options.get("source", "auto")).collect()}


def steps(row):
    names = {"tool_call": ("tool_name", "tool_args"), "observation": ("observation",), "thought": ("thought",), "final_answer": ("content",)}
    return [(s["step_type"], *(s[n] for n in names[s["step_type"]])) for s in row["steps"]]


def test_chat_messages(spark):
    trace = [
        {"role": "user", "content": ""},
        {"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image"}, "b", {"type": "text", "text": ""}]},
        {"role": "assistant", "content": None, "tool_calls": [{"function": {"name": "f", "arguments": '{"y": 1, "x": [2]}'}}, {"name": "g", "arguments": {"k": None}}, {"function": {"name": ""}}, {"function": {"name": "f", "arguments": "no"}}]},
        {"role": "function", "content": 7},
        {"role": "user", "content": "later"},
        {"role": "assistant", "content": "done"},
        {"role": "system", "content": "s"},
    ]
    got, out = imported(spark, trace, {"messages": [{"role": "assistant", "content": "only"}]}, {"messages": []}, None, "", "{", '{"a": 1, "a": 2}', [], "3", {"spans": []}, {"spans": [], "messages": trace})
    assert steps(got[0]) == [("tool_call", "f", '{"x":[2],"y":1}'), ("tool_call", "g", '{"k":null}'), ("tool_call", "f", "{}"), ("observation", "7"), ("final_answer", "done")]
    assert got[0]["query"] == "a\nb" and got[0]["final_answer"] == "done" and [t["name"] for t in got[0]["tools"]] == ["f", "g"]
    assert got[1]["query"] == "" and got[1]["success"] and set(got) == {0, 1}
    assert out == {2: "no messages", 3: "not JSON", 4: "not JSON", 5: "not JSON", 6: "not JSON", 7: "no messages", 8: "no messages", 9: "no messages", 10: "no messages"}


def test_blocks(spark):
    trace = {"messages": [
        {"role": "user", "content": [{"type": "text", "text": ""}, "ask"]},
        {"role": "assistant", "content": [{"type": "tool_use", "name": "f", "input": {"b": 1, "a": "é"}}, {"type": "text", "text": "then"}, {"type": "tool_use", "name": "g"}, {"type": "thinking", "thinking": "no"}]},
        {"role": "user", "content": [{"type": "tool_result", "content": [{"type": "text", "text": "x"}, "y"]}, {"type": "tool_result"}, {"type": "tool_use", "name": "user"}]},
        {"role": "assistant", "content": "end"},
    ]}
    got, _ = imported(spark, trace)
    assert steps(got[0]) == [("tool_call", "f", '{"a":"é","b":1}'), ("thought", "then"), ("tool_call", "g", "{}"), ("observation", "x\ny"), ("observation", ""), ("final_answer", "end")]
    assert got[0]["query"] == "ask" and got[0]["generator_model"] == "import:anthropic"
    asked, _ = imported(spark, trace, source="openai")
    assert asked[0]["generator_model"] == "import:openai" and [s[0] for s in steps(asked[0])] == ["thought", "final_answer"]


def test_spans(spark):
    parts = [{"role": "assistant", "parts": [{"type": "text", "content": "one"}, {"type": "tool_call", "name": "f", "arguments": '{"a": 1}'}, {"type": "text", "content": "two"}]}, {"role": "tool", "parts": [{"type": "tool_call_response", "result": "r"}]}]
    spans = [
        {"name": "execute_tool g", "start_time_unix_nano": "25", "attributes": [{"key": "gen_ai.tool.call.result", "value": {"intValue": 0}}, {"value": 1}]},
        {"name": "chat", "start_time_unix_nano": 20, "attributes": {"gen_ai.prompt.0.content": "not read again", "gen_ai.output.messages": parts}},
        {"name": "chat", "start_time_unix_nano": "10", "attributes": {"gen_ai.prompt.10.content": "third", "gen_ai.prompt.2.role": "user", "gen_ai.prompt.2.content": "second", "gen_ai.prompt.0.role": "system", "gen_ai.prompt.0.content": "first"}},
        {"name": "chat", "start_time_unix_nano": 30, "attributes": {"gen_ai.completion.0.tool_calls.0.name": "h", "gen_ai.completion.0.tool_calls.0.arguments": '{"z": 0}', "gen_ai.completion.1.content": "end"}},
        {"name": "chat", "start_time_unix_nano": 26, "attributes": {"gen_ai.output.messages": "[not json"}},
    ]
    got, _ = imported(spark, {"spans": spans}, {"spans": [{}]})
    assert steps(got[0]) == [("tool_call", "f", '{"a":1}'), ("thought", "one\ntwo"), ("observation", "r"), ("tool_call", "g", "{}"), ("observation", "0"), ("tool_call", "h", '{"z":0}'), ("final_answer", "end")]
    assert got[0]["query"] == "second" and got[0]["generator_model"] == "import:otel" and steps(got[1]) == []


def test_ids_tools_and_arguments(spark):
    odd = [{"role": "user", "content": 'a, b: "q" \\" \\\\ \n \x1b \x0b \x7f é   {"x": [1, 2]}', "n": [1, 2.5, True, None, {}, []]}, {"role": "assistant", "content": "", "b": {"z": "\\u001B", "a": ","}}]
    got, _ = imported(spark, odd, {"messages": odd}, tools=[{"name": "given", "description": "", "parameters": "{}", "required": ["x"], "arg_names": []}])
    plain = hashlib.sha256(f"0||{json.dumps(odd, sort_keys=True, ensure_ascii=False)}".encode()).hexdigest()[:12]
    assert got[0]["id"] == plain == got[1]["id"] and not got[0]["success"]
    assert [(t["name"], t["required"]) for t in got[0]["tools"]] == [("given", ["x"])]
    with pytest.raises(ValueError):
        imported(spark, odd, source="yaml")


def test_no_python_workers_and_very_long_texts(spark):
    long = "word, \"and\": \\ " * 100_000
    lines = spark.createDataFrame([(1, json.dumps([{"role": "user", "content": long}, {"role": "assistant", "content": long}])), (1, json.dumps([{"role": "user", "content": long}, {"role": "assistant", "content": long}]))], "ord long, value string")
    found = traces.traces(lines.select("ord", "value"))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString().replace("ExistingRDD", "")
    rows = found.collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0]["query"] == long == rows[0]["final_answer"]
