"""Agent traces of three formats as trajectories, by VARIANT columns and higher-order functions alone."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import stable_seed
from ..operators.schema import STEP, TOOL, VERIFICATION, step

FORMATS = ("auto", "openai", "anthropic", "otel")
EVENT = "struct<what:string,name:string,args:string,text:string>"
# What imported trajectories say of themselves.
INFERRED = {"description": "inferred from a trace", "parameters": '{"type":"object"}'}
_MESSAGE = "struct<content:string,role:string,tool_calls:array<struct<function:struct<arguments:variant,name:string>>>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _each(v: Column, path: str = "$") -> Column:
    """The elements of an array, or null for anything else."""
    return F.try_variant_get(v, path, "array<variant>")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def content_text(content: Column) -> Column:
    """Message content as text: strings as they are, text blocks joined by line breaks, null empty, anything else as JSON."""

    def block(b: Column) -> Column:
        return F.when(_is(b, "STRING"), _text(b, "$")).when(_text(b, "$.type") == "text", _text(b, "$.text"))

    def of(c: Column) -> Column:
        blocks = F.filter(F.transform(_each(c), block), lambda t: t != "")
        return F.coalesce(F.array_join(blocks, "\n"), _text(c, "$"), F.lit(""))

    return _let(content, of)


def arguments(raw: Column) -> Column:
    """Arguments of a call as JSON text with sorted keys: an object, or text that holds one; anything else is ``{}``."""

    def of(v: Column) -> Column:
        inner = F.when(_is(v, "STRING"), F.try_parse_json(_text(v, "$"))).otherwise(v)
        return _let(inner, lambda x: F.when(_is(x, "OBJECT"), F.to_json(x)).otherwise(F.lit("{}")))

    return _let(raw, of)


def _event(what: str, **fields: Column) -> Column:
    values = {"what": F.lit(what), **fields}
    return F.struct(*(values.get(k, F.lit(None)).cast("string").alias(k) for k in ("what", "name", "args", "text")))


def _none() -> Column:
    return F.array().cast(f"array<{EVENT}>")


def openai_events(message: Column) -> Column:
    """Events of a chat message: calls with a name come before the text beside them."""

    def call(c: Column) -> Column:
        name = F.coalesce(_some(_text(c, "$.function.name")), _text(c, "$.name"))
        own = F.try_variant_get(c, "$.function", "variant")
        args = F.when(own.isNotNull() & ~F.is_variant_null(own), F.try_variant_get(c, "$.function.arguments", "variant")).otherwise(F.try_variant_get(c, "$.arguments", "variant"))
        return _event("call", name=name, args=arguments(args))

    calls = F.filter(F.transform(F.coalesce(_each(message, "$.tool_calls"), F.array().cast("array<variant>")), call), lambda e: e["name"] != "")
    said = content_text(F.try_variant_get(message, "$.content", "variant"))

    def of(t: Column) -> Column:
        role = _text(message, "$.role")
        texts = F.filter(F.array(_event("text", text=t)), lambda e: e["text"] != "")
        return F.when(role == "user", F.array(_event("user", text=t))).when(role == "assistant", F.concat(calls, texts)).when(role.isin("tool", "function"), F.array(_event("result", text=t))).otherwise(_none())

    return _let(said, of)


def anthropic_events(message: Column) -> Column:
    """Events of a message of content blocks, in their order; content that is no list is one text block."""
    role = _text(message, "$.role")

    def spoken(t: Column) -> Column:
        said = F.when(role == "user", F.array(_event("user", text=t))).when(role == "assistant", F.array(_event("text", text=t)))
        return F.when(t != "", said)

    def block(b: Column) -> Column:
        kind = _text(b, "$.type")
        call = F.array(_event("call", name=F.coalesce(_text(b, "$.name"), F.lit("")), args=arguments(F.try_variant_get(b, "$.input", "variant"))))
        result = F.array(_event("result", text=content_text(F.try_variant_get(b, "$.content", "variant"))))
        of = F.when(~_is(b, "OBJECT"), spoken(_text(b, "$"))).when(kind == "text", spoken(_text(b, "$.text")))
        return F.coalesce(of.when((kind == "tool_use") & (role == "assistant"), call).when(kind == "tool_result", result), _none())

    blocks = _each(message, "$.content")
    return F.coalesce(F.flatten(F.transform(blocks, block)), spoken(_text(message, "$.content")), _none())


def _attributes(span: Column) -> Column:
    """Attributes of a span as ``(key, value)`` pairs, from a mapping or a list of typed values."""
    pair = "struct<key:string,value:variant>"

    def typed(item: Column) -> Column:
        value = F.try_variant_get(item, "$.value", "variant")
        named = F.coalesce(*(F.try_variant_get(item, f"$.value.{k}", "variant") for k in ("stringValue", "intValue", "doubleValue", "boolValue")), value)
        return F.struct(_text(item, "$.key").alias("key"), named.alias("value")).cast(pair)

    plain = F.map_entries(F.try_variant_get(span, "$.attributes", "map<string,variant>"))
    listed = F.filter(F.transform(_each(span, "$.attributes"), typed), lambda p: p["key"].isNotNull())
    return F.coalesce(plain.cast(f"array<{pair}>"), listed, F.array().cast(f"array<{pair}>"))


def _value(attributes: Column, key: str) -> Column:
    """The last value of a key."""
    return F.try_element_at(F.transform(F.filter(attributes, lambda p: p["key"] == key), lambda p: p["value"]), F.lit(-1))


def _opened(value: Column) -> Column:
    """Text that holds a JSON array or object as what it holds."""
    return F.coalesce(F.when(_is(value, "STRING") & _text(value, "$").rlike(r"^\s*[\[{]"), F.try_parse_json(_text(value, "$"))), value)


def _made(role: Column, content: Column, calls: Column | None = None) -> Column:
    calls = F.lit(None) if calls is None else calls
    return F.struct(content.alias("content"), role.alias("role"), calls.alias("tool_calls")).cast(_MESSAGE)


def _call(name: Column, args: Column) -> Column:
    return F.struct(F.struct(F.coalesce(args, F.parse_json(F.lit("{}"))).alias("arguments"), name.alias("name")).alias("function"))


def _noted(messages: Column) -> Column:
    """Messages of role and content, or role and parts, as chat messages."""

    def one(m: Column) -> Column:
        role = F.coalesce(_some(_text(m, "$.role")), F.lit("assistant"))
        parts = F.filter(_each(m, "$.parts"), lambda p: _is(p, "OBJECT"))
        answers = F.filter(parts, lambda p: _text(p, "$.type") == "tool_call_response")
        answer = F.try_element_at(F.transform(answers, lambda p: F.coalesce(_some(_text(p, "$.result")), _text(p, "$.response"), F.lit(""))), F.lit(1))
        texts = F.filter(F.transform(F.filter(parts, lambda p: _text(p, "$.type") == "text"), lambda p: _text(p, "$.content")), lambda t: t != "")
        calls = F.transform(F.filter(parts, lambda p: _text(p, "$.type") == "tool_call"), lambda p: _call(_text(p, "$.name"), _opened(F.try_variant_get(p, "$.arguments", "variant"))))
        spoken = _made(role, F.array_join(texts, "\n"), F.when(F.size(calls) > 0, calls))
        whole = F.when(F.try_variant_get(m, "$.parts", "variant").isNull(), _made(role, F.coalesce(_text(m, "$.content"), F.lit(""))))
        return whole.when(F.size(answers) > 0, _made(F.lit("tool"), answer)).when(parts.isNotNull(), spoken).otherwise(_made(role, F.lit("")))

    return F.transform(F.filter(messages, lambda m: _is(m, "OBJECT")), one)


def _numbered(attributes: Column, prefix: str) -> Column:
    """Messages written as ``gen_ai.<prefix>.<index>.<field>``, in order of the index."""
    pattern = rf"^gen_ai\.{prefix}\.([0-9]{{1,9}})\.(.+)$"
    row = "struct<at:int,field:string,value:variant>"
    fields = F.transform(
        F.filter(attributes, lambda p: p["key"].rlike(pattern)),
        lambda p: F.struct(F.regexp_extract(p["key"], pattern, 1).cast("int").alias("at"), F.regexp_extract(p["key"], pattern, 2).alias("field"), p["value"].alias("value")).cast(row),
    )

    def messages(all_fields: Column) -> Column:
        def one(at: Column) -> Column:
            def field(name: str) -> Column:
                return F.try_element_at(F.transform(F.filter(all_fields, lambda f: (f["at"] == at) & (f["field"] == name)), lambda f: f["value"]), F.lit(-1))

            role = F.coalesce(_text(field("role"), "$"), F.lit("user" if prefix == "prompt" else "assistant"))
            name = F.coalesce(_some(_text(field("tool_calls.0.name"), "$")), _some(_text(field("function_call.name"), "$")))
            args = F.coalesce(field("tool_calls.0.arguments"), field("function_call.arguments"))
            return _made(role, F.coalesce(_text(field("content"), "$"), F.lit("")), F.when(name.isNotNull(), F.array(_call(name, args))))

        return F.transform(F.array_sort(F.array_distinct(F.transform(all_fields, lambda f: f["at"]))), one)

    return _let(fields, messages)


def otel_messages(spans: Column) -> Column:
    """Chat messages of spans by start: the inputs of the first span that has any, the outputs of all, tools with their results."""

    def placed(s: Column, i: Column) -> Column:
        return F.struct(F.coalesce(F.try_variant_get(s, "$.start_time_unix_nano", "bigint"), F.lit(0)).alias("start"), i.alias("at"))

    order = F.array_sort(F.transform(spans, placed))
    sorted_spans = F.transform(order, lambda o: F.get(spans, o["at"]))

    def one(span: Column) -> Column:
        def of(a: Column) -> Column:
            operation = F.coalesce(_some(_text(_value(a, "gen_ai.operation.name"), "$")), _text(span, "$.name"), F.lit(""))
            tool = _some(_text(_value(a, "gen_ai.tool.name"), "$"))
            result = _text(_value(a, "gen_ai.tool.call.result"), "$")
            named = F.coalesce(tool, F.replace(operation, F.lit("execute_tool "), F.lit("")))
            call = _made(F.lit("assistant"), F.lit(""), F.array(_call(named, _opened(_value(a, "gen_ai.tool.call.arguments")))))
            used = F.when(result.isNull(), F.array(call)).otherwise(F.array(call, _made(F.lit("tool"), result)))
            none = F.array().cast(f"array<{_MESSAGE}>")
            given = F.coalesce(_noted(_each(_opened(_value(a, "gen_ai.input.messages")))), _numbered(a, "prompt"))
            out = F.coalesce(_noted(_each(_opened(_value(a, "gen_ai.output.messages")))), _numbered(a, "completion"))
            is_tool = F.startswith(operation, F.lit("execute_tool")) | tool.isNotNull()
            return F.struct(F.when(is_tool, none).otherwise(given).alias("given"), F.when(is_tool, used).otherwise(out).alias("out"))

        return _let(_attributes(span), of)

    def joined(rows: Column) -> Column:
        first = F.array_position(F.transform(rows, lambda r: F.size(r["given"]) > 0), True)
        return F.flatten(F.transform(rows, lambda r, i: F.when(i + 1 == first, F.concat(r["given"], r["out"])).otherwise(r["out"])))

    return _let(F.transform(sorted_spans, one), joined)


def spaced(text: Column) -> Column:
    """JSON text with a blank after every comma and colon between values.

    Quotes and backslashes inside strings are kept apart by control characters, which stand in no JSON text.
    """
    apart = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    for code in ("0B", "0E", "0F", *(f"1{x}" for x in "ABCDEF")):
        apart = F.replace(apart, F.lit(f"\\u00{code}"), F.lit(f"\\u00{code.lower()}"))
    parts = F.regexp_extract_all(apart, F.lit(r'"[^"]*+"|[^",:]++|[,:]'), F.lit(0))
    wide = F.array_join(F.transform(parts, lambda p: F.when(p.isin(",", ":"), F.concat(p, F.lit(" "))).otherwise(p)), "")
    return F.replace(F.replace(wide, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))


def _parsed(lines: DataFrame, source: str) -> DataFrame:
    """``lines`` with ``_kind`` (null: no trace) and ``_messages``, chat messages or content blocks."""
    if source not in FORMATS:
        raise ValueError(f"unknown format {source}: {', '.join(FORMATS)}")
    rows = lines.withColumn("_trace", F.try_parse_json("value"))
    trace = F.col("_trace")
    with_spans = F.try_variant_get(trace, "$.spans", "variant").isNotNull() if source in ("auto", "otel") else F.lit(False)
    rows = rows.withColumns({"_spans": F.when(with_spans, F.coalesce(_each(trace, "$.spans"), F.array().cast("array<variant>"))), "_said": F.coalesce(_each(trace, "$.messages"), _each(trace))})
    blocks = F.exists("_said", lambda m: F.exists(F.coalesce(_each(m, "$.content"), F.array().cast("array<variant>")), lambda b: F.coalesce(_text(b, "$.type").isin("tool_use", "tool_result"), F.lit(False))))
    chat = F.when(blocks, F.lit("anthropic")).otherwise(F.lit("openai")) if source == "auto" else F.lit("anthropic" if source == "anthropic" else "openai")
    kind = F.when(F.size("_spans") > 0, F.lit("otel")).when(F.col("_spans").isNull() & (F.size("_said") > 0), chat)
    from_spans = F.to_json(otel_messages(F.col("_spans")))
    messages = F.when(F.size("_spans") > 0, _each(F.parse_json(from_spans))).when(F.col("_spans").isNull(), F.col("_said"))
    return rows.withColumns({"_kind": kind, "_messages": messages}).drop("_spans", "_said")


def traces(lines: DataFrame, source: str = "auto", tools: list[dict[str, Any]] | None = None) -> DataFrame:
    """Trajectories from raw traces (``value``: one JSON text each), without Python workers.

    A trace is a list of chat messages, an object with ``messages``, or an object with ``spans``. The first user text
    that isn't empty is the query, the last text of the assistant the final answer, its others are thoughts. ``tools``
    (as of :func:`readers.tool_catalog`) stands for the tools that are otherwise taken from the calls.

    ``ord`` is that of ``lines``, or a hash of the trace where they have none; other columns don't come along. ``id``
    is a 48-bit hash of the messages as JSON with sorted keys, so equal traces have equal ids. Null, empty and
    malformed texts, objects that name a key twice, and traces without messages give no row; :func:`rejected` has them.
    Repeated lines are repeated rows.
    """
    place = F.col("ord").cast("long") if "ord" in lines.columns else F.xxhash64("value")
    rows = _parsed(lines.select(place.alias("ord"), "value"), source).filter(F.col("_kind").isNotNull())
    events = F.flatten(F.when(F.col("_kind") == "anthropic", F.transform("_messages", anthropic_events)).otherwise(F.transform("_messages", openai_events)))
    named = stable_seed(F.lit("0"), spaced(F.to_json("_messages")))
    rows = rows.select("ord", "_kind", named.alias("_id"), events.alias("_events"))
    asked = F.filter("_events", lambda e: (e["what"] == "user") & (e["text"] != ""))
    done = F.filter("_events", lambda e: e["what"] != "user")
    rows = rows.withColumns({"_asked": F.try_element_at(asked, F.lit(1))["text"], "_done": done})
    last = F.array_max(F.transform("_done", lambda e, i: F.when(e["what"] == "text", i)))
    rows = rows.withColumn("_last", F.coalesce(last, F.lit(-1)))

    def as_step(e: Column, i: Column) -> Column:
        call = step("tool_call", tool_name=e["name"], tool_args=e["args"])
        answer, thought = step("final_answer", content=e["text"]), step("thought", thought=e["text"])
        return F.when(e["what"] == "call", call).when(e["what"] == "result", step("observation", observation=e["text"])).when(i == F.col("_last"), answer).otherwise(thought)

    answer = F.coalesce(F.get("_done", F.col("_last"))["text"], F.lit(""))
    if tools:
        offered = F.from_json(F.lit(json.dumps(tools)), f"array<{TOOL}>")
    else:
        names = F.array_distinct(F.transform(F.filter("_done", lambda e: (e["what"] == "call") & (e["name"] != "")), lambda e: e["name"]))
        none = F.array().cast("array<string>")
        offered = F.transform(names, lambda n: F.struct(n.alias("name"), *(F.lit(v).alias(k) for k, v in INFERRED.items()), none.alias("required"), none.alias("arg_names"))).cast(f"array<{TOOL}>")
    return rows.select(
        "ord",
        F.lpad(F.lower(F.hex("_id")), 12, "0").alias("id"),
        F.coalesce("_asked", F.lit("")).alias("query"),
        F.lit("single_agent").alias("mode"),
        F.lit(None).cast("string").alias("domain"),
        offered.alias("tools"),
        F.transform("_done", as_step).cast(f"array<{STEP}>").alias("steps"),
        answer.alias("final_answer"),
        (answer != "").alias("success"),
        F.concat(F.lit("import:"), "_kind").alias("generator_model"),
        F.concat(F.lit('{"imported":true,"source":"trace:'), "_kind", F.lit('"}')).alias("metadata"),
        F.lit(None).cast("double").alias("created_at"),
        F.lit(None).cast(VERIFICATION).alias("verification"),
    )


def rejected(lines: DataFrame, source: str = "auto") -> DataFrame:
    """The ``lines`` that :func:`traces` gives no row for, with the ``reason``."""
    reason = F.when(F.col("_trace").isNull(), F.lit("not JSON")).otherwise(F.lit("no messages"))
    return _parsed(lines, source).filter(F.col("_kind").isNull()).select(*(f"`{c}`" for c in lines.columns), reason.alias("reason"))
