"""Rewards of tool-call completions: JSON out of prose, parse, tool and argument checks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight of each check; checks that are off give theirs to the others.
WEIGHTS = {"parse": 0.25, "tool": 0.25, "args": 0.25, "execute": 0.25}


def extracted_json(text: Column) -> Column:
    """The first JSON object or array of a text: a fenced block, the whole text, the outermost braces, the outermost brackets; null without one."""
    fenced = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1)), F.trim)
    spans = F.array(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.regexp_extract(text, r"(?s)(\[.*\])", 1))
    candidates = F.concat(fenced, F.array(F.trim(text)), spans)
    structured = F.filter(candidates, lambda c: F.substring(c, 1, 1).isin("{", "[") & F.try_parse_json(c).isNotNull())
    return F.try_element_at(structured, F.lit(1))


def tool_of(call: Column) -> Column:
    """The tool that a JSON call names, in either of the usual spellings."""
    names = [F.nullif(F.get_json_object(call, f"$.{key}"), F.lit("")) for key in ("tool", "tool_name")]
    return F.coalesce(*names)


def arguments_of(call: Column) -> Column:
    return F.coalesce(F.get_json_object(call, "$.args"), F.get_json_object(call, "$.arguments"))


def completion_reward(completion: Column, tools: Column, weights: dict[str, float] | None = None) -> Column:
    """Reward in [0, 1] of a completion given the offered tools (``name, required``); the first tool of a name counts. Nothing is executed."""
    use = {k: w for k, w in (weights or WEIGHTS).items() if k != "execute"}
    total = sum(use.values()) or 1.0
    call = extracted_json(completion)

    def scored(bound: Column) -> Column:
        name, args = tool_of(bound), arguments_of(bound)
        is_object = F.coalesce(F.substring(F.trim(args), 1, 1) == "{", F.lit(False))
        spec = F.try_element_at(F.filter(tools, lambda t: t["name"] == name), F.lit(1))
        filled = F.forall(F.coalesce(spec["required"], F.array().cast("array<string>")), lambda r: F.call_function("get_json_object", args, F.concat(F.lit("$['"), r, F.lit("']"))).isNotNull())
        checks = {"parse": name.isNotNull() & is_object, "tool": spec.isNotNull(), "args": spec.isNotNull() & is_object & filled}
        value = F.lit(0.0)
        for key, weight in use.items():
            value = value + F.when(F.coalesce(checks[key], F.lit(False)), F.lit(weight / total)).otherwise(F.lit(0.0))
        return F.round(value, 6)

    return F.element_at(F.transform(F.array(call), scored), 1)


def to_openai_calls(steps: Column) -> Column:
    """Tool calls of an array of steps in the shape of chat completions."""
    calls = F.filter(steps, lambda s: s["step_type"] == "tool_call")
    return F.transform(
        calls,
        lambda s, i: F.struct(
            F.concat(F.lit("call_"), i.cast("string")).alias("id"), F.lit("function").alias("type"),
            F.struct(s["tool_name"].alias("name"), F.coalesce(s["tool_args"], F.lit("{}")).alias("arguments")).alias("function"),
        ),
    )
