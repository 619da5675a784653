"""Step-level operators over the array of steps: counts, signatures, messages, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import ERROR_WORDS
from ..functions.text import blank, redact
from .schema import STEP_FIELDS

REASONING = ("thought", "plan", "critique")
MESSAGE = "struct<role:string,content:string,tool_calls:array<struct<id:string,name:string,arguments:string>>>"


def of_type(*kinds: str) -> Column:
    return F.filter("steps", lambda s: s["step_type"].isin(*kinds))


def tool_names() -> Column:
    """Names of the called tools in order, without null and empty names."""
    return F.filter(F.transform(of_type("tool_call"), lambda s: s["tool_name"]), lambda n: n.isNotNull() & (n != ""))


def tool_signature() -> Column:
    return F.array_join(tool_names(), ">")


def dedup_text() -> Column:
    """What two trajectories are compared by unless another column is given."""
    return F.concat_ws(" ", blank(F.col("query")), tool_signature(), blank(F.col("final_answer")))


def one_line(s: Column) -> Column:
    """A short rendering of one step."""
    said = F.coalesce(F.nullif(s["thought"], F.lit("")), s["content"], F.lit(""))
    call = F.concat(blank(s["tool_name"]), F.lit("("), F.substring(blank(s["tool_args"]), 1, 60), F.lit(")"))
    text = F.when(s["step_type"] == "tool_call", call).when(s["step_type"] == "observation", F.substring(blank(s["observation"]), 1, 80))
    text = text.when(s["step_type"] == "code_execution", F.substring(blank(s["code"]), 1, 80)).otherwise(F.substring(said, 1, 80))
    return F.concat(F.lit("["), blank(s["step_type"]), F.lit("] "), text)


def _message(role: str, content: Column, calls: Column | None = None) -> Column:
    none = F.lit(None).cast("array<struct<id:string,name:string,arguments:string>>")
    return F.struct(F.lit(role).alias("role"), content.alias("content"), (none if calls is None else calls).alias("tool_calls")).cast(MESSAGE)


def messages() -> Column:
    """The chat rendering of a trajectory as one fold over its steps.

    Thoughts, plans and critiques wait, joined by line breaks, until a tool
    call, code or final answer; observations don't release them. Calls are
    numbered in order. A missing closing answer is added.
    """
    start = F.struct(F.array(_message("user", blank(F.col("query")))).alias("out"), F.array().cast("array<string>").alias("waiting"), F.lit(0).alias("calls"))

    def merge(acc: Column, s: Column) -> Column:
        kind = s["step_type"]
        said = F.coalesce(F.nullif(s["thought"], F.lit("")), F.nullif(s["content"], F.lit("")))
        agent = F.when(blank(s["agent"]) != "", F.concat(F.lit("["), s["agent"], F.lit("] "))).otherwise(F.lit(""))
        waits = kind.isin(*REASONING) & said.isNotNull()
        flushed = F.when(F.size(acc["waiting"]) > 0, F.concat(acc["out"], F.array(_message("assistant", F.array_join(acc["waiting"], "\n"))))).otherwise(acc["out"])
        call = F.array(F.struct(F.concat(F.lit("call_"), acc["calls"].cast("string")).alias("id"), s["tool_name"].alias("name"), F.coalesce(s["tool_args"], F.lit("{}")).alias("arguments")))
        code = F.array(_message("assistant", F.concat(F.lit("```python\n"), blank(s["code"]), F.lit("\n```"))), _message("tool", blank(s["code_output"])))
        answer = F.coalesce(F.nullif(s["content"], F.lit("")), F.col("final_answer"))
        out = F.when(kind == "tool_call", F.concat(flushed, F.array(_message("assistant", F.lit(""), call))))
        out = out.when(kind == "code_execution", F.concat(flushed, code))
        out = out.when(kind == "final_answer", F.concat(flushed, F.array(_message("assistant", answer))))
        out = out.when(kind == "observation", F.concat(acc["out"], F.array(_message("tool", blank(s["observation"])))))
        released = kind.isin("tool_call", "code_execution", "final_answer")
        waiting = F.when(waits, F.concat(acc["waiting"], F.array(F.concat(agent, said)))).when(released, F.array().cast("array<string>")).otherwise(acc["waiting"])
        return F.struct(out.otherwise(acc["out"]).alias("out"), waiting.alias("waiting"), (acc["calls"] + (kind == "tool_call").cast("int")).alias("calls"))

    def finish(acc: Column) -> Column:
        all_out = F.when(F.size(acc["waiting"]) > 0, F.concat(acc["out"], F.array(_message("assistant", F.array_join(acc["waiting"], "\n"))))).otherwise(acc["out"])

        def closed(out: Column) -> Column:
            open_end = (blank(F.col("final_answer")) != "") & (F.element_at(out, -1)["role"] != "assistant")
            return F.when(open_end, F.concat(out, F.array(_message("assistant", F.col("final_answer"))))).otherwise(out)

        return F.element_at(F.transform(F.array(all_out), closed), 1)

    return F.aggregate("steps", start, merge, finish)


def valid_calls() -> Column:
    """How many calls name an offered tool (the last of its name) and fill its required arguments."""

    def valid(s: Column) -> Column:
        spec = F.try_element_at(F.filter("tools", lambda t: t["name"] == s["tool_name"]), F.lit(-1))
        filled = F.forall(F.coalesce(spec["required"], F.array().cast("array<string>")), lambda r: F.call_function("get_json_object", s["tool_args"], F.concat(F.lit("$['"), r, F.lit("']"))).isNotNull())
        return spec.isNotNull() & filled

    return F.size(F.filter(of_type("tool_call"), valid))


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(blank(text), r"\s+"), lambda w: w != ""))


def features() -> dict[str, Column]:
    """The numeric features of the learned verifier, in their fixed order."""
    calls, seen = of_type("tool_call"), of_type("observation")
    names = F.array_distinct(tool_names())
    signatures = F.transform(calls, lambda s: F.concat(blank(s["tool_name"]), F.lit(":"), F.coalesce(s["tool_args"], F.lit("{}"))))
    first_call = F.array_position(F.transform("steps", lambda s: s["step_type"]), "tool_call")
    before = F.slice("steps", 1, F.greatest(first_call.cast("int") - 1, F.lit(0)))
    errors = F.size(F.filter(seen, lambda s: blank(s["observation"]).rlike(ERROR_WORDS)))
    chars = F.aggregate(seen, F.lit(0), lambda n, s: n + F.char_length(blank(s["observation"])))
    answer = blank(F.col("final_answer"))
    out = {
        "num_steps": F.size("steps"),
        "num_tool_calls": F.size(calls),
        "num_observations": F.size(seen),
        "num_thoughts": F.size(of_type(*REASONING)),
        "distinct_tools": F.size(names),
        "repeated_signature": F.size(signatures) - F.size(F.array_distinct(signatures)),
        "valid_arg_ratio": F.coalesce(F.try_divide(valid_calls().cast("double"), F.size(calls).cast("double")), F.lit(1.0)),
        "error_observation_ratio": F.coalesce(F.try_divide(errors.cast("double"), F.size(seen).cast("double")), F.lit(0.0)),
        "avg_observation_chars": F.coalesce(F.try_divide(chars.cast("double"), F.size(seen).cast("double")), F.lit(0.0)),
        "has_final_answer": F.trim(answer) != "",
        "final_answer_words": _words(answer),
        "thought_before_first_call": (first_call > 0) & F.exists(before, lambda s: s["step_type"].isin("thought", "plan")),
        "query_words": _words(F.col("query")),
        "mode_single": F.col("mode") == "single_agent",
        "mode_multi": F.col("mode") == "multi_agent",
        "mode_code": F.col("mode") == "code_execution",
        "has_verification": F.col("verification").isNotNull(),
        "verification_verified": F.coalesce(F.col("verification.verified"), F.lit(False)),
        "verification_score": F.coalesce(F.col("verification.score"), F.lit(0.0)),
    }
    return {name: F.coalesce(value.cast("double"), F.lit(0.0)) for name, value in out.items()}


#: Fields of a step that name things and are not redacted.
NAMING = ("step_type", "agent", "tool_name")


def redacted(trajectories: DataFrame) -> DataFrame:
    """Trajectories with query, answer, metadata and every text of their steps redacted, arguments and code included."""
    steps = F.transform("steps", lambda s: F.struct(*((s[f] if f in NAMING else redact(s[f])).alias(f) for f in STEP_FIELDS)))
    return trajectories.withColumns({"query": redact(F.col("query")), "final_answer": redact(F.col("final_answer")), "metadata": redact(F.col("metadata")), "steps": steps})


def completion_text() -> Column:
    """A trajectory as one text, as preference pairs hold it: reasoning, actions with their arguments as JSON, observations, code and the answer."""

    def said(s: Column) -> Column:
        agent = F.when(blank(s["agent"]) != "", F.concat(F.lit("["), s["agent"], F.lit("] "))).otherwise(F.lit(""))
        thought = F.trim(F.coalesce(F.nullif(s["thought"], F.lit("")), blank(s["content"])))
        call = F.concat(agent, F.lit("Action: "), blank(s["tool_name"]), F.lit("("), F.coalesce(s["tool_args"], F.lit("{}")), F.lit(")"))
        code = F.concat(F.lit("Code:\n"), F.trim(blank(s["code"])), F.lit("\nOutput: "), F.trim(blank(s["code_output"])))
        text = F.when(s["step_type"].isin(*REASONING) & (thought != ""), F.concat(agent, thought)).when(s["step_type"] == "tool_call", call)
        return text.when(s["step_type"] == "observation", F.concat(F.lit("Observation: "), F.trim(blank(s["observation"])))).when(s["step_type"] == "code_execution", code)

    answer = F.trim(blank(F.col("final_answer")))
    lines = F.concat(F.transform("steps", said), F.array(F.when(answer != "", F.concat(F.lit("Final answer: "), answer))))
    return F.trim(F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n"))
