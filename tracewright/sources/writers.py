"""Exports of trajectories: record shapes as DataFrames, and writers of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import steps as P

_NO_NULLS = {"ignoreNullFields": "false"}


def _object(args: Column) -> Column:
    """Texts of JSON objects as objects (a VARIANT), anything else as the text it is."""
    return F.coalesce(F.when(args.rlike(r"^\s*\{"), F.try_parse_json(args)), args.cast("variant"))


def _with_objects(steps: Column) -> Column:
    return F.transform(steps, lambda s: s.withField("tool_args", _object(s["tool_args"])))


def _calls_with_objects(messages: Column) -> Column:
    return F.transform(messages, lambda m: m.withField("tool_calls", F.transform(m["tool_calls"], lambda c: c.withField("arguments", _object(c["arguments"])))))


def jsonl(trajectories: DataFrame) -> DataFrame:
    """One JSON text per trajectory in the column ``value``."""
    fields = ["id", "query", "mode", "domain", _calls_with_objects(P.messages()).alias("messages"), "tools", _with_objects(F.col("steps")).alias("steps"), "final_answer", "success", "generator_model", "metadata"]
    bare, full = F.to_json(F.struct(*fields), _NO_NULLS), F.to_json(F.struct(*fields, "verification"), _NO_NULLS)
    return trajectories.select(F.when(F.col("verification").isNull(), bare).otherwise(full).alias("value"))


def sharegpt(trajectories: DataFrame) -> DataFrame:
    """``id, conversations (from, value), tools``; a call is a turn of its own, other roles are dropped."""

    def turns(m: Column) -> Column:
        def one(speaker: str, value: Column) -> Column:
            return F.array(F.struct(F.lit(speaker).alias("from"), value.alias("value")))

        calls = F.transform(m["tool_calls"], lambda c: F.struct(F.lit("function_call").alias("from"), F.to_json(F.struct(c["name"].alias("name"), _object(c["arguments"]).alias("arguments"))).alias("value")))
        none = F.array().cast("array<struct<from:string,value:string>>")
        said = F.when(m["content"] != "", one("gpt", m["content"])).otherwise(none)
        return F.when(m["role"] == "user", one("human", m["content"])).when(m["role"] == "tool", one("observation", m["content"])).when(m["role"] == "assistant", F.concat(said, F.coalesce(calls, none))).otherwise(none)

    return trajectories.select("id", F.flatten(F.transform(P.messages(), turns)).alias("conversations"), "tools")


def adp(trajectories: DataFrame) -> DataFrame:
    """``id, schema, instruction, tools, steps (type, agent, content), output``."""

    def step(s: Column) -> Column:
        call = F.to_json(F.struct(s["tool_name"].alias("tool"), _object(s["tool_args"]).alias("args")), _NO_NULLS)
        code = F.to_json(F.struct(s["code"].alias("code"), s["code_output"].alias("output")), _NO_NULLS)
        said = F.coalesce(F.nullif(s["thought"], F.lit("")), F.nullif(s["content"], F.lit("")), F.lit(""))
        content = F.when(s["step_type"] == "tool_call", call).when(s["step_type"] == "code_execution", code).when(s["step_type"] == "observation", F.coalesce(s["observation"], F.lit(""))).otherwise(said)
        return F.struct(s["step_type"].alias("type"), s["agent"].alias("agent"), content.alias("content"))

    return trajectories.select("id", F.lit("adp/0.1").alias("schema"), F.col("query").alias("instruction"), "tools", F.transform("steps", step).alias("steps"), F.col("final_answer").alias("output"))


def last_evals(evals: DataFrame) -> DataFrame:
    """One evaluation per trajectory: the last by ``ord`` where there is one."""
    if "ord" not in evals.columns:
        return evals
    order = Window.partitionBy("trajectory_id").orderBy(F.col("ord").desc())
    return evals.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "ord")


def flat(trajectories: DataFrame, evals: DataFrame | None = None) -> DataFrame:
    """One flat row per trajectory, with its evaluation where given."""
    out = trajectories.select(
        "id", "query", "mode", "domain", F.size("steps").cast("bigint").alias("num_steps"), F.size(P.of_type("tool_call")).cast("bigint").alias("num_tool_calls"),
        F.array_join(F.array_distinct(P.tool_names()), ",").alias("tools_used"), "final_answer", F.to_json(P.messages()).alias("messages"),
    )
    return out if evals is None else out.join(last_evals(evals).withColumnRenamed("trajectory_id", "id"), "id", "left")


def sft(trajectories: DataFrame, evals: DataFrame | None = None, only_passed: bool = False) -> DataFrame:
    """``id, mode, messages``; only those whose evaluation passed, if asked for and given."""
    rows = trajectories
    if only_passed and evals is not None:
        rows = rows.join(evals.filter("passed").select(F.col("trajectory_id").alias("id")), "id", "left_semi")
    return rows.select("id", "mode", P.messages().alias("messages"))


def dpo(pairs: DataFrame, with_margin: bool = True) -> DataFrame:
    return pairs.select(F.col("query").alias("prompt"), "chosen", "rejected", *(["margin"] if with_margin else []))


def grpo(episodes: DataFrame) -> DataFrame:
    """``prompt, completion, reward``: the first call as JSON, else the final answer."""
    call = F.try_element_at(P.of_type("tool_call"), F.lit(1))
    text = F.when(call.isNotNull(), F.to_json(F.struct(call["tool_name"].alias("tool"), _object(call["tool_args"]).alias("args")))).otherwise(F.coalesce("final_answer", F.lit("")))
    return episodes.select(F.col("query").alias("prompt"), text.alias("completion"), "reward")


def save(trajectories: DataFrame, path: str, fmt: str = "jsonl", evals: DataFrame | None = None) -> None:
    """Write a dataset as ``jsonl``, ``sharegpt``, ``adp`` or ``parquet`` (a folder of files)."""
    if fmt == "jsonl":
        jsonl(trajectories).write.text(path)
    elif fmt == "sharegpt":
        sharegpt(trajectories).write.json(path)
    elif fmt == "adp":
        adp(trajectories).write.json(path)
    elif fmt == "parquet":
        flat(trajectories, evals).write.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
