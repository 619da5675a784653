"""Readers of trajectories, corpora, packs and manifests; traces are in :mod:`traces`."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.schema import STEP, TOOL, VERIFICATION

_RECORD = f"id string, query string, mode string, domain string, tools array<{TOOL}>, steps array<{STEP}>, final_answer string, success boolean, generator_model string, metadata string, verification {VERIFICATION}"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``ord, value`` of the lines that aren't blank; ``ord`` rises with the place of a line in its file, also for equal lines."""
    return spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).filter(F.trim("value") != "").select("ord", "value")


def trajectories_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Trajectories from JSON lines with the defaults of missing fields; a missing id is a hash of the line.

    ``ord`` rises with the place of a line in its file.
    """
    lines = numbered_lines(spark, path)
    got = lines.select("ord", "value", F.from_json("value", _RECORD).alias("r"))
    return got.select(
        "ord",
        F.coalesce("r.id", F.substring(F.sha2("value", 256), 1, 12)).alias("id"),
        F.coalesce("r.query", F.lit("")).alias("query"),
        F.coalesce("r.mode", F.lit("single_agent")).alias("mode"),
        "r.domain",
        F.coalesce("r.tools", F.array().cast(f"array<{TOOL}>")).alias("tools"),
        F.coalesce("r.steps", F.array().cast(f"array<{STEP}>")).alias("steps"),
        F.coalesce("r.final_answer", F.lit("")).alias("final_answer"),
        F.coalesce("r.success", F.lit(True)).alias("success"),
        F.coalesce("r.generator_model", F.lit("mock")).alias("generator_model"),
        F.coalesce("r.metadata", F.lit("{}")).alias("metadata"),
        F.lit(None).cast("double").alias("created_at"),
        "r.verification",
    )


def records_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a known shape; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Texts of a corpus file: a JSON array, JSON lines or plain lines; of objects the first of query, task, text and prompt."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    items = F.from_json("value", "array<string>")
    each = lines.select(F.explode(F.when(F.ltrim("value").startswith("["), items).otherwise(F.array("value"))).alias("v"))
    named = F.coalesce(*(F.nullif(F.get_json_object("v", f"$.{k}"), F.lit("")) for k in ("query", "task", "text", "prompt")))
    text = F.when(F.ltrim("v").startswith("{"), named).otherwise(F.col("v"))
    return each.select(F.trim(text).alias("text")).filter(F.col("text").isNotNull() & (F.col("text") != ""))


def tool_catalog(raw: str | list | dict | None) -> list[dict[str, Any]]:
    """Tools of a catalog in any of the usual wrappings; entries without a name are dropped."""
    if isinstance(raw, str):
        raw = json.loads(raw) if raw.strip() else []
    if isinstance(raw, dict):
        raw = raw.get("tools", [raw])
    out = []
    for entry in raw or []:
        entry = entry.get("function", entry) if isinstance(entry, dict) else {}
        if entry.get("name"):
            parameters = entry.get("parameters") or entry.get("input_schema") or {}
            out.append({"name": entry["name"], "description": entry.get("description") or "", "parameters": json.dumps(parameters, sort_keys=True), "required": list(parameters.get("required") or []), "arg_names": list((parameters.get("properties") or {}).keys())})
    return out


def scenarios(text: str) -> list[dict]:
    """A pack of scenarios from JSON or, where it is installed, YAML; anything but a list is refused."""
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        import yaml

        found = yaml.safe_load(text)
    if not isinstance(found, list):
        raise ValueError("a pack is a list of scenarios")
    return found


def manifest(text: str) -> dict:
    """A run manifest, alone or inside a report."""
    found = json.loads(text)
    return found.get("manifest", found)


def bfcl_cases(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Tool-calling cases of raw JSON lines (``value``): questions joined to their answers, those without a ground truth dropped."""
    said = F.flatten(F.from_json(F.get_json_object("value", "$.question"), "array<array<struct<role:string,content:string>>>"))
    user = F.coalesce(F.get(F.filter(said, lambda m: m["role"] == "user"), 0)["content"], F.lit(""))
    q = questions.select(F.get_json_object("value", "$.id").alias("id"), user.alias("query"), F.regexp_replace(F.get_json_object("value", "$.function"), r'"type":\s*"dict"', '"type":"object"').alias("tools"))
    truth = F.from_json(F.get_json_object("value", "$.ground_truth"), "array<map<string,map<string,array<string>>>>")
    a = answers.select(F.get_json_object("value", "$.id").alias("id"), F.try_element_at(truth, F.lit(1)).alias("truth"))
    tool = F.try_element_at(F.map_keys("truth"), F.lit(1))
    return q.join(a, "id", "left").filter(tool.isNotNull()).select("id", "query", "tools", tool.alias("expected_tool"), F.try_element_at(F.map_values("truth"), F.lit(1)).alias("expected_args"))


def conversation_traces(conversations: DataFrame) -> DataFrame:
    """Conversations ``conv_id, turn, role, text`` as raw traces of messages."""
    row = F.struct("turn", F.col("role"), F.col("text").alias("content"))
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("t"))
    return turns.select("conv_id", F.to_json(F.struct(F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))).alias("value"))


def without_done(plan: DataFrame, done: DataFrame, key: str = "ord") -> DataFrame:
    """The rows of a plan that no earlier run has done."""
    return plan.join(done.select(key).distinct(), key, "left_anti")


def first_of(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The first row of every key (a union of catalogs: the first to name a tool wins)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")
