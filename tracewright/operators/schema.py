"""Trajectory tables: their schema, and trajectories made from conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOOL = "struct<name:string,description:string,parameters:string,required:array<string>,arg_names:array<string>>"
STEP = "struct<step_type:string,agent:string,thought:string,tool_name:string,tool_args:string,observation:string,code:string,code_output:string,content:string>"
CHECK = "struct<name:string,passed:boolean,detail:string>"
VERIFICATION = f"struct<verified:boolean,score:double,checks:array<{CHECK}>,detail:string>"
TRAJECTORY = (
    f"ord bigint, id string, query string, mode string, domain string, tools array<{TOOL}>, steps array<{STEP}>, final_answer string, "
    f"success boolean, generator_model string, metadata string, created_at double, verification {VERIFICATION}"
)
STEP_FIELDS = ("step_type", "agent", "thought", "tool_name", "tool_args", "observation", "code", "code_output", "content")
MODES = ("single_agent", "multi_agent", "code_execution")


def trajectory_schema() -> T.StructType:
    return T.StructType.fromDDL(TRAJECTORY)


def step(kind: str, **fields: Column) -> Column:
    """A step as a struct column with the given fields and nulls elsewhere."""
    values = {"step_type": F.lit(kind), **fields}
    return F.struct(*(values.get(name, F.lit(None)).cast("string").alias(name) for name in STEP_FIELDS))


def from_conversations(conversations: DataFrame) -> DataFrame:
    """Trajectories from plain conversations ``conv_id, turn, role, text``.

    The first non-empty user text is the query, the last non-empty assistant
    text the final answer; other assistant texts are thoughts; later user and
    all system texts are dropped. Tool texts are observations.
    """
    row = F.struct(F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    said = F.filter("turns", lambda t: (t["role"] == "assistant") & (t["text"] != ""))
    asked = F.filter("turns", lambda t: (t["role"] == "user") & (t["text"] != ""))
    last = F.element_at(F.transform(said, lambda t: t["turn"]), -1)
    kept = F.filter("turns", lambda t: ((t["role"] == "assistant") & (t["text"] != "")) | t["role"].isin("tool", "function"))

    def as_step(t):
        answer = step("final_answer", content=t["text"])
        thought = step("thought", agent=F.lit("assistant"), thought=t["text"])
        seen = step("observation", observation=t["text"])
        return F.when(t["role"].isin("tool", "function"), seen).when(t["turn"] == last, answer).otherwise(thought)

    answer = F.try_element_at(F.transform(said, lambda t: t["text"]), F.lit(-1))
    return turns.select(
        F.col("conv_id").cast("long").alias("ord"),
        F.col("conv_id").cast("string").alias("id"),
        F.coalesce(F.try_element_at(F.transform(asked, lambda t: t["text"]), F.lit(1)), F.lit("")).alias("query"),
        F.lit("single_agent").alias("mode"),
        F.lit(None).cast("string").alias("domain"),
        F.array().cast(f"array<{TOOL}>").alias("tools"),
        F.transform(kept, as_step).cast(f"array<{STEP}>").alias("steps"),
        F.coalesce(answer, F.lit("")).alias("final_answer"),
        (F.coalesce(answer, F.lit("")) != "").alias("success"),
        F.lit("import:openai").alias("generator_model"),
        F.lit("{}").alias("metadata"),
        F.lit(0.0).alias("created_at"),
        F.lit(None).cast(VERIFICATION).alias("verification"),
    )
