"""Imports of traces that call tools, in the three formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import traces
from .tables import table


def raw_tool_traces(conversations: DataFrame) -> DataFrame:
    """``ord, format, value``: every conversation as a raw trace whose assistant looks up each of its turns.

    The format goes round by conversation. A look-up's tool is named by the length of the turn's text, its argument is the
    turn, its result the hash of the text. Chat messages carry the call beside the text, blocks after it, spans as a
    span of its own between that of the turn and the next.
    """
    row = F.struct(F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("t"))
    wants, result = F.lit('{"turn":'), lambda t: F.md5(t["text"])

    def name(t: Column) -> Column:
        return F.concat(F.lit("look_"), F.char_length(t["text"]).cast("string"))

    def args(t: Column) -> Column:
        return F.concat(wants, t["turn"].cast("string"), F.lit("}"))

    def message(t: Column) -> Column:
        made = "array<struct<role:string,content:string,tool_calls:array<struct<function:struct<name:string,arguments:string>>>>>"
        call = F.array(F.struct(F.struct(name(t).alias("name"), args(t).alias("arguments")).alias("function")))
        plain = F.array(F.struct(t["role"].alias("role"), t["text"].alias("content"), F.lit(None).alias("tool_calls"))).cast(made)
        both = F.array(F.struct(t["role"].alias("role"), t["text"].alias("content"), call.alias("tool_calls")), F.struct(F.lit("tool").alias("role"), result(t).alias("content"), F.lit(None).alias("tool_calls"))).cast(made)
        return F.when(t["role"] == "assistant", both).otherwise(plain)

    def blocks(t: Column) -> Column:
        made = "array<struct<role:string,content:array<struct<type:string,text:string,name:string,input:struct<turn:bigint>,content:string>>>>"

        def block(kind: str, **fields: Column) -> Column:
            return F.struct(F.lit(kind).alias("type"), *(fields.get(k, F.lit(None)).alias(k) for k in ("text", "name", "input", "content")))

        def said(role: Column, *content: Column) -> Column:
            return F.struct(role.alias("role"), F.array(*content).cast("array<struct<type:string,text:string,name:string,input:struct<turn:bigint>,content:string>>").alias("content"))

        use = block("tool_use", name=name(t), input=F.struct(t["turn"].alias("turn")))
        both = F.array(said(t["role"], block("text", text=t["text"]), use), said(F.lit("user"), block("tool_result", content=result(t)))).cast(made)
        return F.when(t["role"] == "assistant", both).otherwise(F.array(said(t["role"], block("text", text=t["text"]))).cast(made))

    def spans(t: Column, i: Column) -> Column:
        made = "array<struct<name:string,start_time_unix_nano:bigint,attributes:map<string,string>>>"
        noted = F.to_json(F.array(F.struct(t["role"].alias("role"), t["text"].alias("content"))))
        chat = F.struct(F.lit("chat").alias("name"), (2 * i).cast("long").alias("start_time_unix_nano"), F.create_map(F.lit("gen_ai.output.messages"), noted).alias("attributes"))
        used = F.create_map(F.lit("gen_ai.tool.call.arguments"), args(t), F.lit("gen_ai.tool.call.result"), result(t))
        tool = F.struct(F.concat(F.lit("execute_tool "), name(t)).alias("name"), (2 * i + 1).cast("long").alias("start_time_unix_nano"), used.alias("attributes"))
        return F.when(t["role"] == "assistant", F.array(tool, chat)).otherwise(F.array(chat)).cast(made)

    shapes = {
        "openai": F.to_json(F.struct(F.flatten(F.transform("t", message)).alias("messages"))),
        "anthropic": F.to_json(F.struct(F.flatten(F.transform("t", blocks)).alias("messages"))),
        "otel": F.to_json(F.struct(F.flatten(F.transform("t", spans)).alias("spans"))),
    }
    value = F.lit(None).cast("string")
    kind = F.element_at(F.array(*map(F.lit, shapes)), (F.pmod("conv_id", F.lit(len(shapes))) + 1).cast("int"))
    for shape, text in shapes.items():
        value = F.when(F.col("format") == shape, text).otherwise(value)
    return turns.withColumn("format", kind).select(F.col("conv_id").alias("ord"), "format", value.alias("value"))


def imported_tool_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations written as traces with tool calls in three formats, told apart and imported."""
    found = traces.traces(raw_tool_traces(table(spark, sf_dir, "conversations")))

    def told(kind: str, field: str) -> Column:
        return F.md5(F.array_join(F.transform(F.filter("steps", lambda s: s["step_type"] == kind), lambda s: s[field]), "|"))

    return found.select(
        F.col("ord").alias("conv_id"), "generator_model", F.md5("query").alias("query_md5"), F.md5("final_answer").alias("answer_md5"), "success", F.size("steps").cast("bigint").alias("num_steps"),
        F.array_join(F.transform("tools", lambda t: t["name"]), "|").alias("tools"), told("tool_call", "tool_args").alias("args_md5"), told("tool_call", "tool_name").alias("called_md5"),
        told("observation", "observation").alias("seen_md5"), told("thought", "thought").alias("thoughts_md5"),
    )


QUERIES = {"imported_tool_traces": imported_tool_traces}

ORACLES = {
    "imported_tool_traces": """
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, 'look_' || length(coalesce(text, '')) AS tool FROM conversations),
first_seen AS (SELECT conv_id, tool, min(turn) AS turn FROM t WHERE role = 'assistant' GROUP BY 1, 2),
tools AS (SELECT conv_id, string_agg(tool, '|' ORDER BY turn) AS tools FROM first_seen GROUP BY 1),
x AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user' AND text <> '') AS q, arg_max(text, turn) FILTER (WHERE role = 'assistant' AND text <> '') AS a,
max(turn) FILTER (WHERE role = 'assistant' AND text <> '') AS last, 2 * count(*) FILTER (WHERE role = 'assistant') + count(*) FILTER (WHERE role = 'assistant' AND text <> '') AS n,
coalesce(string_agg('{"turn":' || turn || '}', '|' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS args, coalesce(string_agg(tool, '|' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS called,
coalesce(string_agg(md5(text), '|' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS seen FROM t GROUP BY 1),
th AS (SELECT t.conv_id, string_agg(text, '|' ORDER BY turn) AS thoughts FROM t JOIN x USING (conv_id) WHERE role = 'assistant' AND text <> '' AND turn <> last GROUP BY 1)
SELECT conv_id, 'import:' || (CASE WHEN conv_id % 3 = 0 OR args = '' AND conv_id % 3 = 1 THEN 'openai' WHEN conv_id % 3 = 1 THEN 'anthropic' ELSE 'otel' END) AS generator_model,
md5(coalesce(q, '')) AS query_md5, md5(coalesce(a, '')) AS answer_md5, a IS NOT NULL AS success, n AS num_steps, coalesce(tools, '') AS tools,
md5(args) AS args_md5, md5(called) AS called_md5, md5(seen) AS seen_md5, md5(coalesce(thoughts, '')) AS thoughts_md5 FROM x LEFT JOIN tools USING (conv_id) LEFT JOIN th USING (conv_id)""",
}
