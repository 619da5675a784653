"""Arguments for tool calls, made from the tools' JSON Schemas.

Schemas are read once for each tool: its arguments in order, and for each what
its values are made by, arrays walked down level by level until an item is
reached. The calls then meet their tool's rules, and every value is a column
expression over the query, the rule and a stable seed. No call is expanded into
rows, and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import stable_seed
from ..functions.synthesis import expression, hint, location, named_location, small_numbers, task_phrase
from ..sources.shared import stored

RULE = "struct<pos:int,name:string,required:boolean,depth:int,kind:string,fixed:string,hint:string>"


def rules(tools: DataFrame) -> DataFrame:
    """``tool, rules`` of tools ``tool, parameters`` (JSON Schema): an array of rules, required arguments first in their order, then the first optional one.

    A schema that isn't JSON, or has no properties, has no rules; a required
    name without a property is a string. ``fixed`` is the JSON of the first
    value of an enumeration, which goes before any type.
    """
    schema = F.col("parameters")
    listed = F.from_json(F.get_json_object(schema, "$.properties"), "map<string,string>")
    names = F.coalesce(F.map_keys("properties"), F.array().cast("array<string>"))
    needed = F.array_distinct(F.coalesce(F.from_json(F.get_json_object(schema, "$.required"), "array<string>"), F.array().cast("array<string>")))
    read = tools.select("tool", listed.alias("properties"), needed.alias("needed"))
    extra = F.slice(F.filter(names, lambda n: ~F.array_contains("needed", n)), 1, 1)
    each = read.select("tool", "properties", F.size("needed").alias("n"), F.posexplode(F.concat("needed", extra)).alias("pos", "name"))
    rows = each.select("tool", "pos", "name", (F.col("pos") < F.col("n")).alias("required"), F.lit(0).alias("depth"), F.coalesce(F.try_element_at("properties", F.col("name")), F.lit("{}")).alias("node"))
    while True:  # a step for each level of arrays in the deepest schema
        rows = stored(rows.drop("fixed", "kind"), "rules").withColumn("fixed", F.to_json(F.try_variant_get(F.try_parse_json("node"), "$.enum[0]", "variant"))).withColumn("kind", F.get_json_object("node", "$.type"))
        inner = F.col("fixed").isNull() & (F.col("kind") == "array")
        if rows.filter(inner).isEmpty():
            break
        items = F.get_json_object("node", "$.items")
        below = F.when(items.rlike(r"^\s*\{"), items).otherwise(F.lit("{}"))
        rows = rows.withColumns({"node": F.when(inner, below).otherwise(F.col("node")), "depth": F.col("depth") + F.coalesce(inner, F.lit(False)).cast("int")})
    one = F.struct("pos", "name", "required", "depth", "kind", "fixed", hint(F.col("name")).alias("hint")).cast(RULE)
    return rows.groupBy("tool").agg(F.array_sort(F.collect_list(one)).alias("rules"))


def _value(rule: Column, seed: Column) -> Column:
    """JSON text of one argument; the query's phrases, location and numbers are columns."""
    number = (seed % 7 + 2).cast("string")
    told = F.when(rule["hint"] == "arith", expression(F.col("_found"), seed)).when(rule["hint"] == "query", F.col("_long")).when(rule["hint"] == "location", location(F.col("_named"), seed))
    text = F.to_json(told.otherwise(F.coalesce(rule["hint"], F.col("_short"))).cast("variant"))
    kind = rule["kind"]
    made = F.when(kind == "integer", number).when(kind == "number", F.concat(number, F.lit(".0"))).when(kind == "boolean", F.lit("true")).when(kind == "object", F.lit("{}")).otherwise(text)
    return F.concat(F.repeat(F.lit("["), rule["depth"]), F.coalesce(rule["fixed"], made), F.repeat(F.lit("]"), rule["depth"]))


def with_arguments(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """``calls`` (``tool, query, seed`` and more) with ``arguments``, a JSON object: every required argument, and the first optional one where the seed is even.

    A call of an unknown tool, or of one without rules, has ``{}``.
    """
    seed = F.col("seed")
    met = calls.join(rules(tools), "tool", "left")
    query = F.col("query")
    met = met.withColumns({"_named": named_location(query), "_found": small_numbers(query), "_long": task_phrase(query, 12), "_short": task_phrase(query, 6)})

    def pair(rule: Column) -> Column:
        own = F.when(rule["required"], stable_seed(seed, rule["name"], rule["pos"])).otherwise(stable_seed(seed, rule["name"]))
        return F.concat(F.to_json(rule["name"].cast("variant")), F.lit(":"), _value(rule, own))

    used = F.filter(F.coalesce("rules", F.array().cast(f"array<{RULE}>")), lambda r: r["required"] | (seed % 2 == 0))
    return met.withColumn("arguments", F.concat(F.lit("{"), F.array_join(F.transform(used, pair), ","), F.lit("}"))).drop("rules", "_named", "_found", "_long", "_short")
