"""Tools from OpenAPI specifications kept as a table: operations, references put in place, parameters as a JSON Schema.

What an operation's parameters and body refer to is resolved for all
specifications together, top down, one level in each round. A row is a node of a
schema with the references on its way: a reference is replaced by its target
from a table of references (``spec_id, ref, target``), or by ``{}`` where it
stands on its own way (a cycle); objects and lists become rows for what they
hold. Rounds end when only values are left, which the guard against cycles
ensures. Then the levels are put together again, bottom up, in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

METHODS = ("get", "post", "put", "patch", "delete")
_NONE = "array<string>"


def _list(text: Column) -> Column:
    """The elements of a JSON list as JSON texts; none for anything else."""
    raw, typed = F.from_json(text, "array<string>"), F.from_json(text, "array<variant>")
    both = F.transform(F.arrays_zip(raw.alias("raw"), typed.alias("typed")), lambda x: _json(x["raw"], x["typed"]))
    return F.when(text.rlike(r"^\s*\["), F.coalesce(both, F.array().cast(_NONE))).otherwise(F.array().cast(_NONE))


def _entries(text: Column) -> Column:
    """The entries of a JSON object in their order, values as JSON texts; none for anything else."""
    raw, typed = F.from_json(text, "map<string,string>"), F.from_json(text, "map<string,variant>")
    both = F.transform(F.arrays_zip(F.map_keys(raw).alias("key"), F.map_values(raw).alias("raw"), F.map_values(typed).alias("typed")), lambda x: F.struct(x["key"].alias("key"), _json(x["raw"], x["typed"]).alias("value")))
    return F.when(text.rlike(r"^\s*\{"), F.coalesce(both, F.array().cast("array<struct<key:string,value:string>>"))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))


def _json(raw: Column, typed: Column) -> Column:
    """A value's JSON text: objects and lists as they stand (a VARIANT would sort their keys), others by their type."""
    return F.when(F.schema_of_variant(typed).rlike("^(OBJECT|ARRAY)"), raw).otherwise(F.coalesce(F.to_json(typed), F.lit("null")))


def _quoted(text: Column) -> Column:
    return F.to_json(text.cast("variant"))


def _at(text: Column, path: Column | str) -> Column:
    return F.call_function("get_json_object", text, F.lit(path) if isinstance(path, str) else path)


def references(specs: DataFrame) -> DataFrame:
    """``spec_id, ref, target``: every local reference of a specification and the JSON that it stands for (``{}`` if nothing)."""
    found = F.array_distinct(F.regexp_extract_all("spec", F.lit(r'"\$ref"\s*:\s*"(#/[^"]*)"'), F.lit(1)))
    each = specs.select("spec_id", "spec", F.explode(found).alias("ref"))
    path = F.concat(F.lit("$"), F.array_join(F.transform(F.split(F.substr("ref", F.lit(3)), "/"), lambda p: F.concat(F.lit("['"), p, F.lit("']"))), ""))
    target = _at(F.col("spec"), path)
    return each.select("spec_id", "ref", F.when(target.rlike(r"^\s*[\[{]"), target).otherwise(F.lit("{}")).alias("target"))


def operations(specs: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """``spec_id, op, method, path, name, description, parameters (JSON texts), body`` of specifications ``spec_id, spec``."""
    paths = specs.select("spec_id", F.posexplode(_entries(_at(F.col("spec"), "$.paths"))).alias("place", "entry"))
    item = F.col("entry")["value"]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("rank"), F.lit(m).alias("method"), _at(item, f"$.{m}").alias("text")) for k, m in enumerate(methods))))
    rows = paths.select("spec_id", "place", F.col("entry")["key"].alias("path"), item.alias("item"), each.alias("o")).filter(F.col("o.text").rlike(r"^\s*\{"))
    op = F.col("o.text")
    slug = F.regexp_replace(F.regexp_replace("path", "[^a-zA-Z0-9]+", "_"), "^_+|_+$", "")
    name = F.coalesce(F.nullif(_at(op, "$.operationId"), F.lit("")), F.concat("o.method", F.lit("_"), F.coalesce(F.nullif(slug, F.lit("")), F.lit("root"))))
    said = F.coalesce(F.nullif(_at(op, "$.summary"), F.lit("")), F.nullif(_at(op, "$.description"), F.lit("")), F.concat(F.upper("o.method"), F.lit(" "), "path"))
    return rows.select(
        "spec_id", (F.col("place") * len(methods) + F.col("o.rank")).cast("int").alias("op"), "o.method", "path", name.alias("name"), said.alias("description"),
        F.concat(_list(_at(F.col("item"), "$.parameters")), _list(_at(op, "$.parameters"))).alias("parameters"), _at(op, "$.requestBody.content['application/json'].schema").alias("body"),
    )


def resolved(roots: DataFrame, refs: DataFrame) -> DataFrame:
    """``root`` (any columns as one struct ``root``, and ``spec_id``) with the JSON text ``node`` resolved."""
    refs = stored(refs, "references")
    rows = roots.select("spec_id", "root", "node", F.array().cast("array<int>").alias("way"), F.array().cast(_NONE).alias("seen"), F.lit(None).cast("string").alias("key"))
    levels = []
    while True:
        # references of this level, and references that they stand for
        while True:
            rows = stored(rows.withColumn("ref", F.regexp_extract(_at(F.col("node"), "$['$ref']"), "^#/.*$", 0)), "schema-nodes")
            is_ref = F.col("node").rlike(r"^\s*\{") & (F.coalesce("ref", F.lit("")) != "")
            if rows.filter(is_ref).isEmpty():
                break
            cycle = F.array_contains("seen", F.col("ref"))
            met = rows.filter(is_ref).join(refs, ["spec_id", "ref"], "left").select("spec_id", "root", F.when(cycle, F.lit("{}")).otherwise(F.coalesce("target", F.lit("{}"))).alias("node"), "way", F.array_append("seen", F.col("ref")).alias("seen"), "key")
            rows = rows.filter(~is_ref).drop("ref").unionByName(met)
        kind = F.when(F.col("node").rlike(r"^\s*\{"), "object").when(F.col("node").rlike(r"^\s*\["), "list").otherwise("value")
        levels.append(stored(rows.select("spec_id", "root", "way", "key", "node", kind.alias("kind"), "seen"), "schema-levels"))
        last = levels[-1]
        children = F.when(F.col("kind") == "object", _entries(F.col("node"))).otherwise(F.transform(_list(F.col("node")), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value"))))
        below = last.filter("kind != 'value'").select("spec_id", "root", "way", "seen", F.posexplode(children).alias("place", "child"))
        rows = stored(below.select("spec_id", "root", F.col("child.value").alias("node"), F.array_append("way", F.col("place")).alias("way"), "seen", F.col("child.key").alias("key")), "schema-nodes")
        if rows.isEmpty():
            break
    text = None
    for level in reversed(levels):
        made = level.select("spec_id", "root", "way", "key", "kind", "node")
        if text is not None:
            part = F.when(F.col("key").isNull(), F.col("text")).otherwise(F.concat(_quoted(F.col("key")), F.lit(":"), "text"))
            inside = text.groupBy("spec_id", "root", F.slice("way", 1, F.size("way") - 1).alias("way")).agg(F.array_sort(F.collect_list(F.struct(F.element_at("way", -1).alias("place"), part.alias("part")))).alias("parts"))
            made = made.join(inside, ["spec_id", "root", "way"], "left")
            parts = F.array_join(F.transform(F.coalesce("parts", F.array().cast("array<struct<place:int,part:string>>")), lambda p: p["part"]), ",")
        else:
            parts = F.lit("")
        whole = F.when(F.col("kind") == "object", F.concat(F.lit("{"), parts, F.lit("}"))).when(F.col("kind") == "list", F.concat(F.lit("["), parts, F.lit("]"))).otherwise(F.col("node"))
        text = stored(made.select("spec_id", "root", "way", "key", whole.alias("text")), "schema-texts")
    return text.select("spec_id", "root", F.col("text").alias("node"))


def tools(specs: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """``spec_id, op, method, path, name, description, parameters, places`` of specifications ``spec_id, spec`` (JSON texts).

    ``parameters`` is a JSON Schema of the arguments, ``places`` where each
    goes (``path``, ``query`` or ``body``). Path arguments are required. A
    parameter elsewhere, or without a name, is left out; of two of a name the
    later counts; a body argument gives way to a parameter. A specification that
    is null, no JSON or without paths has no tools.
    """
    ops = stored(operations(specs, methods), "operations")
    listed = ops.select("spec_id", "op", F.posexplode("parameters").alias("place", "node")).select("spec_id", F.struct("op", "place").alias("root"), "node")
    bodies = ops.filter(F.col("body").isNotNull()).select("spec_id", F.struct("op", F.lit(-1).alias("place")).alias("root"), F.col("body").alias("node"))
    nodes = resolved(listed.unionByName(bodies), references(specs)).select("spec_id", "root.op", "root.place", "node")
    where, arg = _at(F.col("node"), "$.in"), _at(F.col("node"), "$.name")
    schema, said = _at(F.col("node"), "$.schema"), _at(F.col("node"), "$.description")
    schema = F.when(schema.rlike(r"^\s*\{\s*\S") & (schema != "{}"), schema).otherwise(F.lit('{"type":"string"}'))
    with_text = F.when((F.coalesce(said, F.lit("")) != "") & _at(schema, "$.description").isNull(), F.concat(F.regexp_replace(schema, r"\}\s*$", ""), F.lit(',"description":'), _quoted(said), F.lit("}"))).otherwise(schema)
    needed = (where == "path") | (_at(F.col("node"), "$.required") == "true")
    argument = "struct<place:int,name:string,schema:string,where:string,required:boolean>"
    params = nodes.filter((F.col("place") >= 0) & where.isin("path", "query") & (F.coalesce(arg, F.lit("")) != "")).select("spec_id", "op", F.struct("place", arg.alias("name"), with_text.alias("schema"), where.alias("where"), F.coalesce(needed, F.lit(False)).alias("required")).cast(argument).alias("a"))
    params = params.groupBy("spec_id", "op").agg(F.array_sort(F.collect_list("a")).alias("given"))
    body = nodes.filter((F.col("place") < 0) & (_at(F.col("node"), "$.type") == "object"))
    body = body.select("spec_id", "op", _entries(_at(F.col("node"), "$.properties")).alias("fields"), F.coalesce(F.from_json(_at(F.col("node"), "$.required"), _NONE), F.array().cast(_NONE)).alias("wanted"))
    met = ops.drop("parameters", "body").join(params, ["spec_id", "op"], "left").join(body, ["spec_id", "op"], "left")
    met = met.withColumns({"given": F.coalesce("given", F.array().cast(f"array<{argument}>")), "fields": F.coalesce("fields", F.array().cast("array<struct<key:string,value:string>>")), "wanted": F.coalesce("wanted", F.array().cast(_NONE))})
    met = met.withColumn("names", F.array_distinct(F.transform("given", lambda a: a["name"])))
    first = F.transform("names", lambda n: F.element_at(F.filter("given", lambda a: a["name"] == n), -1))
    own = F.transform(first, lambda a: F.struct(a["name"].alias("name"), a["schema"].alias("schema"), a["where"].alias("where")))
    more = F.transform(F.filter("fields", lambda f: ~F.array_contains("names", f["key"])), lambda f: F.struct(f["key"].alias("name"), f["value"].alias("schema"), F.lit("body").alias("where")))
    required = F.transform(F.filter("given", lambda a: a["required"]), lambda a: a["name"])
    met = met.withColumns({"all": F.concat(own, more), "needed": F.concat(required, F.filter("wanted", lambda w: ~F.array_contains(required, w)))})
    schemas = F.array_join(F.transform("all", lambda a: F.concat(_quoted(a["name"]), F.lit(":"), a["schema"])), ",")
    places = F.array_join(F.transform("all", lambda a: F.concat(_quoted(a["name"]), F.lit(":"), _quoted(a["where"]))), ",")
    text = F.concat(F.lit('{"type":"object","properties":{'), schemas, F.lit('},"required":['), F.array_join(F.transform("needed", _quoted), ","), F.lit("]}"))
    return met.select("spec_id", "op", "method", "path", "name", "description", text.alias("parameters"), F.concat(F.lit("{"), places, F.lit("}")).alias("places"))
