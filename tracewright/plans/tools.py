"""Tools, their arguments, requests and exports of runs that call tools, over pages, events and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import CITIES, GENERATOR_STOP_WORDS, STAND_IN_CITIES
from ..functions.hashing import stable_seed
from ..functions.synthesis import expression, generator_tokens, named_location, small_numbers, value_of
from ..operators import generation as G
from ..operators import judge as J
from ..operators import learned, openapi, profile, requests
from ..operators.arguments import with_arguments
from ..operators.schema import STEP, TOOL, VERIFICATION, step
from ..sources import writers
from ..sources.shared import folder
from .tables import NAMES, table
from .trajectories import _T, trajectories

#: A schema with arrays three levels deep, made for each event type (``@``).
SCHEMA = (
    '{"type":"object","properties":{"city":{"type":"string"},"@_id":{"type":"integer"},"grid":{"type":"array","items":{"type":"array","items":{"type":"array","items":{"type":"number"}}}},'
    '"mode":{"type":"string","enum":["fast","slow"]},"expression":{"type":"string"},"tags":{"type":"array","items":{"enum":[7,8]}},"note":{},"options":{"type":"object"}},'
    '"required":["city","@_id","grid","mode","expression","tags"]}'
)


def synthesized_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments of a call for every document, for the tool of the event of its number."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("tool"))
    tools = events.select("tool").distinct().withColumn("parameters", F.replace(F.lit(SCHEMA), F.lit("@"), F.col("tool")))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("query"), stable_seed(F.col("doc_id")).alias("seed"))
    calls = docs.join(events, docs["doc_id"] == events["event_id"]).drop("event_id")
    return with_arguments(calls, tools).select("doc_id", "tool", "arguments")


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The location that each document names, if any."""
    docs = table(spark, sf_dir, "documents").select("doc_id", named_location(F.concat(F.col("text"), F.when(F.col("doc_id") % 7 == 0, F.lit(" a flight to new york.")).otherwise(F.lit("")))).alias("place"))
    return docs.filter(F.col("place").isNotNull())


def expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression from the numbers of each document, and what it comes to."""
    text = expression(small_numbers(F.col("text")), stable_seed(F.col("doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("expression")).withColumn("value", value_of(F.col("expression")))


def generator_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the generator's tokens keep, and a digest of them."""
    words = table(spark, sf_dir, "documents").select("doc_id", generator_tokens(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").cast("bigint").alias("n"), F.md5(F.array_join("w", " ")).alias("words_md5"))


def page_specs(pages: DataFrame) -> DataFrame:
    """An OpenAPI specification for every page: references, a reference to a reference, a cycle, and a path for its host."""
    host, page = F.parse_url("url", F.lit("HOST")), F.col("page_id").cast("string")
    text = F.concat(
        F.lit('{"servers":[{"url":"https://'), host, F.lit('"}],"paths":{"/'), host, F.lit('/{lang}":{"parameters":[{"$ref":"#/components/parameters/Lang"}],"get":{'),
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('"operationId":"find_'), page, F.lit('",'))).otherwise(F.lit("")),
        F.lit('"parameters":[{"name":"q","in":"query","required":'), (F.col("page_id") % 3 == 0).cast("string"), F.lit(',"description":"say \\"what\\"","schema":{"$ref":"#/components/schemas/Alias"}},{"name":"X","in":"header"}]},'),
        F.lit('"post":{"summary":"Make","requestBody":{"content":{"application/json":{"schema":{"$ref":"#/components/schemas/Node"}}}}}}},'),
        F.lit('"components":{"parameters":{"Lang":{"name":"lang","in":"path"}},"schemas":{"Word":{"type":"string","maxLength":'), F.char_length("url").cast("string"),
        F.lit('},"Alias":{"$ref":"#/components/schemas/Word"},"Node":{"type":"object","required":["name"],"properties":{"name":{"$ref":"#/components/schemas/Alias"},"child":{"$ref":"#/components/schemas/Node"},"tags":{"type":"array","items":{"$ref":"#/components/schemas/Word"}}}}}}}'),
    )
    return pages.select(F.col("page_id").alias("spec_id"), text.alias("spec"))


def openapi_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = openapi.tools(page_specs(table(spark, sf_dir, "pages").select("page_id", "url")))
    return found.select(F.col("spec_id").alias("page_id"), "method", "path", "name", "description", "parameters", "places")


def cached_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a request, in two calls: the second finds what the first has left in the cache."""
    path = f"{folder(spark)}/tracewright/request-cache-{uuid.uuid4().hex}"
    asked = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit(" "), F.col("props")).alias("prompt"))
    asked = asked.withColumn("key", requests.request_key(model=F.lit("stand-in"), messages=F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))), temperature=F.lit(0.0)))

    def answer(batch: DataFrame) -> DataFrame:
        return batch.select("key", F.md5("prompt").alias("text"))

    first = requests.answered(asked.filter("event_id % 4 = 0"), path, answer)
    rest = requests.answered(asked.filter("event_id % 4 != 0"), path, answer)
    return first.unionByName(rest).select("event_id", "text", "hit")


def paced_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start times of all events as requests that are five minutes apart at least, in microseconds."""
    asked = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("arrival"))
    return requests.paced(asked, "arrival", 300_000_000, "event_id").select("event_id", F.col("start").alias("start_us"), (F.col("start") - F.col("arrival")).alias("wait_us"))


def first_seen_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.first_seen(table(spark, sf_dir, "documents"), "source", "doc_id").select("source", F.col("first").alias("doc_id"), "place")


def seed_task_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tasks as there are documents, from those of three sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("domain"))
    return G.sampled_tasks(docs, "doc_id", docs.count(), ["src1", "src2", "src3"], seed=11).select("idx", "doc_id")


def judge_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judging model would read of every conversation."""
    return trajectories(spark, sf_dir).select(F.col("ord").alias("conv_id"), F.md5(J.transcript()).alias("transcript_md5"), F.char_length(J.transcript()).cast("bigint").alias("chars"))


def lenient_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all events read from JSON values of several kinds."""
    v = F.col("value").cast("string")
    kinds = [v, F.concat(F.lit('" '), v, F.lit(' "')), F.when(F.col("value") > 50, "true").otherwise("false"), F.concat(F.lit('"'), F.col("event_type"), F.lit('"')), F.lit("null")]
    told = F.element_at(F.array(*kinds), (F.col("event_id") % len(kinds) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", J.lenient_score(told).alias("score"))


def tool_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for every user: each event is a call with nested arguments and an observation with marks that JSON has to escape."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    args = F.concat(F.lit('{"at":{"id":'), F.col("event_id").cast("string"), F.lit(',"tag":"\\u0002'), "event_type", F.lit('\\u0003"},"props":'), F.col("props"), F.lit("}"))
    call = step("tool_call", agent=F.lit("worker"), tool_name=F.col("event_type"), tool_args=args)
    seen = step("observation", observation=F.concat(F.lit('\x02"'), F.col("value").cast("string"), F.lit('"\x03')))
    runs = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.array(call, seen).alias("steps")))).alias("by"), F.avg("value").alias("mean"))
    answer = F.concat(F.lit("\x02 done by "), F.col("user_id").cast("string"), F.lit("\x03"))
    steps = F.concat(F.flatten(F.transform("by", lambda x: x["steps"])), F.array(step("final_answer", content=answer)))
    return runs.select(
        F.col("user_id").alias("ord"), F.col("user_id").cast("string").alias("id"), F.lit("\x02 all events \x03").alias("query"), F.lit("single_agent").alias("mode"), F.lit(None).cast("string").alias("domain"),
        F.array().cast(f"array<{TOOL}>").alias("tools"), steps.cast(f"array<{STEP}>").alias("steps"), answer.alias("final_answer"), F.lit(True).alias("success"), F.lit("events").alias("generator_model"), F.lit("{}").alias("metadata"),
        F.lit(0.0).alias("created_at"), F.lit(None).cast(VERIFICATION).alias("verification"), F.round("mean", 2).alias("reward"),
    )


def tool_jsonl_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported lines, read again: the arguments of each call from the steps and from the messages, and the observations."""
    lines = writers.jsonl(tool_runs(spark, sf_dir))
    kind = "struct<id:string,query:string,steps:array<struct<step_type:string,tool_args:struct<at:struct<id:bigint,tag:string>,props:struct<k:bigint>>,observation:string>>,messages:array<struct<role:string,tool_calls:array<struct<name:string,arguments:struct<at:struct<id:bigint>,props:struct<k:bigint>>>>>>,final_answer:string>"
    read = lines.select(F.from_json("value", kind).alias("r")).select("r.*")
    calls = F.flatten(F.transform("messages", lambda m: F.coalesce(m["tool_calls"], F.array().cast("array<struct<name:string,arguments:struct<at:struct<id:bigint>,props:struct<k:bigint>>>>"))))
    # both lists are made once for each line, not for each of its calls
    lists = read.select(F.col("id").cast("bigint").alias("user_id"), "query", "final_answer", F.filter("steps", lambda s: s["step_type"] == "tool_call").alias("s"), calls.alias("c"))
    each = lists.select("user_id", "query", "final_answer", F.explode(F.arrays_zip("s", "c")).alias("z")).select("user_id", "query", "final_answer", "z.s", "z.c").filter("s is not null")
    return each.select("user_id", F.col("s.tool_args.at.id").alias("event_id"), F.col("s.tool_args.at.tag").alias("tag"), F.col("s.tool_args.props.k").alias("k"), F.col("c.arguments.at.id").alias("called_id"), F.col("c.name").alias("called"), "query", "final_answer")


def tool_sharegpt_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = writers.sharegpt(tool_runs(spark, sf_dir)).select(F.col("id").cast("bigint").alias("user_id"), F.posexplode("conversations").alias("place", "c"))
    return found.select("user_id", F.col("place").cast("bigint").alias("place"), F.col("c.from").alias("speaker"), F.col("c.value").alias("value"))


def tool_adp_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = writers.adp(tool_runs(spark, sf_dir)).select(F.col("id").cast("bigint").alias("user_id"), F.posexplode("steps").alias("place", "s"))
    return found.select("user_id", F.col("place").cast("bigint").alias("place"), F.col("s.type").alias("kind"), F.col("s.content").alias("content"))


def tool_grpo_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.grpo(tool_runs(spark, sf_dir))


def table_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds, nulls and keys of all columns of all given tables."""
    rows = [(name, c["column"], c["kind"], c["rows"], c["nulls"], c["is_key"]) for name in NAMES for c in profile.profile(table(spark, sf_dir, name))]
    return spark.createDataFrame(rows, "table_name string, column string, kind string, n bigint, nulls bigint, is_key boolean")


def schema_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starter scenarios of every given table with an integer key and a text."""
    return profile.packs({name: table(spark, sf_dir, name) for name in NAMES})


def calibrated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of a calibrated score: the quality of labelled documents by the logarithm of their length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.log(F.col("n_chars") + 1.0).alias("score"))
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return learned.reliability_bins(learned.calibrated(rows, learned.calibration(rows)))


QUERIES = {f.__name__: f for f in (table_profiles, schema_packs, calibrated_scores, synthesized_arguments, locations, expressions, generator_words, openapi_tools, cached_requests, paced_requests, first_seen_sources, seed_task_cycle, judge_transcripts, lenient_scores, tool_jsonl_export, tool_sharegpt_export, tool_adp_export, tool_grpo_export)}

_SEED = "CAST(('0x' || substr(sha256({}), 1, 12)) AS BIGINT)"
_APART = r"[^\p{L}\p{N}\p{M}_]"
_LISTED = ", ".join(f"'{c}'" for c in sorted(CITIES, key=len, reverse=True))


def _named(t: str) -> str:
    """The longest city that stands apart in the text ``t``, else a name after a preposition."""
    name = rf"(^|{_APART})(?:in|at|for|near|to|from)\s+([A-Z][\p{{L}}\p{{N}}\p{{M}}_.\-]+(?:\s+[A-Z][\p{{L}}\p{{N}}\p{{M}}_.\-]+)?)"
    first = rf"list_filter(list_filter([{_LISTED}], lambda c: contains(lower({t}), c)), lambda c: regexp_matches(lower({t}), '(^|{_APART})' || c || '($|{_APART})'))[1]"
    given = rf"regexp_replace(regexp_extract({t}, '{name}', 2), '\s+', ' ', 'g')"
    return rf"coalesce(array_to_string(list_transform(string_split({first}, ' '), lambda x: upper(x[1]) || x[2:]), ' '), CASE WHEN length({given}) >= 3 AND lower({given}) NOT IN {GENERATOR_STOP_WORDS} THEN {given} END)"


_ARITH = "CASE WHEN len(nums) >= 2 THEN nums[1] || ' + ' || nums[2] WHEN len(nums) = 1 THEN nums[1] || ' * 2' ELSE ({s} % 20 + 2) || ' * (' || ({s} // 7 % 9 + 1) || ' + 1)' END"
_NUMS = r"list_transform(list_filter(list_transform(regexp_extract_all(text, '-?[0-9]+(?:\.[0-9]+)?'), lambda x: try_cast(x AS DOUBLE)), lambda x: abs(x) < 1e6), lambda x: CAST(trunc(x) AS BIGINT))"
_PHRASE = r"array_to_string(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[1:6], ' ')"
_VALUE = "CASE WHEN len(nums) >= 2 THEN nums[1] + nums[2] WHEN len(nums) = 1 THEN nums[1] * 2 ELSE (s % 20 + 2) * (s // 7 % 9 + 2) END"
_RUNS = """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""
_ARGS = """'{"at":{"id":' || event_id || ',"tag":"\\u0002' || event_type || '\\u0003"},"props":{"k":' || json_extract_string(props, '$.k') || '}}'"""
_SEEN = "chr(2) || '\"' || {v} || '\"' || chr(3)"
_DONE = "chr(2) || ' done by ' || user_id || chr(3)"

# The columns of the given tables, i integer, d number, t text, z time, o other.
_COLUMNS = {
    "region": "r_regionkey i, r_name t",
    "nation": "n_nationkey i, n_name t, n_regionkey i",
    "customer": "c_custkey i, c_name t, c_nationkey i, c_acctbal d, c_mktsegment t",
    "supplier": "s_suppkey i, s_name t, s_nationkey i, s_acctbal d",
    "part": "p_partkey i, p_name t, p_brand t, p_type t, p_size i, p_retailprice d",
    "orders": "o_orderkey i, o_custkey i, o_orderstatus t, o_totalprice d, o_orderdate z, o_orderpriority t",
    "lineitem": "l_orderkey i, l_partkey i, l_suppkey i, l_linenumber i, l_quantity d, l_extendedprice d, l_discount d, l_tax d, l_returnflag t, l_linestatus t, l_shipdate z",
    "events": "event_id i, ts z, user_id i, event_type t, value d, props t",
    "documents": "doc_id i, text t, lang t, source t, n_chars i",
    "embeddings": "vec_id i, embedding o, label i",
    "pages": "page_id i, url t, html t",
    "benchmark": "item_id i, text t",
    "labels": "doc_id i, quality i, toxic i",
    "conversations": "conv_id i, turn i, role t, text t",
}
_KIND = {"i": "integer", "d": "number", "t": "text", "z": "time", "o": "other"}


def _unique(name: str, column: str) -> str:
    return f"(SELECT count(*) > 0 AND count(*) = count({column}) AND count({column}) = count(DISTINCT {column}) FROM {name})"


def _profiles_sql() -> str:
    columns = [(name, *c.split()) for name, listed in _COLUMNS.items() for c in listed.split(", ")]
    return " UNION ALL ".join(f"SELECT '{name}' AS table_name, '{c}' AS \"column\", '{_KIND[k]}' AS kind, count(*) AS n, count(*) - count({c}) AS nulls, {'false' if k == 'o' else _unique(name, c)} AS is_key FROM {name}" for name, c, k in columns)


def _packs_sql() -> str:
    """For every choice of key and text its scenarios, where the data make that choice."""
    parts = []
    for name, listed in _COLUMNS.items():
        columns = [c.split() for c in listed.split(", ")]
        keys, texts = [c for c, k in columns if k == "i"], [c for c, k in columns if k == "t"]
        texts = [c for c in texts if any(x in c for x in profile.STATES)] + [c for c in texts if not any(x in c for x in profile.STATES)]
        for a, key in enumerate(keys):
            for b, text in enumerate(texts):
                chosen = " AND ".join([_unique(name, key), f"NOT {_unique(name, text)}", *(f"NOT {_unique(name, c)}" for c in keys[:a]), *(_unique(name, c) for c in texts[:b])])
                row = f"(SELECT arg_min({text}, {key}) AS v, min({key})::BIGINT AS key FROM {name} WHERE {text} <> 'done' AND {chosen})"
                parts.append(f"SELECT '{name}/update' AS scenario_id, 'Set {text} of the row of {name} with {key} ' || key || ' to done.' AS task, key, v AS value, 'done' AS expected FROM {row} WHERE key IS NOT NULL")
                parts.append(f"SELECT '{name}/count', 'How many rows of {name} have the {text} ' || v || '?', key, v, (SELECT count(*) FROM {name} WHERE {text} = v)::VARCHAR FROM {row} WHERE key IS NOT NULL")
    return " UNION ALL ".join(parts)


def _newton(steps: int) -> str:
    """The fit as unrolled steps: f<k> holds a and b."""
    sql = """WITH r AS (SELECT ln(n_chars + 1e0) AS s, quality::DOUBLE AS y FROM documents JOIN labels USING (doc_id)),
c AS (SELECT count(*)::DOUBLE AS n, sum(y) AS w FROM r), t AS (SELECT s, y, CASE WHEN y = 1 THEN (w + 1) / (w + 2) ELSE 1 / (n - w + 2) END AS t FROM r, c),
f0 AS (SELECT 0e0 AS a, ln(avg(t) / (1 - avg(t))) AS b FROM t)"""
    for k in range(1, steps + 1):
        sql += f""",
g{k} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum((t - p) * s) AS g1, sum(t - p) AS g0, sum(p * (1 - p) * s * s) AS h11, sum(p * (1 - p) * s) AS h10, sum(p * (1 - p)) AS h00 FROM (SELECT *, 1 / (1 + exp(-(s * a + b))) AS p FROM t, f{k - 1})),
f{k} AS (SELECT a + (h00 * g1 - h10 * g0) / (h11 * h00 - h10 * h10) AS a, b + (h11 * g0 - h10 * g1) / (h11 * h00 - h10 * h10) AS b FROM g{k})"""
    return sql


ORACLES = {
    "table_profiles": _profiles_sql(),
    "schema_packs": _packs_sql(),
    "calibrated_scores": f"""{_newton(12)}, p AS (SELECT y, 1 / (1 + exp(-(s * a + b))) AS p FROM t, f12)
SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 4) AS mean_probability, round(avg(y), 4) AS rate, round(avg(pow(p - y, 2)), 4) AS brier FROM p GROUP BY 1""",
    "synthesized_arguments": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, event_type AS tool, {_SEED.format("doc_id::VARCHAR")} AS s FROM documents JOIN events ON event_id = doc_id),
v AS (SELECT *, {_NUMS} AS nums, {_named("text")} AS named, {_SEED.format("s || '||city||0'")} AS s0, {_SEED.format("s || '||' || tool || '_id||1'")} AS s1, {_SEED.format("s || '||grid||2'")} AS s2, {_SEED.format("s || '||expression||4'")} AS s4 FROM d)
SELECT doc_id, tool, '{{"city":' || to_json(coalesce(named, {list(STAND_IN_CITIES)!r}[s0 % 8 + 1])) || ',"' || tool || '_id":' || (s1 % 7 + 2) || ',"grid":[[[' || (s2 % 7 + 2) || '.0]]],"mode":"fast","expression":' || to_json({_ARITH.format(s="s4")}) || ',"tags":[7]'
  || CASE WHEN s % 2 = 0 THEN ',"note":' || to_json(coalesce(nullif({_PHRASE}, ''), 'the requested task')) ELSE '' END || '}}' AS arguments
FROM v""",
    "locations": f"SELECT * FROM (SELECT doc_id, {_named('text')} AS place FROM (SELECT doc_id, text || CASE WHEN doc_id % 7 = 0 THEN ' a flight to new york.' ELSE '' END AS text FROM documents)) WHERE place IS NOT NULL",
    "expressions": f"WITH d AS (SELECT doc_id, {_NUMS} AS nums, {_SEED.format('doc_id::VARCHAR')} AS s FROM documents) SELECT doc_id, {_ARITH.format(s='s')} AS expression, {_VALUE} AS value FROM d",
    "generator_words": f"WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: x NOT IN {GENERATOR_STOP_WORDS}) AS w FROM documents) SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS words_md5 FROM w",
    "openapi_tools": r"""
WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, '{"type":"string","maxLength":' || length(url) || '}' AS word, '{"type":"string","maxLength":' || length(url) || ',"description":"say \"what\""}' AS said FROM pages)
SELECT page_id, 'get' AS method, '/' || host || '/{lang}' AS path, CASE WHEN page_id % 2 = 0 THEN 'find_' || page_id ELSE 'get_' || trim(regexp_replace(host || '/{lang}', '[^a-zA-Z0-9]+', '_', 'g'), '_') END AS name, 'GET /' || host || '/{lang}' AS description,
  '{"type":"object","properties":{"lang":{"type":"string"},"q":' || said || '},"required":["lang"' || CASE WHEN page_id % 3 = 0 THEN ',"q"' ELSE '' END || ']}' AS parameters, '{"lang":"path","q":"query"}' AS places FROM p
UNION ALL SELECT page_id, 'post', '/' || host || '/{lang}', 'post_' || trim(regexp_replace(host || '/{lang}', '[^a-zA-Z0-9]+', '_', 'g'), '_'), 'Make',
  '{"type":"object","properties":{"lang":{"type":"string"},"name":' || word || ',"child":{},"tags":{"type":"array","items":' || word || '}},"required":["lang","name"]}', '{"lang":"path","name":"body","child":"body","tags":"body"}' FROM p""",
    "cached_requests": "WITH e AS (SELECT event_id, md5(event_type || ' ' || props) AS text FROM events) SELECT event_id, text, event_id % 4 <> 0 AND text IN (SELECT text FROM e WHERE event_id % 4 = 0) AS hit FROM e",
    "paced_requests": """WITH e AS (SELECT event_id, epoch_us(ts) AS a, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events), s AS (SELECT event_id, a, max(a - i * 300000000) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) + i * 300000000 AS s FROM e)
SELECT event_id, s::BIGINT AS start_us, (s - a)::BIGINT AS wait_us FROM s""",
    "first_seen_sources": "SELECT source, doc_id, row_number() OVER (ORDER BY doc_id, source) - 1 AS place FROM (SELECT source, min(doc_id) AS doc_id FROM documents WHERE source IS NOT NULL GROUP BY 1)",
    "seed_task_cycle": f"""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY {_SEED.format("'11||' || doc_id")}, doc_id) - 1 AS k, count(*) OVER () AS n FROM documents WHERE source IN ('src1', 'src2', 'src3'))
SELECT idx, doc_id FROM range(0, (SELECT count(*) FROM documents)) AS r(idx) JOIN p ON p.k = idx % p.n""",
    "judge_transcripts": rf"""{_T},
k AS (SELECT conv_id, string_agg((step_idx + 1) || '. ' || CASE WHEN step_type = 'thought' THEN '(assistant) THOUGHT: ' WHEN step_type = 'observation' THEN 'OBSERVATION: ' ELSE 'FINAL_ANSWER: ' END || regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10) ORDER BY step_idx) AS lines FROM s GROUP BY 1),
r AS (SELECT conv_id, 'USER QUERY:' || chr(10) || query || chr(10) || chr(10) || 'MODE: single_agent' || chr(10) || chr(10) || 'TRAJECTORY STEPS:' || chr(10) || coalesce(lines || chr(10), '') || chr(10) || 'FINAL ANSWER:' || chr(10) || final_answer || chr(10) || chr(10) || '{J.REQUEST}' AS t FROM t LEFT JOIN k USING (conv_id))
SELECT conv_id, md5(t) AS transcript_md5, length(t) AS chars FROM r""",
    "lenient_scores": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN value WHEN 1 THEN value WHEN 2 THEN CASE WHEN value > 50 THEN 1e0 ELSE 0e0 END ELSE 0e0 END AS score FROM events",
    "tool_jsonl_export": f"{_RUNS} SELECT user_id, event_id, chr(2) || event_type || chr(3) AS tag, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id AS called_id, event_type AS called, chr(2) || ' all events ' || chr(3) AS query, {_DONE} AS final_answer FROM e",
    "tool_sharegpt_export": f"""{_RUNS}
SELECT DISTINCT user_id, 0::BIGINT AS place, 'human' AS speaker, chr(2) || ' all events ' || chr(3) AS value FROM e
UNION ALL SELECT user_id, 1 + 2 * i, 'function_call', '{{"name":"' || event_type || '","arguments":' || {_ARGS} || '}}' FROM e
UNION ALL SELECT user_id, 2 + 2 * i, 'observation', {_SEEN.format(v="value")} FROM e
UNION ALL SELECT DISTINCT user_id, 2 * n + 1, 'gpt', {_DONE} FROM e""",
    "tool_adp_export": f"""{_RUNS}
SELECT user_id, (2 * i)::BIGINT AS place, 'tool_call' AS kind, '{{"tool":"' || event_type || '","args":' || {_ARGS} || '}}' AS content FROM e
UNION ALL SELECT user_id, 2 * i + 1, 'observation', {_SEEN.format(v="value")} FROM e
UNION ALL SELECT DISTINCT user_id, 2 * n, 'final_answer', {_DONE} FROM e""",
    "tool_grpo_export": f"""{_RUNS}, m AS (SELECT user_id, round(avg(value), 2) AS reward FROM events GROUP BY 1)
SELECT chr(2) || ' all events ' || chr(3) AS prompt, '{{"tool":"' || event_type || '","args":' || {_ARGS} || '}}' AS completion, reward FROM e JOIN m USING (user_id) WHERE i = 0""",
}
