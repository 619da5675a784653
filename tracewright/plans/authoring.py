"""Generation, rewards, siblings and demonstrations over the input tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sql import register
from ..operators import rewards
from ..operators.demonstrations import scenario_of, scenarios
from ..operators.episodes import collected
from ..operators.generation import Recipe, generated, planned, run_recipe
from ..operators.siblings import held_out
from .tables import table, views


def completion_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON out of prose: event properties fenced, bare, within a sentence or broken."""
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\ndone"))).when(k == 1, F.col("props")).when(k == 2, F.concat(F.lit("I call "), "props", F.lit(" now."))).otherwise(F.concat(F.lit("{broken "), "props"))
    found = table(spark, sf_dir, "events").select("event_id", rewards.extracted_json(text).alias("j"))
    return found.select("event_id", F.get_json_object("j", "$.k").cast("bigint").alias("k"))


def completion_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards of completions that call an event's type; two of five tools are offered, purchases need an argument."""
    call = F.to_json(F.struct(F.col("event_type").alias("tool"), F.from_json("props", "struct<k:bigint>").alias("args")))
    text = F.when(F.col("event_id") % 5 == 0, F.lit("no call")).otherwise(F.concat(F.lit("I try "), call))
    tools = F.array(F.struct(F.lit("view").alias("name"), F.array(F.lit("k")).alias("required")), F.struct(F.lit("purchase").alias("name"), F.array(F.lit("k"), F.lit("amount")).alias("required")))
    return table(spark, sf_dir, "events").select("event_id", rewards.completion_reward(text, tools).alias("reward"))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered SQL functions over the labels of every source."""
    register(spark)
    views(spark, sf_dir, "documents", "labels")
    return spark.sql("""
        SELECT source, n, wilson_lo(p, n) AS lo, wilson_hi(p, n) AS hi, stable_seed(source, '7') AS seed
        FROM (SELECT source, count(*) AS n, sum(quality) AS p FROM documents JOIN labels USING (doc_id) GROUP BY source)""")


def generated_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of three rounds through the benchmark items, and the tool that its trajectories call."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.col("text").alias("query"))
    recipe = Recipe("bench", count=3 * queries.count())
    rows = generated(planned(queries, recipe.count, recipe.modes), recipe)
    tool = F.try_element_at(F.transform(F.filter("steps", lambda s: s["step_type"] == "tool_call"), lambda s: s["tool_name"]), F.lit(1))
    return rows.select("ord", "id", "mode", F.coalesce(tool, F.lit("")).alias("tool"), F.size("steps").cast("bigint").alias("num_steps"))


def recipe_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a recipe of two rounds through the benchmark items."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.col("text").alias("query"))
    return run_recipe(spark, Recipe("bench", count=2 * queries.count()), queries)["metrics"]


def held_out_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Siblings of one-nation scenarios, made on the executors."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name")

    name = F.col("n_nationkey").cast("string").alias("scenario_id")
    cells = rows.select(name, F.lit(0).alias("row"), F.lit(1).alias("col"), F.col("n_name").alias("text"))
    texts = rows.select(name, F.lit("task").alias("place"), F.concat(F.lit("Which key has "), "n_name", F.lit("?")).alias("text")).unionByName(rows.select(name, F.lit("answer").alias("place"), F.col("n_name").alias("text")))
    _, found = held_out(cells, texts, F.col("scenario_id").cast("long"))
    one = lambda place: F.max(F.when(F.col("place") == place, F.col("text")))
    out = found.groupBy("scenario_id", "sibling_id").agg(one("task").alias("task"), one("answer").alias("label"))
    return out.select(F.col("scenario_id").cast("bigint").alias("n_nationkey"), F.col("sibling_id").alias("id"), "task", "label")


def demonstrated_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios from a demonstration per region, played by a policy that repeats it or does nothing."""
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("ord"), "r_name")

    key = F.col("ord").cast("string")
    row = F.to_json(F.array(F.array(key, F.col("r_name")), F.array(F.lit("99"), F.lit("other"))))
    action = F.concat(F.lit("UPDATE region SET name = name || '!' WHERE id = "), key)
    demos = regions.select(
        F.concat(F.lit("region-"), key).alias("scenario_id"), F.concat(F.lit("Mark "), "r_name", F.lit(".")).alias("task"), F.lit("CREATE TABLE region (id INTEGER PRIMARY KEY, name TEXT)").alias("schema"),
        F.lit("region").alias("table"), row.alias("rows"), F.to_json(F.array(action)).alias("actions"), F.lit(None).cast("string").alias("answer"), F.lit(None).cast("int").alias("max_steps"),
    )

    def make(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                number = int(r["scenario_id"].split("-")[1])
                plan = [f"UPDATE region SET name = name || '!' WHERE id = {number}"] if number % 2 == 0 else ["SELECT * FROM region"]
                out.append((number, json.dumps({**scenario_of(r), "plan": plan})))
            yield pd.DataFrame(out, columns=["ord", "scenario"])

    def policy(seen, episode):
        done = len(episode.steps)
        plan = episode.scenario["plan"]
        return {"query": plan[done]} if done < len(plan) else {"answer": "done"}

    made = scenarios(demos).mapInPandas(make, "ord long, scenario string")
    return collected(made, policy, json.loads).select("ord", "scenario_id", "passed", "outcome", "reward", "steps")


QUERIES = {f.__name__: f for f in (completion_json, completion_rewards, sql_functions, generated_plan, recipe_metrics, held_out_siblings, demonstrated_scenarios)}

_SEED = "CAST(('0x' || substr(sha256({}), 1, 12)) AS BIGINT)"
ORACLES = {
    "completion_json": "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events",
    "completion_rewards": """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0e0 ELSE round(1/3e0 + CASE WHEN event_type IN ('view', 'purchase') THEN 1/3e0 ELSE 0e0 END + CASE WHEN event_type = 'view' THEN 1/3e0 ELSE 0e0 END, 6) END AS reward FROM events""",
    "sql_functions": f"""
WITH m AS (SELECT source, count(*) AS n, sum(quality)::BIGINT AS p FROM documents JOIN labels USING (doc_id) GROUP BY 1), r AS (SELECT *, p / n::DOUBLE AS r FROM m)
SELECT source, n, round(greatest((r + 3.8416e0/(2e0*n) - 1.96e0*sqrt(r*(1-r)/n + 3.8416e0/(4e0*n*n))) / (1 + 3.8416e0/n), 0), 4)::DOUBLE AS lo,
  round(least((r + 3.8416e0/(2e0*n) + 1.96e0*sqrt(r*(1-r)/n + 3.8416e0/(4e0*n*n))) / (1 + 3.8416e0/n), 1), 4)::DOUBLE AS hi, {_SEED.format("source || '||7'")} AS seed FROM r""",
    "generated_plan": f"""
WITH b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS place, text AS q FROM benchmark),
p AS (SELECT ord, q, CASE ord % 3 WHEN 0 THEN 'single_agent' WHEN 1 THEN 'multi_agent' ELSE 'code_execution' END AS mode FROM (SELECT unnest(range(0, 3 * (SELECT count(*) FROM benchmark))) AS ord) AS t JOIN b ON place = ord % (SELECT count(*) FROM benchmark)),
s AS (SELECT *, {_SEED.format("q || '||' || ord || '||' || mode || '||0'")} AS seed FROM p)
SELECT ord, lpad(lower(hex(seed)), 12, '0') AS id, mode, CASE WHEN mode = 'code_execution' THEN '' ELSE ['search', 'lookup', 'calculate'][seed % 3 + 1] END AS tool, CASE mode WHEN 'single_agent' THEN 4 WHEN 'multi_agent' THEN 5 ELSE 3 END::BIGINT AS num_steps FROM s""",
    "held_out_siblings": """
SELECT n_nationkey::BIGINT AS n_nationkey, n_nationkey || '~sibling' AS id, 'Which key has ' || reverse(n_name) || n_nationkey || '?' AS task, reverse(n_name) || n_nationkey AS label FROM nation""",
    "demonstrated_scenarios": """
SELECT r_regionkey::BIGINT AS ord, 'region-' || r_regionkey AS scenario_id, r_regionkey % 2 = 0 AS passed, CASE WHEN r_regionkey % 2 = 0 THEN 1e0 ELSE round(2/3e0, 6) END AS outcome,
  CASE WHEN r_regionkey % 2 = 0 THEN 1e0 ELSE round(0.6 * round(2/3e0, 6) + 0.4, 6) END AS reward, 1::INTEGER AS steps FROM region""",
}
