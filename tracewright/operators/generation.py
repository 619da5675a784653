"""Declarative generation: a recipe's plan, templated trajectories, and the whole run up to export."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import stable_seed
from ..functions.text import phrase
from ..sources.shared import stored
from . import judge, similarity, steps
from .numbering import numbered
from .schema import MODES, STEP, TOOL, VERIFICATION, step
from .verify import verified


@dataclass(frozen=True)
class Recipe:
    """What to generate and what to do with it."""

    name: str
    count: int | None = None
    modes: tuple[str, ...] = MODES
    seed: int = 0
    dedup: bool = True
    dedup_threshold: float = 0.85
    dedup_method: str = "pairwise"
    verify: bool = True
    preset: str = "balanced"
    tools: tuple[tuple[str, tuple[str, ...]], ...] = field(default=(("search", ("query",)), ("lookup", ("key",)), ("calculate", ("expression",))))


def planned(queries: DataFrame, count: int | None, modes: tuple[str, ...]) -> DataFrame:
    """``ord, query, mode``: one row per query, or ``count`` rows that cycle through the queries (``ord, query``), however many they are."""
    bank = stored(numbered(queries, [F.col("ord")], rank="_at"), "bank")
    n = bank.count()
    plan = queries.sparkSession.range(count if count is not None else n).withColumnRenamed("id", "ord")
    mode = F.element_at(F.array(*map(F.lit, modes)), (F.col("ord") % len(modes) + 1).cast("int"))
    return plan.withColumn("_at", F.col("ord") % max(n, 1)).join(bank.drop("ord"), "_at").select("ord", "query", mode.alias("mode"))


def generated(plan: DataFrame, recipe: Recipe) -> DataFrame:
    """Templated trajectories of a plan: a tool is drawn by a stable seed and used before the answer; code mode runs code."""
    seed = stable_seed(F.col("query"), F.col("ord"), F.col("mode"), F.lit(recipe.seed))
    names = F.array(*(F.lit(name) for name, _ in recipe.tools))
    tool = F.element_at(names, (F.pmod(F.col("_seed"), F.lit(len(recipe.tools))) + 1).cast("int"))
    key = F.element_at(F.array(*(F.lit(args[0]) for _, args in recipe.tools)), (F.pmod(F.col("_seed"), F.lit(len(recipe.tools))) + 1).cast("int"))
    topic = phrase(F.col("query"))
    plan_step = step("plan", agent=F.lit("planner"), content=F.concat(F.lit("First look into: "), topic))
    thought = step("thought", agent=F.lit("worker"), thought=F.concat(F.lit("I need facts about "), topic))
    call = step("tool_call", agent=F.lit("worker"), tool_name=tool, tool_args=F.to_json(F.create_map(key, topic)))
    seen = step("observation", observation=F.concat(F.lit("Found notes on "), topic, F.lit(" under "), F.substring(F.hex("_seed"), 1, 6)))
    code = step("code_execution", code=F.concat(F.lit("print('"), F.regexp_replace(topic, "'", ""), F.lit("')")), code_output=F.regexp_replace(topic, "'", ""))
    answer = F.concat(F.lit("The notes cover "), topic, F.lit(" in full."))
    last = step("final_answer", content=answer)
    by_mode = F.when(F.col("mode") == "multi_agent", F.array(plan_step, thought, call, seen, last)).when(F.col("mode") == "code_execution", F.array(thought, code, last)).otherwise(F.array(thought, call, seen, last))
    tools = F.array(*(F.struct(F.lit(n).alias("name"), F.lit("").alias("description"), F.lit("{}").alias("parameters"), F.array(*map(F.lit, args)).alias("required"), F.array(*map(F.lit, args)).alias("arg_names")) for n, args in recipe.tools))
    return plan.withColumn("_seed", seed).select(
        "ord", F.lpad(F.lower(F.hex("_seed")), 12, "0").alias("id"), "query", "mode", F.lit(recipe.name).alias("domain"), tools.cast(f"array<{TOOL}>").alias("tools"), by_mode.cast(f"array<{STEP}>").alias("steps"),
        answer.alias("final_answer"), F.lit(True).alias("success"), F.lit("template").alias("generator_model"), F.lit("{}").alias("metadata"), F.lit(0.0).alias("created_at"), F.lit(None).cast(VERIFICATION).alias("verification"),
    )


def run_recipe(spark: SparkSession, recipe: Recipe, queries: DataFrame) -> dict[str, DataFrame]:
    """Generate, deduplicate, judge, verify and measure: ``trajectories``, ``evals`` and one row of ``metrics``."""
    rows = stored(generated(planned(queries, recipe.count, recipe.modes), recipe), "generated")
    removed = None
    if recipe.dedup:
        sets = similarity.shingled(rows, F.col("ord"), steps.dedup_text())
        kept, removed = similarity.deduplicate(sets, recipe.dedup_threshold, recipe.dedup_method)
        rows = stored(rows.join(kept, "ord", "left_semi"), "kept")
    weights, threshold = judge.PRESETS[recipe.preset]
    evals = judge.judged(rows, weights, threshold)
    if recipe.verify:
        rows = verified(rows)
    metrics = rows.agg(
        F.count("*").alias("num_trajectories"), F.round(F.avg(F.size("steps").cast("double")), 4).alias("avg_steps"), F.round(F.avg(F.size(steps.of_type("tool_call")).cast("double")), 4).alias("avg_tool_calls"),
        F.round(F.avg(F.col("verification.verified").cast("double")), 4).alias("verified_rate"),
    )
    scores = evals.agg(F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"), F.round(F.avg("overall"), 4).alias("avg_overall"))
    metrics = metrics.join(scores)  # two rows of one
    if removed is not None:
        metrics = metrics.join(removed.agg(F.count("*").alias("duplicates_removed")))
    return {"trajectories": rows, "evals": evals, "metrics": metrics}


def first_seen(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values of a column with the least ``order`` of each, and their place (from 0) in order of appearance; nulls are no value."""
    seen = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("first"))
    return numbered(seen, [F.col("first"), F.col(column)], rank="place")


def sampled_tasks(tasks: DataFrame, key: str, n: int, domains: list[str] | None = None, seed: int = 0) -> DataFrame:
    """``n`` rows ``idx`` and the task's columns: the tasks (``domain`` among ``domains``, if any are given) in order of a stable seed, over and over if there are too few."""
    pool = tasks.filter(F.col("domain").isin(*domains)) if domains else tasks
    pool = stored(numbered(pool, [stable_seed(F.lit(seed), F.col(key)), F.col(key)], rank="_at"), "pool")
    size = pool.count()
    if not size or n <= 0:
        return pool.limit(0).select(F.lit(0).cast("long").alias("idx"), *tasks.columns)
    plan = tasks.sparkSession.range(n).select(F.col("id").alias("idx"), (F.col("id") % size).alias("_at"))
    return plan.join(pool, "_at").select("idx", *tasks.columns)
