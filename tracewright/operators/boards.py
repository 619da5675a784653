"""Boards and run comparisons: best runs, breakdowns, submission checks, run differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_model(submissions: DataFrame, limit: int = 50) -> DataFrame:
    """The best submission of each model among the first ``limit`` rows (1 to 500) by pass rate, then age; with ``rank``."""
    order = [F.col("pass_rate").desc(), F.col("created_at"), F.col("id")]
    top = submissions.orderBy(*order).limit(min(max(limit, 1), 500))
    first = top.withColumn("_n", F.row_number().over(Window.partitionBy("model").orderBy(*order))).filter("_n = 1").drop("_n")
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))  # at most 500 rows


def breakdown(results: DataFrame) -> DataFrame:
    """Passes and attempts of every scenario over rows ``scenario_id, passed``."""
    by = results.groupBy("scenario_id").agg(F.sum(F.col("passed").cast("bigint")).alias("passes"), F.count("passed").alias("attempts"))
    return by.withColumn("pass_rate", F.round(F.try_divide(F.col("passes").cast("double"), F.col("attempts").cast("double")), 4))


def hard_scenarios(by: DataFrame, threshold: float) -> DataFrame:
    return by.filter(F.col("pass_rate") <= threshold)


def reject_reason(pack_size: Column) -> Column:
    """Why a submission is refused, or null: sizes, ranges and the manifest's own rate."""
    rate = F.col("pass_rate")
    return (
        F.when(F.col("n") != pack_size, "n does not match the pack")
        .when(F.col("num_results") != F.col("n"), "results do not match n")
        .when((rate < 0) | (rate > 1), "pass_rate out of range")
        .when((F.col("passed") < 0) | (F.col("passed") > F.col("n")), "passed out of range")
        .when(F.abs(rate - F.col("manifest_rate")) > 1e-6, "manifest rate differs")
    )


def run_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``scenario_id, change`` between two runs of ``scenario_id, passed``."""
    both = before.withColumnRenamed("passed", "was").join(after.withColumnRenamed("passed", "now"), "scenario_id", "full_outer")
    change = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("now").isNull(), "removed")
        .when(F.col("was") & ~F.col("now"), "regressed")
        .when(~F.col("was") & F.col("now"), "fixed")
        .when(~F.col("was"), "still_failing")
        .otherwise("still_passing")
    )
    return both.select("scenario_id", change.alias("change"))


def compare_runs(runs: DataFrame, policies: list[str]) -> DataFrame:
    """One row per scenario with each policy's verdict as 1 or 0."""
    return runs.groupBy("scenario_id").pivot("policy", policies).agg(F.max(F.col("passed").cast("bigint")))


def trailing_count(requests: DataFrame, key: str, at: str, hours: int = 1) -> DataFrame:
    """How many requests of a key fell in the hours before each one, itself included; the boundary itself is out."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    window = Window.partitionBy(key).orderBy("_at").rangeBetween(-(hours * 3_600_000_000 - 1), 0)
    return requests.withColumn("_at", micros).withColumn("recent", F.count("*").over(window)).drop("_at")
