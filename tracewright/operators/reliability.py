"""Reliability of repeated trials: per scenario, pass^k curve and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import pass_hat_k, ratio, wilson


def per_scenario(trials: DataFrame) -> DataFrame:
    """``scenario_id, passes, trials, min_score`` of rows ``scenario_id, trial, passed, score``."""
    return trials.groupBy("scenario_id").agg(F.sum(F.col("passed").cast("bigint")).alias("passes"), F.count("*").alias("trials"), F.min("score").alias("min_score"))


def status() -> Column:
    return F.when(F.col("passes") == F.col("trials"), "PASS").when(F.col("passes") == 0, "FAIL").otherwise("FLAKY")


def passk_curve(scenarios: DataFrame, trials: int) -> DataFrame:
    """``k, pass_hat_k`` for k from 1 to ``trials``: the mean over the scenarios that were tried k times or more."""
    each = scenarios.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(trials).cast("bigint"), "trials")))).withColumn("k", F.col("k").cast("bigint"))
    return each.groupBy("k").agg(F.round(F.avg(pass_hat_k(F.col("passes"), F.col("trials"), F.col("k"))), 4).alias("pass_hat_k"))


def report(scenarios: DataFrame, trials: int) -> DataFrame:
    """One row: pass^1 over all trials, pass^trials over the scenarios with so many trials, their intervals, and the number of flaky scenarios."""
    one = scenarios.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("passes"), F.lit(0)).alias("p"),
        F.coalesce(F.sum("trials"), F.lit(0)).alias("attempts"),
        F.count_if(F.col("trials") >= trials).alias("whole"),
        F.coalesce(F.sum(F.when(F.col("trials") >= trials, pass_hat_k(F.col("passes"), F.col("trials"), F.lit(trials)))), F.lit(0.0)).alias("full_passes"),
        F.coalesce(F.sum(((F.col("passes") > 0) & (F.col("passes") < F.col("trials"))).cast("bigint")), F.lit(0)).alias("flaky"),
    )
    attempts = F.col("attempts")
    low1, high1 = wilson(F.col("p"), attempts)
    low, high = wilson(F.col("full_passes"), F.col("whole"))
    return one.select(
        "n", ratio(F.col("p"), attempts).alias("pass1"), low1.alias("pass1_lo"), high1.alias("pass1_hi"),
        ratio(F.col("full_passes"), F.col("whole")).alias("passk"), low.alias("passk_lo"), high.alias("passk_hi"), "flaky",
    )
