"""Reliability over repeated trials: a scenario is up to four events in a row of a user and event type, a trial passes on a value of at least 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio, wilson
from ..operators import reliability as R
from .tables import table

TRIALS = 4


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of every user and event type in consecutive blocks of four; the last block may have fewer trials."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (F.col("value") >= 50).alias("passed"), F.col("value"))
    order = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    numbered = events.withColumn("at", F.row_number().over(order) - 1).withColumns({"block": F.floor(F.col("at") / TRIALS), "trial": F.col("at") % TRIALS + 1})
    return numbered.select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type", F.col("block").cast("string")).alias("scenario_id"), "trial", "passed", (F.col("value") / 100.0).alias("score"))


def passk_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.passk_curve(R.per_scenario(trials(spark, sf_dir)), TRIALS)


def reliability_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.per_scenario(trials(spark, sf_dir)).select("scenario_id", "passes", "trials", "min_score", R.status().alias("status"))


def flaky_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.per_scenario(trials(spark, sf_dir)).filter("passes > 0 and passes < trials").select("scenario_id", "passes")


def trial_passk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.report(R.per_scenario(trials(spark, sf_dir)), TRIALS)


def suite_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass rate of every trial over all scenarios."""
    by = trials(spark, sf_dir).groupBy(F.col("trial").cast("bigint").alias("trial")).agg(F.count("*").alias("n"), F.sum(F.col("passed").cast("bigint")).alias("passed"))
    low, high = wilson(F.col("passed"), F.col("n"))
    return by.select("trial", "n", "passed", ratio(F.col("passed"), F.col("n")).alias("pass_rate"), low.alias("lo"), high.alias("hi"))


QUERIES = {f.__name__: f for f in (passk_curve, reliability_scenarios, flaky_scenarios, trial_passk, suite_report)}

_T = """
WITH e AS (SELECT user_id, event_type, event_id, value >= 50 AS passed, value / 100e0 AS score, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS pos FROM events),
b AS (SELECT *, CAST(floor(pos / 4e0) AS BIGINT) AS block, pos % 4 + 1 AS trial FROM e),
t AS (SELECT user_id::VARCHAR || '/' || event_type || '/' || block::VARCHAR AS scenario_id, trial, passed, score FROM b),
s AS (SELECT scenario_id, CAST(sum(passed::INT) AS BIGINT) AS passes, count(*) AS trials, min(score) AS min_score FROM t GROUP BY 1)"""
_W = """round(greatest(({p} + 3.8416e0/(2e0*{n}) - 1.96e0*sqrt({p}*(1-{p})/{n} + 3.8416e0/(4e0*{n}*{n}))) / (1 + 3.8416e0/{n}), 0), 4)::DOUBLE AS {lo},
  round(least(({p} + 3.8416e0/(2e0*{n}) + 1.96e0*sqrt({p}*(1-{p})/{n} + 3.8416e0/(4e0*{n}*{n}))) / (1 + 3.8416e0/{n}), 1), 4)::DOUBLE AS {hi}"""
_PK = "CASE WHEN passes < k THEN 0e0 ELSE list_product([(passes - i)::DOUBLE / (trials - i) for i in range(0, k)]) END"

ORACLES = {
    "passk_curve": f"{_T} SELECT k::BIGINT AS k, round(avg({_PK}), 4) AS pass_hat_k FROM s, range(1, 5) AS r(k) WHERE k <= trials GROUP BY 1",
    "reliability_scenarios": f"{_T} SELECT scenario_id, passes, trials, min_score, CASE WHEN passes = trials THEN 'PASS' WHEN passes = 0 THEN 'FAIL' ELSE 'FLAKY' END AS status FROM s",
    "flaky_scenarios": f"{_T} SELECT scenario_id, passes FROM s WHERE passes > 0 AND passes < trials",
    "trial_passk": f"""{_T}, a AS (SELECT count(*) AS n, sum(passes)::BIGINT AS p, sum(trials)::BIGINT AS attempts, count(*) FILTER (WHERE trials = 4) AS whole, sum((passes = trials AND trials = 4)::INT)::BIGINT AS full_passes, sum((passes > 0 AND passes < trials)::INT)::BIGINT AS flaky FROM s),
z AS (SELECT *, p / attempts::DOUBLE AS r1, full_passes / whole::DOUBLE AS rk, attempts::DOUBLE AS n1, whole::DOUBLE AS nk FROM a)
SELECT n, round(r1, 4) AS pass1, {_W.format(p="r1", n="n1", lo="pass1_lo", hi="pass1_hi")}, round(rk, 4) AS passk, {_W.format(p="rk", n="nk", lo="passk_lo", hi="passk_hi")}, flaky FROM z""",
    "suite_report": f"""{_T}, a AS (SELECT trial, count(*) AS n, sum(passed::INT)::BIGINT AS passed FROM t GROUP BY 1), z AS (SELECT *, passed / n::DOUBLE AS r, n::DOUBLE AS m FROM a)
SELECT trial, n, passed, round(r, 4) AS pass_rate, {_W.format(p="r", n="m", lo="lo", hi="hi")} FROM z""",
}
