"""Leaderboards over judged documents: a source stands for a model, quality 1 for a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio, wilson
from .tables import table


def leaderboard_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, passes, pass rate with its Wilson interval, and rank of every source."""
    judged = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("pass"))
    per_model = table(spark, sf_dir, "documents").select("doc_id", "source").join(judged, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("pass").alias("passed"))
    low, high = wilson(F.col("passed"), F.col("n"))
    scored = per_model.select("source", "n", "passed", ratio(F.col("passed"), F.col("n")).alias("pass_rate"), low.alias("wilson_lo"), high.alias("wilson_hi"))
    order = Window.orderBy(F.col("pass_rate").desc(), F.col("source"))  # one row per model: small whatever the corpus
    return scored.withColumn("rank", F.row_number().over(order).cast("long"))


QUERIES = {"leaderboard_wilson": leaderboard_wilson}

ORACLES = {
    "leaderboard_wilson": """
WITH m AS (
  SELECT source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS passed
  FROM documents JOIN labels USING (doc_id) GROUP BY source),
p AS (SELECT *, passed::DOUBLE / n AS r, 1.96 AS z FROM m),
w AS (
  SELECT source, n, passed, round(r, 4) AS pass_rate,
    round(greatest((r + z*z/(2e0*n) - z*sqrt(r*(1-r)/n + z*z/(4e0*n*n))) / (1 + z*z/n), 0), 4)::DOUBLE AS wilson_lo,
    round(least((r + z*z/(2e0*n) + z*sqrt(r*(1-r)/n + z*z/(4e0*n*n))) / (1 + z*z/n), 1), 4)::DOUBLE AS wilson_hi
  FROM p)
SELECT *, row_number() OVER (ORDER BY pass_rate DESC, source) AS rank FROM w
""",
}
