"""Dataset metrics: documents stand for trajectories, labels for evaluations, events for tool calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..functions.text import clipped, metric_tokens
from .tables import table


def dataset_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: sizes, pass rate, toxic rate and mean lengths; each side is aggregated on its own before the one-row join."""
    docs = table(spark, sf_dir, "documents").agg(
        F.count("*").alias("num_trajectories"),
        F.round(F.avg(F.col("n_chars").cast("double")), 4).alias("avg_chars"),
        F.count_distinct("source").alias("unique_sources"),
    )
    evals = table(spark, sf_dir, "labels").agg(
        F.count("*").alias("num_evaluated"),
        F.round(F.avg(F.col("quality").cast("double")), 4).alias("pass_rate"),
        F.round(F.avg(F.col("toxic").cast("double")), 4).alias("toxic_rate"),
    )
    return docs.join(evals)  # two rows of one


def mode_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.coalesce(F.nullif("lang", F.lit("")), F.lit("unspecified")).alias("mode")).agg(F.count("*").alias("n"))


def domain_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight largest domains; empty ones are unspecified."""
    docs = table(spark, sf_dir, "documents")
    by = docs.groupBy(F.coalesce(F.nullif("source", F.lit("")), F.lit("unspecified")).alias("domain")).agg(F.count("*").alias("n"))
    return by.orderBy(F.col("n").desc(), "domain").limit(8)


def overview_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a passing evaluation, their preview and a digest of the whole text; rows without an evaluation drop out as soon as a least score is asked for."""
    evals = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("overall"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", clipped(F.col("text"), 60).alias("preview"), F.md5("text").alias("text_md5"))
    return docs.join(evals, "doc_id", "left").filter("overall >= 0.6")


def tool_usage_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("calls")).orderBy(F.col("calls").desc(), "tool").limit(15)


def tool_signature_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool names of a user's run in order, joined by ``>``, with the number of calls."""
    events = table(spark, sf_dir, "events").filter("event_type is not null and event_type != ''")
    runs = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("calls"))
    return runs.select("user_id", F.array_join(F.transform("calls", lambda c: c["event_type"]), ">").alias("signature"), F.size("calls").cast("bigint").alias("num_calls"))


def tool_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the offered tools (all event types) that users of even id use."""
    events = table(spark, sf_dir, "events")
    used = F.count_distinct(F.when(F.col("user_id") % 2 == 0, F.col("event_type")))
    return events.agg(ratio(used, F.count_distinct("event_type")).alias("tool_coverage"), used.alias("used"), F.count_distinct("event_type").alias("offered"))


def diversity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of distinct signatures, distinct domains and distinct tokens, each over its total."""
    docs = table(spark, sf_dir, "documents")
    sizes = docs.agg(F.count("*").alias("n"), F.count_distinct(F.nullif("source", F.lit(""))).alias("domains"), F.count_distinct("lang", "source").alias("signatures"))
    words = docs.select(F.explode(metric_tokens(F.col("text"))).alias("w"))
    tokens = words.groupBy("w").agg(F.count("*").alias("c")).agg(F.count("*").alias("kinds"), F.sum("c").alias("tokens"))
    one = sizes.join(tokens)  # two rows of one
    parts = [F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")) for a, b in (("signatures", "n"), ("domains", "n"), ("kinds", "tokens"))]
    score = F.round((parts[0] + parts[1] + parts[2]) / 3.0, 4)
    return one.select("n", "signatures", "domains", "kinds", "tokens", score.alias("diversity_score"))


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of scores in tenths; one is in the last bin."""
    events = table(spark, sf_dir, "events")
    scores = events.select(F.least(F.greatest(F.col("value") / 100.0, F.lit(0.0)), F.lit(1.0)).alias("s"))
    return scores.groupBy(F.least(F.floor(F.col("s") * 10), F.lit(9)).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("steps"))
    return turns.groupBy("steps").agg(F.count("*").alias("n"))


def scores_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score and its spread per thousand characters (the data of the score-against-length and box figures)."""
    evals = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("q"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("n_chars") / 1000).cast("bigint").alias("kilo"))
    return docs.join(evals, "doc_id").groupBy("kilo").agg(F.count("*").alias("n"), F.round(F.avg("q"), 4).alias("mean"), F.min("q").alias("low"), F.max("q").alias("high"))


def verified_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").agg(F.round(F.avg(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("double")), 4).alias("verified_rate"))


def size_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size class of a dataset card, for every source."""
    n = F.col("n")
    bucket = F.when(n < 1000, "n<1K").when(n < 10_000, "1K<n<10K").when(n < 100_000, "10K<n<100K").otherwise("100K<n<1M")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("bucket", bucket)


def cost_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, tokens and cost of every model."""
    events = table(spark, sf_dir, "events")
    return events.groupBy("event_type").agg(
        F.count("*").alias("calls"),
        F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("prompt_tokens"),
        F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double") * 0.001, 4).alias("usd"),
    )


def budget_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that a budget pays for: running cost within each priority, in order."""
    orders = table(spark, sf_dir, "orders")
    before = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    spent = orders.withColumn("spent", F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(before))
    return spent.filter("spent <= 200000").groupBy("o_custkey").agg(F.count("*").alias("paid"), F.max("spent").cast("double").alias("spent"))


QUERIES = {f.__name__: f for f in (dataset_metrics, mode_distribution, domain_distribution, overview_filter, tool_usage_top15, tool_signature_per_user, tool_coverage, diversity_score, score_histogram, length_histogram, scores_by_length, verified_rate, size_bucket, cost_meter, budget_cap)}

ORACLES = {
    "dataset_metrics": """
SELECT (SELECT count(*) FROM documents) AS num_trajectories, (SELECT round(avg(n_chars::DOUBLE), 4) FROM documents) AS avg_chars,
  (SELECT count(DISTINCT source) FROM documents) AS unique_sources, count(*) AS num_evaluated,
  round(avg(quality::DOUBLE), 4) AS pass_rate, round(avg(toxic::DOUBLE), 4) AS toxic_rate FROM labels""",
    "mode_distribution": "SELECT coalesce(nullif(lang, ''), 'unspecified') AS mode, count(*) AS n FROM documents GROUP BY 1",
    "domain_distribution": "SELECT coalesce(nullif(source, ''), 'unspecified') AS domain, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, domain LIMIT 8",
    "overview_filter": """
SELECT d.doc_id, source, lang, CASE WHEN length(text) > 60 THEN substring(text, 1, 60) || '…' ELSE text END AS preview, md5(text) AS text_md5, quality::DOUBLE AS overall
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality::DOUBLE >= 0.6""",
    "tool_usage_top15": "SELECT event_type AS tool, count(*) AS calls FROM events GROUP BY 1 ORDER BY calls DESC, tool LIMIT 15",
    "tool_signature_per_user": "SELECT user_id, string_agg(event_type, '>' ORDER BY event_id) AS signature, count(*) AS num_calls FROM events WHERE event_type <> '' GROUP BY 1",
    "tool_coverage": """
SELECT round(count(DISTINCT event_type) FILTER (WHERE user_id % 2 = 0) / count(DISTINCT event_type)::DOUBLE, 4) AS tool_coverage,
  count(DISTINCT event_type) FILTER (WHERE user_id % 2 = 0) AS used, count(DISTINCT event_type) AS offered FROM events""",
    "diversity_score": """
WITH s AS (SELECT count(*) AS n, count(DISTINCT nullif(source, '')) AS domains, (SELECT count(*) FROM (SELECT DISTINCT lang, source FROM documents)) AS signatures FROM documents),
w AS (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z0-9'']+'))) AS w FROM documents),
t AS (SELECT count(DISTINCT w) AS kinds, count(*) AS tokens FROM w)
SELECT n, signatures, domains, kinds, tokens, round((signatures / n::DOUBLE + domains / n::DOUBLE + kinds / tokens::DOUBLE) / 3e0, 4) AS diversity_score FROM s, t""",
    "score_histogram": "SELECT CAST(least(floor(least(greatest(value / 100e0, 0), 1) * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1",
    "length_histogram": "SELECT steps, count(*) AS n FROM (SELECT conv_id, count(*) AS steps FROM conversations GROUP BY 1) GROUP BY 1",
    "scores_by_length": """
SELECT CAST(floor(n_chars / 1000e0) AS BIGINT) AS kilo, count(*) AS n, round(avg(quality::DOUBLE), 4) AS mean, min(quality::DOUBLE) AS low, max(quality::DOUBLE) AS high
FROM documents JOIN labels USING (doc_id) GROUP BY 1""",
    "verified_rate": "SELECT round(avg((quality = 1 AND toxic = 0)::INT::DOUBLE), 4) AS verified_rate FROM labels",
    "size_bucket": "SELECT source, count(*) AS n, CASE WHEN count(*) < 1000 THEN 'n<1K' WHEN count(*) < 10000 THEN '1K<n<10K' WHEN count(*) < 100000 THEN '10K<n<100K' ELSE '100K<n<1M' END AS bucket FROM documents GROUP BY 1",
    "cost_meter": "SELECT event_type, count(*) AS calls, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS prompt_tokens, round(sum(value::DECIMAL(18,2))::DOUBLE * 0.001e0, 4) AS usd FROM events GROUP BY 1",
    "budget_cap": """
WITH s AS (SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS spent FROM orders)
SELECT o_custkey, count(*) AS paid, max(spent)::DOUBLE AS spent FROM s WHERE spent <= 200000 GROUP BY 1""",
}
