"""Failure mining, targeted queries and training exports over documents, labels and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import ratio, rounded
from ..operators import mining as M
from .tables import table

DIMS = ("length_score", "value_score", "quality_score")


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as cases: the expected tool is the return flag, the predicted one the line status, null on the first line."""
    items = table(spark, sf_dir, "lineitem")
    predicted = F.when(F.col("l_linenumber") == 1, F.lit(None)).when(F.col("l_quantity") > 25, F.col("l_returnflag")).otherwise(F.col("l_linestatus"))
    return items.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("case_id"), F.col("l_returnflag").alias("expected_tool"), predicted.alias("predicted_tool"),
        F.concat(F.lit(" Q"), F.col("l_tax").cast("string")).alias("expected_arg"), F.concat(F.lit("q"), F.col("l_discount").cast("string"), F.lit(" ")).alias("predicted_arg"),
    )


def tool_calling_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = M.scored_cases(_cases(spark, sf_dir))
    return cases.agg(F.count("*").alias("n"), ratio(F.sum(F.col("tool_ok").cast("bigint")), F.count("*")).alias("tool_accuracy"), ratio(F.sum(F.col("args_ok").cast("bigint")), F.count("*")).alias("arg_accuracy"), F.round(F.avg("score"), 4).alias("score"))


def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases as they are against a second model that also answers the first line of every order."""
    cases = _cases(spark, sf_dir)
    better = cases.withColumn("predicted_tool", F.coalesce("predicted_tool", "expected_tool"))
    return M.models_compared(M.scored_cases(cases), M.scored_cases(better))


def failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.failures(M.scored_cases(_cases(spark, sf_dir))).groupBy("kind").agg(F.count("*").alias("n"))


def most_missed_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = M.failures(M.scored_cases(_cases(spark, sf_dir))).groupBy("expected_tool").agg(F.count("*").alias("missed"))
    return by.orderBy(F.col("missed").desc(), "expected_tool").limit(5)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three judge dimensions per labelled document."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("quality_score"), (1 - F.col("toxic")).cast("double").alias("value_score"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", rounded(F.least(F.col("n_chars") / 2000.0, F.lit(1.0)), 2).alias("length_score"))
    return docs.join(labels, "doc_id")


def judge_failures_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.low_dimensions(_scores(spark, sf_dir).select("doc_id", *DIMS), "doc_id", DIMS)


def weak_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.weak_dimensions(_scores(spark, sf_dir).select("doc_id", *DIMS), "doc_id", DIMS, 0.95)


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.col("text").alias("query"))


def targeted_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of variations of failed queries; the first round is varied too."""
    return M.varied(_queries(spark, sf_dir), 1, M.TARGET_TEMPLATES, first_as_is=False).select(F.col("ord").alias("item_id"), F.col("round").cast("bigint").alias("round"), "query")


def evolve_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries themselves, then three rounds of variations."""
    return M.varied(_queries(spark, sf_dir), 3, M.EVOLVE_TEMPLATES, first_as_is=True).select(F.col("ord").alias("item_id"), F.col("round").cast("bigint").alias("round"), "query")


def sft_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose evaluation passed."""
    passed = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5("text").alias("text_md5")).join(passed, "doc_id", "left_semi")


def dpo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and worst document of every source and language by a score of length and label."""
    scored = _scores(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    rows = scored.select(F.concat_ws("/", "source", "lang").alias("query"), F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("text"), F.round(F.col("quality_score") * 0.5 + F.col("length_score") * 0.5, 4).alias("overall"))
    return M.preference_pairs(rows, 0.01)


def rft_top_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("reward"))
    return M.top_quantile(events, 0.1)


def confidence_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the confidence of the learned verifier: what fails, what passes and what a judge must see."""
    p = F.least(F.col("value") / 100.0, F.lit(1.0))
    route = F.when(p < 0.3, "auto_fail").when(p >= 0.7, "auto_pass").otherwise("needs_judge")
    return table(spark, sf_dir, "events").groupBy("event_type", route.alias("route")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (tool_calling_report, model_comparison, failure_counts, most_missed_tools, judge_failures_unpivot, weak_dimensions, targeted_queries, evolve_queries, sft_semi_join, dpo_pairs, rft_top_quantile, confidence_routing)}

_C = """WITH c AS (SELECT l_returnflag AS expected_tool, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_quantity > 25 THEN l_returnflag ELSE l_linestatus END AS predicted_tool, l_tax = l_discount AS same FROM lineitem),
s AS (SELECT *, coalesce(predicted_tool = expected_tool, false) AS tool_ok, coalesce(predicted_tool = expected_tool, false) AND same AS args_ok FROM c),
f AS (SELECT *, CASE WHEN predicted_tool IS NULL THEN 'invalid_call' WHEN NOT tool_ok THEN 'wrong_tool' ELSE 'bad_args' END AS kind FROM s WHERE NOT (tool_ok AND args_ok))"""
_S = """WITH s AS (SELECT doc_id, source, lang, round(least(n_chars / 2000e0, 1), 2) AS length_score, (1 - toxic)::DOUBLE AS value_score, quality::DOUBLE AS quality_score FROM documents JOIN labels USING (doc_id)),
u AS (UNPIVOT s ON length_score, value_score, quality_score INTO NAME dimension VALUE value)"""


def _varied(rounds: int, templates: tuple[str, ...], as_is: bool) -> str:
    listed = ", ".join("'" + t.replace("'", "''") + "'" for t in templates)
    made = f"replace([{listed}][CAST(('0x' || substr(sha256(item_id || '||' || round), 1, 12)) AS BIGINT) % {len(templates)} + 1], '{{q}}', q)"
    text = f"CASE WHEN round = 0 THEN q ELSE {made} END" if as_is else made
    return f"""WITH b AS (SELECT item_id, text AS q FROM benchmark), r AS (SELECT item_id, round, {text} AS query FROM b, range(0, {rounds + 1}) AS t(round) WHERE trim(q) <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round, item_id) AS k FROM r) SELECT item_id, round, query FROM n WHERE k = 1"""


ORACLES = {
    "tool_calling_report": f"{_C} SELECT count(*) AS n, round(sum(tool_ok::INT) / count(*)::DOUBLE, 4) AS tool_accuracy, round(sum(args_ok::INT) / count(*)::DOUBLE, 4) AS arg_accuracy, round(avg(CASE WHEN tool_ok AND args_ok THEN 1e0 WHEN tool_ok THEN 0.5e0 ELSE 0e0 END), 4) AS score FROM s",
    "model_comparison": f"""{_C}, m AS (
  SELECT 'b' AS model, tool_ok, args_ok FROM s UNION ALL
  SELECT 'a', coalesce(coalesce(predicted_tool, expected_tool) = expected_tool, false), coalesce(coalesce(predicted_tool, expected_tool) = expected_tool, false) AND same FROM c),
k AS (SELECT model, count(*) AS n, 2 * sum(tool_ok::INT) AS t, 2 * sum(args_ok::INT) AS g, sum(tool_ok::INT + (tool_ok AND args_ok)::INT) AS s FROM m GROUP BY 1),
r AS (SELECT model, n, floor((t * 10000e0 + n) / (2e0 * n)) / 10000e0 AS t, floor((g * 10000e0 + n) / (2e0 * n)) / 10000e0 AS g, floor((s * 10000e0 + n) / (2e0 * n)) / 10000e0 AS s FROM k)
SELECT b.n, b.t AS tool_accuracy_before, b.g AS arg_accuracy_before, b.s AS score_before, a.t AS tool_accuracy_after, a.g AS arg_accuracy_after, a.s AS score_after,
  round(a.t - b.t, 4) AS delta_tool_accuracy, round(a.s - b.s, 4) AS delta_score FROM r b JOIN r a ON b.model = 'b' AND a.model = 'a'""",
    "failure_counts": f"{_C} SELECT kind, count(*) AS n FROM f GROUP BY 1",
    "most_missed_tools": f"{_C} SELECT expected_tool, count(*) AS missed FROM f GROUP BY 1 ORDER BY missed DESC, expected_tool LIMIT 5",
    "judge_failures_unpivot": f"{_S} SELECT doc_id, dimension, value, printf('%s=%.2f < 0.70', dimension, value) AS detail FROM u WHERE value < 0.7",
    "weak_dimensions": f"{_S} SELECT dimension, round(avg(value), 4) AS mean FROM u GROUP BY 1 HAVING round(avg(value), 4) < 0.95",
    "targeted_queries": _varied(1, M.TARGET_TEMPLATES, False),
    "evolve_queries": _varied(3, M.EVOLVE_TEMPLATES, True),
    "sft_semi_join": "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "dpo_pairs": f"""{_S}, r AS (SELECT source || '/' || lang AS query, doc_id, round(quality_score * 0.5e0 + length_score * 0.5e0, 4) AS overall FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY overall DESC, doc_id) AS b, row_number() OVER (PARTITION BY query ORDER BY overall, doc_id DESC) AS w FROM r)
SELECT x.query, x.doc_id::VARCHAR AS chosen, y.doc_id::VARCHAR AS rejected, x.overall AS chosen_score, y.overall AS rejected_score, round(x.overall - y.overall, 4) AS margin
FROM o x JOIN o y USING (query) WHERE x.b = 1 AND y.w = 1 AND x.doc_id <> y.doc_id AND round(x.overall - y.overall, 4) >= 0.01""",
    "rft_top_quantile": """WITH e AS (SELECT event_id, value AS reward FROM events), o AS (SELECT reward, row_number() OVER (ORDER BY reward DESC) AS k FROM e)
SELECT * FROM e WHERE reward >= (SELECT reward FROM o WHERE k = greatest(CAST(floor((SELECT count(*) FROM e) * 0.1e0) AS BIGINT), 1))""",
    "confidence_routing": "SELECT event_type, CASE WHEN least(value / 100e0, 1) < 0.3 THEN 'auto_fail' WHEN least(value / 100e0, 1) >= 0.7 THEN 'auto_pass' ELSE 'needs_judge' END AS route, count(*) AS n FROM events GROUP BY 1, 2",
}
