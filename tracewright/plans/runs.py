"""Queries whose steps SQL can't express: rollouts, audits, traces, the learned verifier and resumable streams."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import FEATURES
from ..operators import learned as L
from ..operators import steps as P
from ..operators import worlds as W
from ..sources import readers, traces
from ..sources.shared import folder
from ..streaming.resumable import resumable
from .tables import table
from .trajectories import trajectories

_SCHEMA = "CREATE TABLE orders (id INTEGER PRIMARY KEY, status TEXT, price REAL)"


def _scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A world for every customer with its orders: the task is to close all of them."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_totalprice"))).alias("o"))
    rows = F.transform("o", lambda x: F.array(x["o_orderkey"].cast("string"), x["o_orderstatus"], x["o_totalprice"].cast("string")))
    checks = json.dumps([{"kind": "sql", "name": "all_closed", "query": "SELECT count(*) FROM orders WHERE status <> 'C'", "equals": [[0]]}, {"kind": "sql", "name": "any_left", "query": "SELECT id FROM orders", "non_empty": True}])
    # even customers are served, odd ones only in part
    actions = F.when(F.col("o_custkey") % 2 == 0, json.dumps(["UPDATE orders SET status = 'C'"])).otherwise(json.dumps(["SELECT * FROM orders", "UPDATE orders SET status = 'C' WHERE price > 100000"]))
    return orders.select(
        F.col("o_custkey").cast("string").alias("scenario_id"), F.lit("Close all orders.").alias("task"), F.lit(_SCHEMA).alias("schema"), F.lit("orders").alias("table"), F.to_json(rows).alias("rows"),
        actions.alias("actions"), F.lit("All orders are closed.").alias("answer"), F.lit(checks).alias("checks"),
    )


def scenario_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.rollouts(_scenarios(spark, sf_dir)).drop("observations")


def robustness_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.audited(_scenarios(spark, sf_dir)).select("scenario_id", F.array_join("passed_by", ",").alias("passed_by"), "robust")


def imported_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as raw traces and imported again."""
    found = traces.traces(readers.conversation_traces(table(spark, sf_dir, "conversations")))
    return found.select(F.md5("query").alias("query_md5"), F.md5("final_answer").alias("answer_md5"), F.size("steps").cast("bigint").alias("num_steps"), "success")


def learned_verifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out report of a verifier trained on the features of conversations (label: ends on an answer of over 60 words)."""
    rows = trajectories(spark, sf_dir).select(F.col("ord"), *(v.alias(n) for n, v in P.features().items())).withColumn("label", (F.col("final_answer_words") > 60).cast("int"))
    fit, held = L.split(rows, "ord", "label")
    model = L.train(fit, [f for f in FEATURES if f != "final_answer_words"])
    return L.report(L.predicted(model, held))


def resumable_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan worked off in two calls of a stream; the second goes on where the first ended."""
    base = f"{folder(spark)}/tracewright/stream-{uuid.uuid4().hex}"
    plan = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.col("text").alias("query"))
    plan.filter("ord % 2 = 0").write.parquet(f"{base}/plan")
    schema = "ord bigint, query string"

    def make(batch: DataFrame) -> DataFrame:
        return batch.select("ord", F.md5("query").alias("answer"))

    resumable(spark, f"{base}/plan", schema, make, f"{base}/out", f"{base}/checkpoint")
    plan.filter("ord % 2 = 1").write.mode("append").parquet(f"{base}/plan")
    resumable(spark, f"{base}/plan", schema, make, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select("ord", "answer")


QUERIES = {f.__name__: f for f in (scenario_rollouts, robustness_audit, imported_traces, learned_verifier, resumable_stream)}

ORACLES = {
    "scenario_rollouts": """
WITH c AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE CASE WHEN o_custkey % 2 = 0 OR o_totalprice > 100000 THEN 'C' ELSE o_orderstatus END <> 'C') AS open FROM orders GROUP BY 1)
SELECT o_custkey::VARCHAR AS scenario_id, open = 0 AS passed, CASE WHEN open = 0 THEN 1e0 ELSE 0.5e0 END AS outcome, CAST(CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS steps, CASE WHEN open = 0 THEN '' ELSE 'all_closed' END AS failed FROM c""",
    "robustness_audit": "SELECT DISTINCT o_custkey::VARCHAR AS scenario_id, '' AS passed_by, true AS robust FROM orders",
    "imported_traces": """
WITH x AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS q, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS a, count(*) FILTER (WHERE role = 'assistant') AS n FROM conversations WHERE text <> '' GROUP BY 1)
SELECT md5(coalesce(q, '')) AS query_md5, md5(coalesce(a, '')) AS answer_md5, n AS num_steps, a IS NOT NULL AS success FROM x""",
    "resumable_stream": "SELECT item_id AS ord, md5(text) AS answer FROM benchmark",
}
