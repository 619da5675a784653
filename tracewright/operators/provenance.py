"""Provenance as tables: fingerprints of packs and runs, and whether two runs agree.

A fingerprint is a digest of a multiset of row hashes: every row is hashed, the
hashes are summed in four parts as numbers, and the sums are hashed. So rows are
hashed where they are, only four sums per group are shuffled, and no order of
rows changes the outcome.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import canonical

#: Result rows of a run.
RESULTS = "scenario_id string, passed boolean, outcome double"


def _digest(*rows_hash: Column) -> Column:
    """Aggregate: 32 hex digits that tell a multiset of the texts in a column."""
    whole = F.sha2(F.concat_ws("\x1f", *rows_hash), 256)
    parts = [F.sum(F.conv(F.substring(whole, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    return F.substring(F.sha2(F.concat_ws("-", F.count("*").cast("string"), *(F.coalesce(p, F.lit(0)).cast("string") for p in parts)), 256), 1, 32)


def scenario_table(spark: SparkSession, pack: list[dict]) -> DataFrame:
    """A pack file as ``scenario_id, definition`` (canonical JSON)."""
    return spark.createDataFrame([(str(s.get("id", "")), canonical(s)) for s in pack], "scenario_id string, definition string")


def pack_fingerprint(scenarios: DataFrame) -> DataFrame:
    """One row ``n, pack_fingerprint`` of ``definition`` texts."""
    return scenarios.agg(F.count("*").alias("n"), _digest(F.col("definition")).alias("pack_fingerprint"))


def run_record(results: DataFrame, scenarios: DataFrame, policy: str, seed: int, trials: int) -> DataFrame:
    """One row that tells a run: its pack, settings and ``results_digest``, and all of these in ``run_hash``."""
    outcome = F.format_number(F.coalesce("outcome", F.lit(0.0)), 6)
    passed = F.coalesce(F.sum(F.col("passed").cast("long")), F.lit(0))
    rate = F.round(F.coalesce(F.try_divide(passed, F.count("*")), F.lit(0.0)), 4)
    counted = results.agg(F.count("*").alias("n"), passed.alias("passed"), rate.alias("pass_rate"), _digest(F.col("scenario_id"), F.col("passed").cast("string"), outcome).alias("results_digest"))
    settings = F.struct(F.lit(policy).alias("policy"), F.lit(seed).cast("long").alias("seed"), F.lit(trials).cast("long").alias("trials"))
    whole = counted.join(pack_fingerprint(scenarios).drop("n")).select("pack_fingerprint", settings.alias("settings"), "n", "passed", "pass_rate", "results_digest")  # one row each
    return whole.withColumn("run_hash", F.substring(F.sha2(F.to_json(F.struct("pack_fingerprint", "settings", "results_digest")), 256), 1, 32))


def manifest(record: DataFrame, results: DataFrame, path: str) -> None:
    """A run stored under ``path``: its record and its result rows."""
    record.write.json(f"{path}/record")
    results.write.parquet(f"{path}/results")


def compared(before: DataFrame, after: DataFrame, results_before: DataFrame, results_after: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """One row: ``same_pack, exact, differing, within, reproducible`` of two runs' records and result rows.

    ``exact`` is equality of the run hashes. ``differing`` counts the scenarios
    that changed sides or are in one run only, whatever the rates; ``within``
    tells whether the pass rates are at most ``tolerance`` apart, which alone
    makes nothing reproducible. A run is reproducible when the pack is the same
    and no scenario differs.
    """
    old = results_before.groupBy("scenario_id", "passed").agg(F.count("*").alias("old"))
    new = results_after.groupBy("scenario_id", "passed").agg(F.count("*").alias("new"))
    uneven = old.join(new, ["scenario_id", "passed"], "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    differing = uneven.agg(F.countDistinct("scenario_id").alias("differing"))
    pair = before.select(F.struct("*").alias("b")).join(after.select(F.struct("*").alias("a"))).join(differing)  # one row each
    same_pack = F.col("b.pack_fingerprint") == F.col("a.pack_fingerprint")
    return pair.select(
        same_pack.alias("same_pack"), (F.col("b.run_hash") == F.col("a.run_hash")).alias("exact"), "differing",
        (F.abs(F.col("b.pass_rate") - F.col("a.pass_rate")) <= F.lit(tolerance) + 1e-9).alias("within"), (same_pack & (F.col("differing") == 0)).alias("reproducible"),
    )


def results_table(spark: SparkSession, results: list[dict]) -> DataFrame:
    rows = [(str(r["id"]), bool(r["passed"]), float(r.get("outcome", 0.0))) for r in results]
    return spark.createDataFrame(rows, RESULTS)


def as_json(row: DataFrame) -> str:
    """The one row of a record as JSON text."""
    return json.dumps(row.first().asDict(recursive=True), sort_keys=True)
