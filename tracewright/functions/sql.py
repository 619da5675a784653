"""The column functions as SQL functions of a session (temporary, no Python)."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "stable_seed": "(a STRING, b STRING) RETURNS BIGINT RETURN CAST(conv(substr(sha2(concat_ws('||', a, b), 256), 1, 12), 16, 10) AS BIGINT)",
    "jaccard": "(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE RETURN CASE WHEN size(a) = 0 AND size(b) = 0 THEN 1D ELSE coalesce(try_divide(CAST(size(array_intersect(a, b)) AS DOUBLE), size(array_union(a, b))), 0D) END",
    "wilson_lo": "(p BIGINT, n BIGINT) RETURNS DOUBLE RETURN CASE WHEN n <= 0 THEN 0D ELSE round(greatest((p / n + 3.8416D / (2 * n) - 1.96D * sqrt((p / n) * (1 - p / n) / n + 3.8416D / (4D * n * n))) / (1 + 3.8416D / n), 0D), 4) END",
    "wilson_hi": "(p BIGINT, n BIGINT) RETURNS DOUBLE RETURN CASE WHEN n <= 0 THEN 0D ELSE round(least((p / n + 3.8416D / (2 * n) + 1.96D * sqrt((p / n) * (1 - p / n) / n + 3.8416D / (4D * n * n))) / (1 + 3.8416D / n), 1D), 4) END",
}


def register(spark: SparkSession) -> None:
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
