"""SQL worlds: queries, copy-on-write changes and state differences over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import worlds as W
from .tables import table, views


def world_left_join_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units and lines of every part, parts without lines included."""
    views(spark, sf_dir, "part", "lineitem")
    return spark.sql("""
        SELECT p_partkey, coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS units, count(l_orderkey) AS num_lines
        FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey""")


def world_top_spender(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "customer", "orders", "nation")
    return spark.sql("""
        SELECT n_name, c_name, total FROM (
          SELECT n_name, c_name, total, row_number() OVER (PARTITION BY n_name ORDER BY total DESC, c_name) AS place
          FROM (SELECT c_custkey, c_name, c_nationkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
                FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3)
          JOIN nation ON n_nationkey = c_nationkey) WHERE place = 1""")


def world_correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders above their customer's mean: the correlated scalar subquery is decorrelated into a join."""
    views(spark, sf_dir, "orders")
    return spark.sql("""
        SELECT o_orderkey, o_custkey FROM orders o
        WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders i WHERE i.o_custkey = o.o_custkey)""")


def world_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an order in 1995 and none in 1996, dates compared as text."""
    views(spark, sf_dir, "customer", "orders")
    return spark.sql("""
        SELECT c_custkey, c_mktsegment FROM customer
        WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND date_format(o_orderdate, 'yyyy-MM-dd') LIKE '1995-%')
          AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND date_format(o_orderdate, 'yyyy-MM-dd') LIKE '1996-%')""")


def world_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with customers and suppliers, and those with customers only."""
    views(spark, sf_dir, "customer", "supplier")
    return spark.sql("""
        SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)
        UNION ALL SELECT 'customers only', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)""")


def world_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars of the worlds: CASE, ROUND, COALESCE, IN and arithmetic."""
    views(spark, sf_dir, "part")
    return spark.sql("""
        SELECT p_partkey, round(p_retailprice * 0.9, 2) AS sale, CASE WHEN p_size IN (1, 2, 3) THEN 'small' WHEN p_size BETWEEN 4 AND 20 THEN 'middle' ELSE 'large' END AS size_class,
          coalesce(nullif(p_brand, 'Brand#11'), 'own') AS brand FROM part""")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def world_update_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPDATE orders SET status = 'X' WHERE price < 50000."""
    return W.updated(_orders(spark, sf_dir), F.col("o_totalprice") < 50000, {"o_orderstatus": F.lit("X")})


def world_update_correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's price becomes the sum of its line prices."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"))
    return _orders(spark, sf_dir).join(lines, "o_orderkey", "left").select("o_orderkey", "o_custkey", F.coalesce("total", F.lit(0.0)).alias("o_totalprice"))


def world_delete_keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every customer's orders only the last stays."""
    order = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    last = table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(order)).filter("n = 1")
    return last.select("o_custkey", "o_orderkey")


def world_refund_restock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines: what goes back to the customer and what to the shelf."""
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return lines.groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("restocked"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("refunded"))


def _changed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders before and after: prices of every seventh rise, every eleventh goes, every thirteenth comes again under a new key."""
    before = _orders(spark, sf_dir)
    risen = W.updated(before, F.col("o_orderkey") % 7 == 0, {"o_totalprice": F.round(F.col("o_totalprice") + 1, 2)})
    kept = W.deleted(risen, F.col("o_orderkey") % 11 == 0)
    fresh = before.filter(F.col("o_orderkey") % 13 == 0).withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)
    return before, W.inserted(kept, fresh)


def state_diff_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _changed(spark, sf_dir)
    return W.state_diff(before, after, "o_orderkey").select("o_orderkey", "change", F.array_join("columns", ",").alias("columns"))


def state_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _changed(spark, sf_dir)
    return W.state_diff(before, after, "o_orderkey", unchanged=True).groupBy("change").agg(F.count("*").alias("n"))


def sql_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome checks of a world: expected rows, contained text, any rows; a failing query fails its check."""
    views(spark, sf_dir, "region", "nation")
    checks = [
        W.SqlCheck("regions", "SELECT count(*) FROM region", equals=[[5]]),
        W.SqlCheck("has_asia", "SELECT r_name FROM region ORDER BY r_regionkey", contains="ASIA"),
        W.SqlCheck("no_rows", "SELECT * FROM nation WHERE n_nationkey < 0", non_empty=True),
        W.SqlCheck("broken", "SELECT * FROM no_such_table", non_empty=True),
    ]
    rows = [(c.name, W.holds(spark, c)) for c in checks]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{n}', {str(p).lower()})" for n, p in rows) + " AS t(name, passed)")


QUERIES = {f.__name__: f for f in (world_left_join_agg, world_top_spender, world_correlated, world_exists, world_set_operations, world_scalars, world_update_case, world_update_correlated, world_delete_keep_latest, world_refund_restock, state_diff_pk, state_diff_counts, sql_check)}

_DIFF = """WITH b AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders),
a AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN round(o_totalprice + 1, 2) ELSE o_totalprice END AS o_totalprice FROM b WHERE o_orderkey % 11 <> 0
  UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice FROM b WHERE o_orderkey % 13 = 0),
d AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'inserted' WHEN a.o_orderkey IS NULL THEN 'deleted' WHEN a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'updated' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)"""

ORACLES = {
    "world_left_join_agg": "SELECT p_partkey, coalesce(sum(l_quantity::BIGINT), 0)::BIGINT AS units, count(l_orderkey) AS num_lines FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1",
    "world_top_spender": """
WITH t AS (SELECT c_custkey, c_name, c_nationkey, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3),
r AS (SELECT n_name, c_name, total, row_number() OVER (PARTITION BY n_name ORDER BY total DESC, c_name) AS k FROM t JOIN nation ON n_nationkey = c_nationkey) SELECT n_name, c_name, total FROM r WHERE k = 1""",
    "world_correlated": "SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "world_exists": """
SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND strftime(o_orderdate, '%Y-%m-%d') LIKE '1995-%')
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND strftime(o_orderdate, '%Y-%m-%d') LIKE '1996-%')""",
    "world_set_operations": """
SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'customers only', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)""",
    "world_scalars": "SELECT p_partkey, round(p_retailprice * 0.9e0, 2) AS sale, CASE WHEN p_size IN (1, 2, 3) THEN 'small' WHEN p_size BETWEEN 4 AND 20 THEN 'middle' ELSE 'large' END AS size_class, coalesce(nullif(p_brand, 'Brand#11'), 'own') AS brand FROM part",
    "world_update_case": "SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice < 50000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders",
    "world_update_correlated": "SELECT o_orderkey, o_custkey, coalesce((SELECT sum(l_extendedprice::DECIMAL(18,2)) FROM lineitem WHERE l_orderkey = o_orderkey)::DOUBLE, 0e0) AS o_totalprice FROM orders",
    "world_delete_keep_latest": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1",
    "world_refund_restock": "SELECT l_partkey, sum(l_quantity::BIGINT)::BIGINT AS restocked, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS refunded FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1",
    "state_diff_pk": f"{_DIFF} SELECT o_orderkey, change, CASE WHEN change = 'updated' THEN 'o_totalprice' ELSE '' END AS columns FROM d WHERE change <> 'unchanged'",
    "state_diff_counts": f"{_DIFF} SELECT change, count(*) AS n FROM d GROUP BY 1",
    "sql_check": "SELECT * FROM (VALUES ('regions', (SELECT count(*) = 5 FROM region)), ('has_asia', EXISTS (SELECT 1 FROM region WHERE r_name LIKE '%ASIA%')), ('no_rows', false), ('broken', false)) AS t(name, passed)",
}
