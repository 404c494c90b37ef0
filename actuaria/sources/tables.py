"""Parquet table scans and the derived policy table.

The policy table ``P`` (policy_id, age, sex, bmi, children, smoker, region,
charges) is a deterministic projection of ``customer`` joined with the
per-customer order count.  Every expression keeps the evaluation order of
the published SQL text so that both engines produce bit-identical doubles.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one driver table; column pruning and filters reach the parquet reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def policy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy table derived from ``customer`` and ``orders``.

    Orders are pre-aggregated per customer (partial + final hash aggregate,
    so a customer holding a third of all orders is one row per map task)
    before the join; the join key is the customer key on both sides.
    """
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    order_counts = (table(spark, sf_dir, "orders")
                    .groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders")))
    base = customer.join(order_counts, customer.c_custkey == order_counts.o_custkey, "left")
    base = base.selectExpr(
        "c_custkey AS policy_id",
        "CAST(18 + (c_custkey * 31) % 47 AS INT) AS age",
        "CASE WHEN (c_custkey * 7) % 13 < 6 THEN 'female' ELSE 'male' END AS sex",
        "CAST(2200 + (c_custkey * 37) % 800 + (c_custkey * 53) % 700"
        " + CASE WHEN c_custkey % 97 = 0 THEN 2500 ELSE 0 END AS DOUBLE) / 100 AS bmi",
        "CAST(coalesce(n_orders, 0) % 6 AS INT) AS children",
        "CASE WHEN c_mktsegment = 'BUILDING' THEN 'yes' ELSE 'no' END AS smoker",
        "CASE c_nationkey % 4 WHEN 0 THEN 'northeast' WHEN 1 THEN 'northwest'"
        " WHEN 2 THEN 'southeast' ELSE 'southwest' END AS region",
        "CAST(floor(c_acctbal + 1000) AS DOUBLE) * 0.25 AS noise",
    )
    return base.selectExpr(
        "policy_id", "age", "sex", "bmi", "children", "smoker", "region",
        "round(CAST(260 * age + 450 * children AS DOUBLE) + 60 * bmi"
        " + CASE WHEN smoker = 'yes' THEN 14000"
        " + CASE WHEN bmi >= 30 THEN 15000 + 400 * (bmi - 30) ELSE 0 END ELSE 0 END"
        " + noise, 2) AS charges",
    )


# The same derivation as SQL text, used by the DuckDB oracle (and usable
# with spark.sql after registering the two tables as views).
POLICY_SQL = """
policy_oc AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey),
policy_base AS (
 SELECT c_custkey AS policy_id,
  CAST(18 + (c_custkey * 31) % 47 AS INT) AS age,
  CASE WHEN (c_custkey * 7) % 13 < 6 THEN 'female' ELSE 'male' END AS sex,
  CAST(2200 + (c_custkey * 37) % 800 + (c_custkey * 53) % 700
       + CASE WHEN c_custkey % 97 = 0 THEN 2500 ELSE 0 END AS DOUBLE) / 100 AS bmi,
  CAST(coalesce(n_orders, 0) % 6 AS INT) AS children,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'yes' ELSE 'no' END AS smoker,
  CASE c_nationkey % 4 WHEN 0 THEN 'northeast' WHEN 1 THEN 'northwest'
       WHEN 2 THEN 'southeast' ELSE 'southwest' END AS region,
  CAST(floor(c_acctbal + 1000) AS DOUBLE) * 0.25 AS noise
 FROM customer LEFT JOIN policy_oc ON o_custkey = c_custkey),
policy AS (
 SELECT policy_id, age, sex, bmi, children, smoker, region,
  round(CAST(260 * age + 450 * children AS DOUBLE) + 60 * bmi
   + CASE WHEN smoker = 'yes' THEN 14000
          + CASE WHEN bmi >= 30 THEN 15000 + 400 * (bmi - 30) ELSE 0 END ELSE 0 END
   + noise, 2) AS charges
 FROM policy_base)
"""
