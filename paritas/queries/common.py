"""Inputs shared by the registered queries, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import Matcher


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# -- quantities per order against a changed copy ---------------------------------------------------

ORDER_MAPPING = {
    "key_source": ["l_orderkey"],
    "key_target": ["order_id"],
    "mappings": {
        "l_quantity": {
            "destinations": ["quantity"], "function": "Aggregation", "transformation": "sum",
        }
    },
}


def order_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities per order: every tenth is off by one, every thirteenth is absent, and orders
    without line items come along with a missing quantity."""
    lineitem, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    key = F.col("l_orderkey")
    known = (
        lineitem.where(key % 13 != 0).groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total"))
        .select(key.alias("order_id"),
                (F.col("total") + F.when(key % 10 == 0, 1.0).otherwise(0.0)).alias("quantity"))
    )
    seen = lineitem.select("l_orderkey").distinct()
    bare = orders.join(seen, orders.o_orderkey == seen.l_orderkey, "left_anti").select(
        F.col("o_orderkey").alias("order_id"), F.lit(None).cast("double").alias("quantity"))
    return known.unionByName(bare)


def order_matcher(spark: SparkSession, sf_dir: str) -> Matcher:
    return Matcher(table(spark, sf_dir, "lineitem"), order_target(spark, sf_dir), ORDER_MAPPING)


ORDER_SQL = """
WITH src AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, SUM(l_quantity) AS l_quantity
  FROM lineitem GROUP BY lineitem.l_orderkey
), tgt AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
         SUM(l_quantity) + CASE WHEN l_orderkey % 10 = 0 THEN 1.0 ELSE 0.0 END AS quantity
  FROM lineitem WHERE l_orderkey % 13 <> 0 GROUP BY lineitem.l_orderkey
  UNION ALL
  SELECT CAST(o_orderkey AS VARCHAR), CAST(NULL AS DOUBLE) FROM orders
  WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
), merged AS (
  SELECT src.l_orderkey, src.l_quantity, tgt.order_id, tgt.quantity,
         CASE WHEN tgt.order_id IS NULL THEN 'left_only'
              WHEN src.l_orderkey IS NULL THEN 'right_only' ELSE 'both' END AS _merge
  FROM src FULL JOIN tgt
    ON src.l_orderkey = tgt.order_id AND src.l_quantity IS NOT DISTINCT FROM tgt.quantity
)
"""

# -- events with gaps and the five rules -------------------------------------------------------------

EVENT_RULES = {
    "amount": {"validate_nulls": True, "validate_range": True, "min_value": 0, "max_value": 100},
    "user_id": {"validate_uniqueness": True},
    "event_type": {
        "validate_list_of_values": ["click", "view"],
        "validate_regex": "^(?:p|s)",
    },
    "absent_column": {"validate_nulls": True},
}


def gappy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose amount is missing in every seventh row."""
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id", "user_id", "event_type",
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("amount"),
    )


EVENT_SQL = """
WITH ev AS (
  SELECT event_id, user_id, event_type,
         CASE WHEN event_id % 7 <> 0 THEN value END AS amount
  FROM events
)
"""

RULE_ROWS_SQL = """
, n AS (SELECT COUNT(*) AS total FROM ev), counts AS (
  SELECT 0 AS rule_no, 'amount' AS column_name, 'Null values' AS rule,
         COUNT(amount) AS pass_count FROM ev
  UNION ALL
  SELECT 1, 'amount', 'Values out of range',
         COUNT(*) FILTER (WHERE amount IS NOT NULL AND amount >= 0 AND amount <= 100) FROM ev
  UNION ALL
  SELECT 2, 'user_id', 'Unique values', COUNT(DISTINCT user_id) FROM ev
  UNION ALL
  SELECT 3, 'event_type', 'Values outside allowed list',
         COUNT(*) FILTER (WHERE event_type IN ('click', 'view')) FROM ev
  UNION ALL
  SELECT 4, 'event_type', 'Values not matching regex',
         COUNT(*) FILTER (WHERE regexp_matches(event_type, '^(?:p|s)')) FROM ev
), results AS (
  SELECT rule_no, column_name, rule, pass_count, total - pass_count AS fail_count,
         printf('%.2f%%', CAST(pass_count AS DOUBLE) / total * 100.0) AS pass_pct,
         CASE WHEN CAST(printf('%.2f', CAST(pass_count AS DOUBLE) / total * 100.0) AS DOUBLE) >= 95.0
              THEN 'pass' ELSE 'fail' END AS status
  FROM counts, n
)
"""

# -- order states against labels ---------------------------------------------------------------------

STATUS_TABLE = {"P": "PENDING", "F": "FILLED"}
STATUS_MAPPING = {
    "key_source": ["o_orderkey"],
    "key_target": ["label_key"],
    "mappings": {
        "o_orderstatus": {
            "destinations": ["label"],
            "function": "Conversion mapping",
            "transformation": '{"P": "PENDING", "F": "FILLED"}',
        }
    },
}


def label_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in other spellings, wrong for every eleventh order, absent for every fifth."""
    orders = table(spark, sf_dir, "orders")
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    label = (
        F.when(key % 11 == 0, "WRONG").when(status == "P", " pending ")
        .when(status == "F", "FILLED").otherwise("O")
    )
    return orders.where(key % 5 != 0).select(key.alias("label_key"), label.alias("label"))


STATUS_SQL = """
WITH conv AS (
  SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'F' THEN 'FILLED'
                     ELSE o_orderstatus END AS o_orderstatus
  FROM orders
), lab AS (
  SELECT o_orderkey AS label_key,
         CASE WHEN o_orderkey % 11 = 0 THEN 'WRONG' WHEN o_orderstatus = 'P' THEN ' pending '
              WHEN o_orderstatus = 'F' THEN 'FILLED' ELSE 'O' END AS label
  FROM orders WHERE o_orderkey % 5 <> 0
)
"""
