"""Joins and match statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.accuracy import KEYS, KEYS_AND_VALUES, mapping_accuracy
from ..operators.accuracy import key_match_stats as key_stats
from ..operators.aggregates import aggregate
from ..operators.matching import Matcher, first_per_key, rows_with_keys
from ..plans import evaluate_mapping as evaluate
from ..plans import execute_matching as match
from .common import (
    ORDER_MAPPING,
    ORDER_SQL,
    STATUS_MAPPING,
    STATUS_SQL,
    Query,
    label_target,
    order_matcher,
    order_target,
    table,
)

_COLUMNS = "l_orderkey, l_quantity, order_id, quantity, _merge"


def reconcile_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_matcher(spark, sf_dir).merged()


def hot_key_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers against suppliers of their nation: every key has many rows on both sides, and their product."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").where("s_nationkey % 5 <> 0")
    matcher = Matcher(customer, supplier, {"key_source": ["c_nationkey"], "key_target": ["s_nationkey"], "mappings": {}})
    return matcher.merged(grid_rows=4)


HOT_KEY_SQL = """
SELECT c_custkey, c_nationkey::VARCHAR AS c_nationkey, s_suppkey, s_nationkey::VARCHAR AS s_nationkey,
       CASE WHEN s_nationkey IS NULL THEN 'left_only' WHEN c_nationkey IS NULL THEN 'right_only' ELSE 'both' END AS _merge
FROM customer FULL JOIN (SELECT * FROM supplier WHERE s_nationkey % 5 <> 0) ON c_nationkey = s_nationkey
"""


def merge_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = order_matcher(spark, sf_dir).merged()
    return merged.groupBy("_merge").agg(F.count(F.lit(1)).alias("row_count"))


def matched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_matcher(spark, sf_dir).matched()


def unmatched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_matcher(spark, sf_dir).unmatched()


def match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_matcher(spark, sf_dir).stats()


STATS_SQL = ORDER_SQL + """
SELECT COUNT(*) FILTER (WHERE _merge = 'both') AS total_match,
       COUNT(*) FILTER (WHERE _merge = 'right_only') AS missing_source,
       COUNT(*) FILTER (WHERE _merge = 'left_only') AS missing_target
FROM merged
"""


def semi_join_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return rows_with_keys(lineitem, ["l_orderkey"], order_matcher(spark, sf_dir).matched_keys())


SEMI_SQL = ORDER_SQL + """
SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem
WHERE CAST(l_orderkey AS VARCHAR) IN (SELECT merged.l_orderkey FROM merged WHERE _merge = 'both')
"""


def first_match_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    first = first_per_key(orders, ["o_custkey"], ["o_orderkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"])
    joined = customer.join(first, F.col("c_custkey") == F.col("o_custkey"))
    return joined.select("c_custkey", "o_orderkey", "o_orderstatus")


FIRST_SQL = """
SELECT c_custkey, o_orderkey, o_orderstatus FROM customer JOIN (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place
  FROM orders) AS ranked ON c_custkey = o_custkey
WHERE place = 1
"""


def inner_join_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reducers of several columns per key: one aggregate holds what joining one per column would."""
    triples = [("l_quantity", "sum", "total"), ("l_linenumber", "max", "highest"), ("l_tax", "min", "lowest_tax")]
    return aggregate(table(spark, sf_dir, "lineitem"), ["l_suppkey"], triples)


INNER_AGG_SQL = """
SELECT l_suppkey, SUM(l_quantity) AS total, MAX(l_linenumber) AS highest, MIN(l_tax) AS lowest_tax
FROM lineitem GROUP BY l_suppkey
"""


def key_match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against customers, row by row: a customer's orders all match."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    matcher = Matcher(orders, customer, {"key_source": ["o_custkey"], "key_target": ["c_custkey"]})
    return key_stats(orders, customer, matcher)


KEY_STATS_SQL = """
WITH a AS (SELECT COUNT(DISTINCT o_custkey) AS s FROM orders),
     b AS (SELECT COUNT(DISTINCT c_custkey) AS t FROM customer),
     c AS (SELECT COUNT(*) AS m FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT s AS total_source_keys, t AS total_target_keys, m AS matched_keys,
       printf('%.2f%%', CAST(m AS DOUBLE) / s * 100.0) AS match_rate
FROM a, b, c
"""


def accuracy_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = order_target(spark, sf_dir)
    return mapping_accuracy(target, order_matcher(spark, sf_dir), ["order_id"], match_on=KEYS)


_NUMERIC_ROW = """
SELECT 'aggregation' AS kind, 'l_quantity' AS column_name,
       COUNT(*) FILTER (WHERE abs(l_quantity - quantity) <= 1e-8 + 1e-5 * abs(quantity)) AS matches,
       COUNT(*) AS total
FROM src JOIN tgt ON src.l_orderkey = tgt.order_id
"""
_ACCURACY = """
SELECT kind, column_name, matches, total,
       CASE WHEN total > 0 THEN printf('%.2f%%', CAST(matches AS DOUBLE) / total * 100.0)
            ELSE '0%' END AS accuracy
"""


def accuracy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, target = table(spark, sf_dir, "orders"), label_target(spark, sf_dir)
    matcher = Matcher(orders, target, STATUS_MAPPING, order_by=["o_orderkey"])
    return mapping_accuracy(target, matcher, ["label_key"], match_on=KEYS)


_TEXT_ROW = """
SELECT 'conversion' AS kind, 'o_orderstatus' AS column_name,
       COUNT(*) FILTER (WHERE upper(trim(o_orderstatus)) = upper(trim(label))) AS matches,
       COUNT(*) AS total
FROM conv JOIN lab ON o_orderkey = label_key
"""


def execute_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per customer: decimal sums and the converted state of the first order. The target
    differs in every tenth sum and every seventh state, and lacks every seventeenth customer, so
    that all three kinds of rows occur."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_custkey")
    mapping = {
        "key_source": ["o_custkey"],
        "key_target": ["customer"],
        "mappings": {
            "o_totalprice": {"destinations": ["unused", "total"], "function": "Aggregation",
                             "transformation": "sum"},
            "o_orderstatus": {"destinations": ["status"], "function": "Conversion mapping",
                              "transformation": '{"P": "PENDING", "F": "FILLED"}'},
        },
    }
    target = orders.groupBy("o_custkey").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"),
        F.min_by("o_orderstatus", "o_orderkey").alias("first_status"),
    ).where(key % 17 != 0).select(
        key.alias("customer"),
        (F.col("total") + F.when(key % 10 == 0, 1).otherwise(0)).alias("total"),
        F.when(key % 7 == 0, "CHANGED").when(F.col("first_status") == "P", "PENDING")
        .when(F.col("first_status") == "F", "FILLED").otherwise(F.col("first_status")).alias("status"),
    )
    merged, _ = match(orders, target, mapping, order_by=["o_orderkey"], scale=2)
    return merged.withColumns({c: F.col(c).cast("double") for c in ("o_totalprice", "total")})


EXECUTE_SQL = """
WITH per AS (
  SELECT o_custkey, SUM(CAST(o_totalprice AS DECIMAL(18, 2))) AS amount,
         arg_min(o_orderstatus, o_orderkey) AS first_status
  FROM orders GROUP BY o_custkey
), labelled AS (
  SELECT *, CASE first_status WHEN 'P' THEN 'PENDING' WHEN 'F' THEN 'FILLED' ELSE first_status END AS label
  FROM per
), src AS (
  SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, amount AS o_totalprice, label AS o_orderstatus FROM labelled
), tgt AS (
  SELECT CAST(o_custkey AS VARCHAR) AS customer,
         amount + CASE WHEN o_custkey % 10 = 0 THEN 1 ELSE 0 END AS total,
         CASE WHEN o_custkey % 7 = 0 THEN 'CHANGED' ELSE label END AS status
  FROM labelled WHERE o_custkey % 17 <> 0
)
SELECT o_custkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderstatus, customer,
       CAST(total AS DOUBLE) AS total, status,
       CASE WHEN customer IS NULL THEN 'left_only' WHEN o_custkey IS NULL THEN 'right_only'
            ELSE 'both' END AS _merge
FROM src FULL JOIN tgt ON o_custkey = customer AND o_totalprice IS NOT DISTINCT FROM total
                      AND o_orderstatus IS NOT DISTINCT FROM status
"""


def evaluate_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = order_target(spark, sf_dir)
    return evaluate(table(spark, sf_dir, "lineitem"), target, ORDER_MAPPING, ["order_id"],
                    match_on=KEYS_AND_VALUES)


EVALUATE_SQL = ORDER_SQL + """
, keys AS (
  SELECT (SELECT COUNT(DISTINCT l_orderkey) FROM lineitem) AS s,
         (SELECT COUNT(DISTINCT order_id) FROM tgt) AS t,
         (SELECT COUNT(*) FROM merged WHERE _merge = 'both') AS m
)
SELECT 'mapped_columns' AS section, 'l_quantity' AS item, 'destination' AS metric, 'quantity' AS value
UNION ALL SELECT 'key_matches', 'keys', 'total_source_keys', CAST(s AS VARCHAR) FROM keys
UNION ALL SELECT 'key_matches', 'keys', 'total_target_keys', CAST(t AS VARCHAR) FROM keys
UNION ALL SELECT 'key_matches', 'keys', 'matched_keys', CAST(m AS VARCHAR) FROM keys
UNION ALL SELECT 'key_matches', 'keys', 'match_rate', printf('%.2f%%', CAST(m AS DOUBLE) / s * 100.0) FROM keys
UNION ALL SELECT 'aggregation_accuracy', 'l_quantity', 'matches', CAST(m AS VARCHAR) FROM keys
UNION ALL SELECT 'aggregation_accuracy', 'l_quantity', 'total', CAST(m AS VARCHAR) FROM keys
UNION ALL SELECT 'aggregation_accuracy', 'l_quantity', 'accuracy', '100.00%' FROM keys
"""

def merged_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_matcher(spark, sf_dir).sample(["l_orderkey", "order_id"], n=1000, seed=42)


MERGED_SAMPLE_SQL = ORDER_SQL + f"""
SELECT {_COLUMNS}, _merge = 'both' AS is_match FROM merged
ORDER BY md5('42|' || COALESCE(l_orderkey, '<NA>') || '|' || COALESCE(order_id, '<NA>')), l_orderkey, order_id LIMIT 1000
"""


def exact_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of large decimals against targets that differ in the last of their digits, or in type only."""
    big = F.lit("90000000000000").cast("decimal(18,2)")
    lineitem = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_extendedprice").cast("decimal(18,2)") + big).cast("decimal(18,2)").alias("price"))
    sums = lineitem.groupBy("l_orderkey").agg(F.sum("price").alias("total"))
    off = F.when(F.col("l_orderkey") % 3 == 0, F.lit("0.01")).otherwise("0.00").cast("decimal(18,2)")
    target = sums.select(F.col("l_orderkey").alias("order_id"), (F.col("total") + off).cast("decimal(24,4)").alias("sum"))
    mapping = {"key_source": ["l_orderkey"], "key_target": ["order_id"], "mappings": {
        "price": {"destinations": ["sum"], "function": "Aggregation", "transformation": "sum"}}}
    return Matcher(lineitem, target, mapping).stats()


EXACT_SQL = """
WITH s AS (SELECT DISTINCT l_orderkey FROM lineitem)
SELECT COUNT(*) FILTER (WHERE l_orderkey % 3 <> 0) AS total_match,
       COUNT(*) FILTER (WHERE l_orderkey % 3 = 0) AS missing_source,
       COUNT(*) FILTER (WHERE l_orderkey % 3 = 0) AS missing_target
FROM s
"""

QUERIES = {
    "merged_sample": Query(merged_sample, MERGED_SAMPLE_SQL),
    "exact_decimals": Query(exact_decimals, EXACT_SQL),
    "reconcile_full_outer": Query(reconcile_full_outer, ORDER_SQL + f"SELECT {_COLUMNS} FROM merged"),
    "hot_key_merge": Query(hot_key_merge, HOT_KEY_SQL),
    "merge_indicator": Query(
        merge_indicator, ORDER_SQL + "SELECT _merge, COUNT(*) AS row_count FROM merged GROUP BY _merge"),
    "matched_rows": Query(matched_rows, ORDER_SQL + f"SELECT {_COLUMNS} FROM merged WHERE _merge = 'both'"),
    "unmatched_rows": Query(unmatched_rows, ORDER_SQL + f"SELECT {_COLUMNS} FROM merged WHERE _merge <> 'both'"),
    "match_stats": Query(match_stats, STATS_SQL),
    "semi_join_matched": Query(semi_join_matched, SEMI_SQL),
    "first_match_lookup": Query(first_match_lookup, FIRST_SQL),
    "inner_join_aggregates": Query(inner_join_aggregates, INNER_AGG_SQL),
    "key_match_stats": Query(key_match_stats, KEY_STATS_SQL),
    "accuracy_numeric": Query(
        accuracy_numeric, ORDER_SQL + f", acc AS ({_NUMERIC_ROW})" + _ACCURACY + "FROM acc"),
    "accuracy_text": Query(accuracy_text, STATUS_SQL + f", acc AS ({_TEXT_ROW})" + _ACCURACY + "FROM acc"),
    "execute_matching": Query(execute_matching, EXECUTE_SQL),
    "evaluate_mapping": Query(evaluate_mapping, EVALUATE_SQL),
}
