"""Aggregates, rule counts, profiles, samples and the reporting jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ALLOWED_RULE, NULL_RULE, RANGE_RULE, REGEX_RULE, UNIQUE_RULE, Rule, RuleSet
from ..operators import aggregates, digest, keys, mapping, profiling, sketches
from ..operators.rules import rule_counts
from ..plans import audit_document
from ..plans import audit_report as audit
from ..plans import execute_validation as validate
from ..plans import profile_table as profile
from ..plans import validation_detail_counts as detail_counts
from ..plans import validation_details as details
from ..session import scratch_path
from ..sources.sinks import export_json
from .common import EVENT_RULES, EVENT_SQL, RULE_ROWS_SQL, Query, gappy_events, table


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with gaps: the quantity is missing for every third part, and for all of every
    ninth supplier."""
    gap = (F.col("l_partkey") % 3 == 0) | (F.col("l_suppkey") % 9 == 0)
    return table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus",
        F.when(~gap, F.col("l_quantity")).alias("l_quantity"))


_LINE_SQL = """
WITH li AS (
  SELECT l_suppkey, l_linenumber, l_extendedprice, l_returnflag, l_linestatus,
         CASE WHEN l_partkey % 3 <> 0 AND l_suppkey % 9 <> 0 THEN l_quantity END AS l_quantity
  FROM lineitem
)
"""


def _reduced(reducer: str, column: str = "l_quantity", digits: int | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = aggregates.aggregate(_lineitem(spark, sf_dir), ["l_suppkey"], [(column, reducer, "result")])
        return rows if digits is None else rows.withColumn("result", F.round("result", digits))

    return run


def _reduced_sql(expr: str) -> str:
    return _LINE_SQL + f"SELECT l_suppkey, {expr} AS result FROM li GROUP BY l_suppkey"


def agg_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("o_orderstatus"))
    return aggregates.aggregate(
        orders, ["o_custkey"], [("o_orderstatus", "first", "first_status")], order_by=["o_orderkey"])


AGG_FIRST_SQL = """
SELECT o_custkey,
       arg_min(o_orderstatus, o_orderkey) FILTER (WHERE o_orderkey % 7 <> 0) AS first_status
FROM orders GROUP BY o_custkey
"""


def agg_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aggregates.aggregate(
        _lineitem(spark, sf_dir).withColumn("factor", F.when(F.col("l_linenumber") < 3, 2.0).otherwise(1.0)),
        ["l_suppkey"],
        [("l_quantity", "count", "n"), ("l_quantity", "nunique", "n_distinct"),
         ("l_quantity", "std", "spread"), ("l_quantity", "var", "variance"),
         ("l_extendedprice", "last", "latest"), ("l_returnflag", "nunique", "n_flags"),
         ("factor", "prod", "product")],
        order_by=["l_extendedprice", "l_linenumber"])
    return rows.withColumns({c: F.round(c, 5) for c in ("spread", "variance")})


PASSTHROUGH_SQL = _LINE_SQL + """
SELECT l_suppkey, COUNT(l_quantity) AS n, COUNT(DISTINCT l_quantity) AS n_distinct,
       round(stddev_samp(l_quantity), 5) AS spread, round(var_samp(l_quantity), 5) AS variance,
       MAX(l_extendedprice) AS latest, COUNT(DISTINCT l_returnflag) AS n_flags,
       product(CASE WHEN l_linenumber < 3 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) AS product
FROM li GROUP BY l_suppkey
"""


def agg_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = _lineitem(spark, sf_dir).withColumn(
        "l_returnflag", F.when(F.col("l_suppkey") % 4 != 0, F.col("l_returnflag")))
    rows = aggregates.aggregate(
        lineitem, ["l_returnflag", "l_linestatus"],
        [("l_quantity", "sum", "total"), ("l_quantity", "mean", "average"),
         ("l_quantity", "median", "middle"), ("l_extendedprice", "max", "highest"),
         ("l_extendedprice", "min", "lowest"), ("l_linenumber", "sum", "lines")])
    return rows.withColumn("average", F.round("average", 6))


COMPOSITE_SQL = _LINE_SQL + """
SELECT l_returnflag, l_linestatus, COALESCE(SUM(l_quantity), 0) AS total,
       round(AVG(l_quantity), 6) AS average, median(l_quantity) AS middle,
       MAX(l_extendedprice) AS highest, MIN(l_extendedprice) AS lowest,
       CAST(SUM(l_linenumber) AS BIGINT) AS lines
FROM li WHERE l_suppkey % 4 <> 0 GROUP BY l_returnflag, l_linestatus
"""


def count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.count_rows(table(spark, sf_dir, "lineitem"))


def _rule(rule: Rule):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rule_counts(gappy_events(spark, sf_dir), RuleSet((rule,))).drop("rule_no", "status")

    return run


def _rule_sql(rule_no: int) -> str:
    return EVENT_SQL + RULE_ROWS_SQL + (
        f"SELECT column_name, rule, pass_count, fail_count, pass_pct FROM results WHERE rule_no = {rule_no}")


def key_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    one = keys.keys_are_unique(lineitem, ["l_orderkey", "l_linenumber"])
    other = keys.keys_are_unique(orders, ["o_orderkey"])
    return one.withColumn("key_of", F.lit("lineitem")).unionByName(other.withColumn("key_of", F.lit("orders")))


KEY_UNIQUE_SQL = """
SELECT COALESCE(MAX(n) = 1, FALSE) AS is_unique, 'lineitem' AS key_of
FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) AS a
UNION ALL
SELECT COALESCE(MAX(n) = 1, FALSE), 'orders'
FROM (SELECT COUNT(*) AS n FROM orders GROUP BY o_orderkey) AS b
"""

_NUMERIC = ("l_quantity", "l_extendedprice", "l_linenumber")


def describe_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profiling.describe_numeric(_lineitem(spark, sf_dir), _NUMERIC)
    return rows.withColumns({c: F.round(c, 5) for c in ("mean", "std", "p25", "p50", "p75")})


def _describe_sql(relation: str, column: str) -> str:
    quart = ", ".join(f"round(quantile_cont({column}, {q}), 5) AS {n}"
                      for n, q in profiling.QUARTILES.items())
    return f"""
SELECT '{column}' AS column_name, COUNT({column}) AS count, round(AVG({column}), 5) AS mean,
       round(stddev_samp({column}), 5) AS std, CAST(MIN({column}) AS DOUBLE) AS min, {quart},
       CAST(MAX({column}) AS DOUBLE) AS max FROM {relation}
"""


def describe_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.describe_categorical(
        table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority"))


def _categorical_sql(relation: str, column: str) -> str:
    return f"""
SELECT '{column}' AS column_name, COUNT({column}) AS count, COUNT(DISTINCT {column}) AS "unique",
       (SELECT {column} FROM {relation} GROUP BY {column} ORDER BY COUNT(*) DESC, {column} LIMIT 1) AS top,
       (SELECT COUNT(*) FROM {relation} GROUP BY {column} ORDER BY COUNT(*) DESC LIMIT 1) AS freq
FROM {relation}
"""


def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.null_profile(_lineitem(spark, sf_dir))


NULL_PROFILE_SQL = _LINE_SQL + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count FROM li"
    for c in ("l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus", "l_quantity"))


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.value_counts(_lineitem(spark, sf_dir), "l_quantity")


def distinct_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return mapping.distinct_value_targets(orders, "o_orderpriority", {"1-URGENT": "HIGH", "5-LOW": "LOW"})


DISTINCT_COUNTS_SQL = """
WITH p AS (SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS v FROM orders)
SELECT COALESCE(v, '<NA>') AS source_value,
       CASE v WHEN '1-URGENT' THEN 'HIGH' WHEN '5-LOW' THEN 'LOW' ELSE '' END AS target_value,
       COUNT(v) AS row_count
FROM p GROUP BY v
"""


def dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.dataset_fingerprint(_priced_orders(spark, sf_dir), separator="|")


def _priced_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with gaps, and with the separator inside of values."""
    status = F.when(F.col("o_orderkey") % 8 != 0, F.concat("o_orderstatus", F.lit("|x")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", status.alias("o_orderstatus"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))


def _told(*columns: str) -> str:
    """SQL for the texts of a row as a digest takes them: each behind its length, missing apart."""
    return ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE length({c}) || ':' || {c} END" for c in columns)


#: The four lanes of the digests' sum.
LANES_SQL = " || ',' || ".join(
    f"CAST(SUM(CAST('0x' || substr(d, {1 + 16 * i}, 16) AS UBIGINT)) AS VARCHAR)" for i in range(4))

FINGERPRINT_SQL = f"""
WITH t AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS a, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderstatus || '|x' END AS b,
         CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) AS c FROM orders
), h AS (SELECT sha256(concat_ws('|', {_told("a", "b", "c")})) AS d FROM t),
s AS (SELECT COUNT(*) AS n_rows, {LANES_SQL} AS digest_sum FROM h)
SELECT n_rows, 3 AS n_columns, digest_sum,
       sha256(n_rows || '|3|10:o_orderkey|13:o_orderstatus|5:price|' || digest_sum) AS checksum
FROM s
"""


def preview_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.preview(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"),
        ["o_totalprice", "o_orderkey"], 10)


def topk_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.topk_values(table(spark, sf_dir, "lineitem"), "l_partkey", 10)


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return profiling.seeded_sample(orders, ["o_orderkey"], n=1000, seed=42)


SAMPLE_SQL = """
SELECT o_orderkey, o_orderstatus FROM orders
ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 1000
"""


def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.distinct_values(_lineitem(spark, sf_dir), "l_quantity")


def apply_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumns({
        "o_orderstatus": F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")),
        "middle": F.col("o_totalprice"),
        "priced": F.col("o_totalprice"),
    })
    config = {
        "key_source": ["o_custkey"],
        "key_target": ["c_custkey"],
        "mappings": {
            "o_orderstatus": {"destinations": ["status"], "function": "Conversion mapping",
                              "transformation": '{"P": "PENDING", "F": "FILLED"}'},
            "o_orderpriority": {"destinations": ["priority"], "function": "Direct mapping"},
            "o_totalprice": {"destinations": ["largest"], "function": "Aggregation",
                             "transformation": "max"},
            "middle": {"destinations": ["middle"], "function": "Aggregation",
                       "transformation": "median"},
            "priced": {"destinations": ["priced"], "function": "Aggregation",
                       "transformation": "count"},
        },
    }
    rows = mapping.apply_rules(orders, config, order_by=["o_orderkey"])
    return rows.withColumn("middle", F.round("middle", 4))


APPLY_SQL = """
SELECT o_custkey,
       arg_min(CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'F' THEN 'FILLED' ELSE o_orderstatus END,
               o_orderkey) FILTER (WHERE o_orderkey % 7 <> 0) AS o_orderstatus,
       arg_min(o_orderpriority, o_orderkey) AS o_orderpriority,
       MAX(o_totalprice) AS o_totalprice, round(median(o_totalprice), 4) AS middle,
       COUNT(o_totalprice) AS priced
FROM orders GROUP BY o_custkey
"""


def execute_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(gappy_events(spark, sf_dir), EVENT_RULES)


def validation_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return details(gappy_events(spark, sf_dir), EVENT_RULES)


DETAILS_SQL = EVENT_SQL + """
SELECT 0 AS rule_no, 'amount' AS column_name, 'Null values' AS rule, * FROM ev WHERE amount IS NULL
UNION ALL SELECT 1, 'amount', 'Values out of range', * FROM ev WHERE amount < 0 OR amount > 100
UNION ALL SELECT 2, 'user_id', 'Unique values', * FROM ev
  WHERE user_id IN (SELECT user_id FROM ev GROUP BY user_id HAVING COUNT(*) > 1)
UNION ALL SELECT 3, 'event_type', 'Values outside allowed list', * FROM ev
  WHERE event_type NOT IN ('click', 'view')
UNION ALL SELECT 4, 'event_type', 'Values not matching regex', * FROM ev
  WHERE NOT regexp_matches(event_type, '^(?:p|s)')
"""

DETAIL_COUNTS_SQL = f"""
SELECT rule_no, column_name, rule, COUNT(*) AS n_rows FROM ({DETAILS_SQL}) GROUP BY ALL
"""


def validation_detail_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detail_counts(gappy_events(spark, sf_dir), EVENT_RULES)


def merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches per supplier, merged to one per return flag, held against the exact numbers of the same table."""
    lineitem = table(spark, sf_dir, "lineitem")
    stored = sketches.value_sketches(lineitem, ["l_returnflag", "l_suppkey"], ["l_partkey"], ["l_extendedprice"])
    found = sketches.read_sketches(sketches.merged_sketches(stored, ["l_returnflag"]), ["l_returnflag"])
    exact = aggregates.aggregate(lineitem, ["l_returnflag"], [("l_partkey", "nunique", "parts")])
    ranks = lineitem.join(found.select("l_returnflag", "l_extendedprice_p50"), "l_returnflag").groupBy("l_returnflag").agg(
        F.avg((F.col("l_extendedprice") < F.col("l_extendedprice_p50")).cast("double")).alias("below"))
    close = F.abs(F.col("l_partkey_distinct") - F.col("parts")) <= 4 * sketches.DISTINCT_ERROR * F.col("parts") + 1
    near = F.abs(F.col("below") - 0.5) <= 3 * sketches.RANK_ERROR
    return found.join(exact, "l_returnflag").join(ranks, "l_returnflag").select(
        "l_returnflag", "n_rows", close.alias("distinct_is_close"), near.alias("median_is_close"))


MERGED_SKETCHES_SQL = """
SELECT l_returnflag, COUNT(*) AS n_rows, TRUE AS distinct_is_close, TRUE AS median_is_close FROM lineitem GROUP BY l_returnflag
"""

_CUSTOMER = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(table(spark, sf_dir, "customer"), ["c_custkey"])


def _profile_sql() -> str:
    preview = """
SELECT 'preview' AS section, CAST(NULL AS VARCHAR) AS column_name, 'row' AS metric,
       '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"c_acctbal":' || c_acctbal ||
       ',"c_mktsegment":"' || c_mktsegment || '"}' AS value
FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 5) AS head
"""
    parts = [preview]
    for name in _CUSTOMER:
        parts.append(f"SELECT 'types', '{name}', 'type', '{_CUSTOMER[name]}'")
        parts.append(f"SELECT 'nulls', '{name}', 'null_count', CAST(COUNT(*) - COUNT({name}) AS VARCHAR) FROM customer")
    for name in [n for n, kind in _CUSTOMER.items() if kind != "string"]:
        exprs = {
            "count": f"CAST(COUNT({name}) AS VARCHAR)",
            "mean": f"printf('%.6f', AVG({name}))",
            "std": f"printf('%.6f', stddev_samp({name}))",
            "min": f"printf('%.6f', CAST(MIN({name}) AS DOUBLE))",
            "max": f"printf('%.6f', CAST(MAX({name}) AS DOUBLE))",
            **{n: f"printf('%.6f', quantile_cont(CAST({name} AS DOUBLE), {q}))"
               for n, q in profiling.QUARTILES.items()},
        }
        parts += [f"SELECT 'summary', '{name}', '{m}', {e} FROM customer" for m, e in exprs.items()]
    texts = [_categorical_sql("customer", n) for n, kind in _CUSTOMER.items() if kind == "string"]
    top = f"WITH d AS ({' UNION ALL '.join(texts)}) "
    for metric in ("count", '"unique"', "top", "freq"):
        parts.append(f"SELECT 'summary', column_name, '{metric.strip(chr(34))}', CAST({metric} AS VARCHAR) FROM d")
    return top + " UNION ALL ".join(parts)


_AUDIT_RULES = {"balance": {"validate_range": True, "min_value": 0, "max_value": None},
                "segment": {"validate_list_of_values": ["BUILDING"]}}
_AUDIT_MAPPING = {
    "key_source": ["c_custkey"],
    "key_target": ["id"],
    "mappings": {"c_mktsegment": {"destinations": ["segment"], "function": "Direct mapping"}},
}


def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers against a copy that lacks every sixth and relabels every fifth."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    target = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 6 != 0).select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).otherwise("NONE").alias("segment"))
    return audit(customer, target, _AUDIT_MAPPING, _AUDIT_RULES, "2024-01-01T00:00:00", ["c_custkey"])


def export_audit_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the report, written as one document and read back where its checksum holds."""
    path = scratch_path(spark, "audit")
    export_json(audit_document(audit_report(spark, sf_dir)), path)
    stored = spark.read.schema("document string, checksum string").json(path)
    lines = F.from_json("document", "array<struct<section:string,item:string,metric:string,value:string>>")
    return stored.where(F.sha2("document", 256) == F.col("checksum")).select(F.inline(lines))


AUDIT_SQL = f"""
WITH src AS (SELECT c_custkey, c_mktsegment FROM customer),
tgt AS (
  SELECT c_custkey AS id, c_acctbal AS balance,
         CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment ELSE 'NONE' END AS segment
  FROM customer WHERE c_custkey % 6 <> 0
), h AS (
  SELECT 'source' AS side, 2 AS c, '9:c_custkey' || chr(31) || '12:c_mktsegment' AS names,
         sha256(concat_ws(chr(31), {_told("CAST(c_custkey AS VARCHAR)", "c_mktsegment")})) AS d FROM src
  UNION ALL
  SELECT 'target', 3, '2:id' || chr(31) || '7:balance' || chr(31) || '7:segment',
         sha256(concat_ws(chr(31), {_told("CAST(id AS VARCHAR)", "CAST(balance AS VARCHAR)", "segment")})) FROM tgt
), f AS (
  SELECT side, c, names, COUNT(*) AS n, {LANES_SQL} AS digest_sum FROM h GROUP BY side, c, names
), joined AS (
  SELECT id, c_custkey FROM src FULL JOIN tgt ON c_custkey = id AND c_mktsegment IS NOT DISTINCT FROM segment
), r AS (
  SELECT 'balance: Values out of range' AS item, COUNT(*) FILTER (WHERE balance >= 0) AS p, COUNT(*) AS n FROM tgt
  UNION ALL
  SELECT 'segment: Values outside allowed list', COUNT(*) FILTER (WHERE segment = 'BUILDING'), COUNT(*) FROM tgt
), v AS (SELECT item, p, n - p AS q, CAST(p AS DOUBLE) / n * 100.0 AS pct FROM r)
SELECT 'report' AS section, 'report' AS item, 'generated_at' AS metric, '2024-01-01T00:00:00' AS value
UNION ALL SELECT 'mapping', 'keys', 'source', 'c_custkey'
UNION ALL SELECT 'mapping', 'keys', 'target', 'id'
UNION ALL SELECT 'mapping', 'c_mktsegment', 'destinations', 'segment'
UNION ALL SELECT 'mapping', 'c_mktsegment', 'function', 'Direct mapping'
UNION ALL SELECT 'mapping', 'c_mktsegment', 'transformation', NULL
UNION ALL SELECT 'validation_configuration', 'balance', 'validate_range', 'True'
UNION ALL SELECT 'validation_configuration', 'balance', 'min_value', '0'
UNION ALL SELECT 'validation_configuration', 'balance', 'max_value', 'None'
UNION ALL SELECT 'validation_configuration', 'segment', 'validate_list_of_values', '[''BUILDING'']'
UNION ALL SELECT 'data_audit', side, 'rows', CAST(n AS VARCHAR) FROM f
UNION ALL SELECT 'data_audit', side, 'columns', CAST(c AS VARCHAR) FROM f
UNION ALL SELECT 'data_audit', side, 'checksum',
  sha256(n || chr(31) || c || chr(31) || names || chr(31) || digest_sum) FROM f
UNION ALL SELECT 'matching', 'records', 'total_match',
  CAST(COUNT(*) FILTER (WHERE id IS NOT NULL AND c_custkey IS NOT NULL) AS VARCHAR) FROM joined
UNION ALL SELECT 'matching', 'records', 'missing_source', CAST(COUNT(*) FILTER (WHERE c_custkey IS NULL) AS VARCHAR) FROM joined
UNION ALL SELECT 'matching', 'records', 'missing_target', CAST(COUNT(*) FILTER (WHERE id IS NULL) AS VARCHAR) FROM joined
UNION ALL SELECT 'validation_results', item, 'pass_count', CAST(p AS VARCHAR) FROM v
UNION ALL SELECT 'validation_results', item, 'fail_count', CAST(q AS VARCHAR) FROM v
UNION ALL SELECT 'validation_results', item, 'pass_pct', printf('%.2f%%', pct) FROM v
UNION ALL SELECT 'validation_results', item, 'status',
  CASE WHEN CAST(printf('%.2f', pct) AS DOUBLE) >= 95 THEN 'pass' ELSE 'fail' END FROM v
"""

QUERIES = {
    "agg_first": Query(agg_first, AGG_FIRST_SQL),
    "agg_sum": Query(_reduced("sum"), _reduced_sql("COALESCE(SUM(l_quantity), 0)")),
    "agg_mean": Query(_reduced("mean", digits=6), _reduced_sql("round(AVG(l_quantity), 6)")),
    "agg_median": Query(_reduced("median", "l_extendedprice", 4), _reduced_sql("round(median(l_extendedprice), 4)")),
    "agg_max": Query(_reduced("max"), _reduced_sql("MAX(l_quantity)")),
    "agg_min": Query(_reduced("min"), _reduced_sql("MIN(l_quantity)")),
    "agg_passthrough": Query(agg_passthrough, PASSTHROUGH_SQL),
    "agg_composite_key": Query(agg_composite_key, COMPOSITE_SQL),
    "count_rows": Query(count_rows, "SELECT COUNT(*) AS n_rows, 11 AS n_columns FROM lineitem"),
    "rule_nulls": Query(_rule(Rule("amount", NULL_RULE)), _rule_sql(0)),
    "rule_range": Query(_rule(Rule("amount", RANGE_RULE, low=0.0, high=100.0)), _rule_sql(1)),
    "merged_sketches": Query(merged_sketches, MERGED_SKETCHES_SQL),
    "rule_uniqueness": Query(_rule(Rule("user_id", UNIQUE_RULE)), _rule_sql(2)),
    "rule_allowed": Query(_rule(Rule("event_type", ALLOWED_RULE, allowed=("click", "view"))), _rule_sql(3)),
    "rule_regex": Query(_rule(Rule("event_type", REGEX_RULE, pattern="^(?:p|s)")), _rule_sql(4)),
    "key_uniqueness": Query(key_uniqueness, KEY_UNIQUE_SQL),
    "describe_numeric": Query(
        describe_numeric, _LINE_SQL + " UNION ALL ".join(_describe_sql("li", c) for c in _NUMERIC)),
    "describe_categorical": Query(
        describe_categorical,
        " UNION ALL ".join(_categorical_sql("orders", c) for c in ("o_orderstatus", "o_orderpriority"))),
    "null_profile": Query(null_profile, NULL_PROFILE_SQL),
    "value_counts": Query(
        value_counts, _LINE_SQL + "SELECT l_quantity AS value, COUNT(*) AS row_count FROM li "
        "WHERE l_quantity IS NOT NULL GROUP BY l_quantity"),
    "distinct_value_counts": Query(distinct_value_counts, DISTINCT_COUNTS_SQL),
    "dataset_fingerprint": Query(dataset_fingerprint, FINGERPRINT_SQL),
    "preview_head": Query(
        preview_head, "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders "
        "ORDER BY o_totalprice, o_orderkey LIMIT 10"),
    "topk_values": Query(
        topk_values, "SELECT l_partkey AS value, COUNT(*) AS row_count FROM lineitem "
        "GROUP BY l_partkey ORDER BY row_count DESC, value LIMIT 10"),
    "seeded_sample": Query(seeded_sample, SAMPLE_SQL),
    "distinct_values": Query(
        distinct_values, _LINE_SQL + "SELECT DISTINCT l_quantity AS value FROM li"),
    "apply_rules": Query(apply_rules, APPLY_SQL),
    "execute_validation": Query(execute_validation, EVENT_SQL + RULE_ROWS_SQL + "SELECT * FROM results"),
    "validation_details": Query(validation_details, DETAILS_SQL),
    "validation_detail_counts": Query(validation_detail_counts, DETAIL_COUNTS_SQL),
    "export_audit_document": Query(export_audit_document, AUDIT_SQL),
    "profile_table": Query(profile_table, _profile_sql()),
    "audit_report": Query(audit_report, AUDIT_SQL),
}
