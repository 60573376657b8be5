"""Projections, scalar functions, keys and row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn
from .. import sources
from ..config import ALLOWED_RULE, NULL_RULE, RANGE_RULE, REGEX_RULE, UNIQUE_RULE, Rule
from ..operators import keys as key_ops
from ..config import TableMapping
from ..operators.digest import row_digest as digest_of
from ..operators.mapping import convert_by_join, convert_values as convert
from ..operators.mapping import project_mapped as project
from ..operators.rules import failing_rows
from .common import EVENT_SQL, STATUS_TABLE, Query, gappy_events, table


def project_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = {
        "key_source": ["o_custkey"],
        "key_target": ["c_custkey"],
        "mappings": {
            "o_totalprice": {"destinations": ["total"], "function": "Aggregation",
                             "transformation": "max"},
            "o_orderstatus": {"destinations": ["status"], "function": "Direct mapping"},
            "o_orderpriority": {"destinations": [], "function": "Conversion mapping",
                                "transformation": ""},
        },
    }
    return project(table(spark, sf_dir, "orders"), mapping)


def stringify(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumns({
        "is_final": F.col("o_orderstatus") == "F",
        "o_orderpriority": F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")),
        "large": F.col("o_totalprice") * 1048576.0,
    })
    names = ["o_orderkey", "o_totalprice", "large", "o_orderpriority", "o_orderdate", "is_final"]
    return orders.select(*[fn.stringify(F.col(n), orders.schema[n].dataType).alias(n) for n in names])


STRINGIFY_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
       CAST(o_totalprice * 1048576.0 AS VARCHAR) AS large,
       CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority ELSE '<NA>' END AS o_orderpriority,
       CAST(o_orderdate AS VARCHAR) AS o_orderdate,
       CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'False' END AS is_final
FROM orders
"""


#: A mapping whose table has a value without a target, which keeps its own text.
_CUSTOMERS = TableMapping.of({
    "key_source": ["o_orderkey"], "key_target": ["o_orderkey"],
    "mappings": {"o_custkey": {"destinations": ["customer"], "function": "Conversion mapping",
                               "transformation": '{"7": "seven", "8": null}'}},
})


def convert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus"))
    return orders.select(
        "o_orderkey",
        convert(status, T.StringType(), {**STATUS_TABLE, "<NA>": "UNKNOWN"}).alias("status"),
        convert(F.col("o_custkey"), T.LongType(), dict(_CUSTOMERS.columns[0].dictionary)).alias("customer"),
    )


CONVERT_SQL = """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 9 = 0 THEN 'UNKNOWN' WHEN o_orderstatus = 'P' THEN 'PENDING'
            WHEN o_orderstatus = 'F' THEN 'FILLED' ELSE o_orderstatus END AS status,
       CASE WHEN o_custkey = 7 THEN 'seven' ELSE CAST(o_custkey AS VARCHAR) END AS customer
FROM orders
"""


def dictionary_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers; the dictionary lacks every third nation, whose number then stays, and names
    every fourth one twice."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").where(F.col("n_nationkey") % 3 != 0).select(
        F.col("n_nationkey").cast("string").alias("value"), F.col("n_name").alias("converted"))
    again = nation.where(F.col("value").cast("int") % 4 == 0).withColumn("converted", F.lit("zz"))
    return convert_by_join(customer, "c_nationkey", nation.union(again))


DICTIONARY_SQL = """
SELECT c_custkey, COALESCE(n_name, CAST(c_nationkey AS VARCHAR)) AS c_nationkey
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 3 <> 0
"""


def cast_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("o_custkey"),
        "o_totalprice")
    return key_ops.cast_keys(orders, ["o_orderkey", "o_custkey"])


CAST_KEYS_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
       CASE WHEN o_custkey % 10 <> 0 THEN CAST(o_custkey AS VARCHAR) ELSE '<NA>' END AS o_custkey,
       o_totalprice
FROM orders
"""


# Compatibility characters and how they read once folded, written out by hand.
_FOLDED = {"ﬁx": "fix", "½": "12", "Ⅷ": "viii", "№ 5": "no 5", "x™": "xtm", "a…": "a...", "ＡＢｃ": "abc", "ß": "", "㎏²": "kg2",
           "Å": "a", "ǅ": "dz", " ": ""}


def normalize_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, each with one of the compatibility characters behind it."""
    documents = table(spark, sf_dir, "documents")
    ending = F.get(F.array(*[F.lit(text) for text in _FOLDED]), (F.col("doc_id") % len(_FOLDED)).cast("int"))
    rows = documents.select("doc_id", F.concat("text", ending).alias("text"), F.concat(F.lit(" "), "lang", ending).alias("lang"))
    return key_ops.normalize_keys(rows, ["text", "lang", "absent"])


def _normal_sql(col: str) -> str:
    """The same by DuckDB's own removal of accents, and the folded endings as literals."""
    space = r"[\s\x1c-\x1f\x{85}\pZ]+"
    endings = " ".join(f"WHEN {i} THEN '{text}'" for i, text in enumerate(_FOLDED.values()))
    bare = f"regexp_replace({col}, '^{space}', '')"
    stripped = f"CASE WHEN doc_id % {len(_FOLDED)} = {len(_FOLDED) - 1} THEN regexp_replace({bare}, '{space}$', '') ELSE {bare} END"
    return (f"lower(regexp_replace(strip_accents({stripped}), '[^\\x00-\\x7F]', '', 'g')) || "
            f"CASE doc_id % {len(_FOLDED)} {endings} END")


NORMALIZE_SQL = f"""
SELECT doc_id, {_normal_sql('text')} AS text, {_normal_sql('lang')} AS lang FROM documents
"""


def fill_key_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 8 != 0, F.col("o_orderkey")).alias("o_orderkey"),
        F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("o_custkey"),
        "o_orderstatus")
    return key_ops.prepare_keys(orders, ["o_orderkey", "o_custkey"])


FILL_SQL = """
SELECT CASE WHEN o_orderkey % 8 <> 0 THEN CAST(o_orderkey AS VARCHAR) ELSE '__NA__' END AS o_orderkey,
       CASE WHEN o_custkey % 10 <> 0 THEN CAST(o_custkey AS VARCHAR) ELSE '__NA__' END AS o_custkey,
       o_orderstatus
FROM orders
"""


def drop_empty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_orderkey")
    lineitem = table(spark, sf_dir, "lineitem").select(
        F.when(key % 3 == 0, key).alias("l_orderkey"),
        F.when(key % 5 == 0, F.col("l_quantity")).when(key % 7 == 0, float("nan")).alias("l_quantity"),
        F.when(key % 2 == 0, F.col("l_returnflag")).alias("l_returnflag"))
    return key_ops.drop_empty_rows(lineitem).select(
        "l_orderkey", fn.fold_nan(F.col("l_quantity"), T.DoubleType()).alias("l_quantity"), "l_returnflag")


DROP_EMPTY_SQL = """
SELECT CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey END AS l_orderkey,
       CASE WHEN l_orderkey % 5 = 0 THEN l_quantity END AS l_quantity,
       CASE WHEN l_orderkey % 2 = 0 THEN l_returnflag END AS l_returnflag
FROM lineitem WHERE l_orderkey % 3 = 0 OR l_orderkey % 5 = 0 OR l_orderkey % 2 = 0
"""


def to_numeric_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, value = F.col("event_id"), F.col("value").cast("string")
    text = (
        F.when(key % 6 == 0, F.concat(value, F.lit("d"))).when(key % 6 == 1, F.concat(F.lit(" "), value, F.lit("\t")))
        .when(key % 6 == 2, F.col("props")).when(key % 6 == 3, F.lit("1_000"))
        .when(key % 6 == 4, F.concat(F.lit("+"), value, F.lit("e2"))).otherwise(value)
    )
    return table(spark, sf_dir, "events").select("event_id", fn.text_to_double(text).alias("number"))


NUMERIC_SQL = """
SELECT event_id, CASE event_id % 6 WHEN 1 THEN value WHEN 5 THEN value
                 WHEN 4 THEN CAST(CAST(value AS VARCHAR) || 'e2' AS DOUBLE) END AS number
FROM events
"""


def export_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.array("p_size", F.col("p_partkey").cast("int")).alias("numbers"),
        F.struct("p_size", "p_brand").alias("pair"), F.encode("p_type", "UTF-8").alias("raw"), "p_retailprice")
    return sources.export_cast(part)


EXPORT_CAST_SQL = """
SELECT p_partkey, '[' || p_size || ',' || p_partkey || ']' AS numbers,
       '{"p_size":' || p_size || ',"p_brand":"' || p_brand || '"}' AS pair,
       lower(hex(encode(p_type))) AS raw, p_retailprice
FROM part
"""


def text_equal_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit("\t")))
        .when(F.col("o_orderkey") % 3 == 1, F.lit("3-medium"))
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", fn.text_equal_ci(F.col("o_orderpriority"), other).alias("is_equal"))


TEXT_EQUAL_SQL = """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN TRUE
       WHEN 1 THEN upper(trim(o_orderpriority)) = '3-MEDIUM' ELSE FALSE END AS is_equal
FROM orders
"""


def is_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    other = (
        F.when(F.col("event_id") % 4 == 0, value * 1.000001)
        .when(F.col("event_id") % 4 == 1, value * 1.001)
        .when(F.col("event_id") % 4 == 2, float("nan"))
    )
    return table(spark, sf_dir, "events").select(
        "event_id", fn.is_close(value, other).alias("is_near"))


IS_CLOSE_SQL = """
WITH pairs AS (
  SELECT event_id, value AS a, CASE event_id % 4 WHEN 0 THEN value * 1.000001
                                    WHEN 1 THEN value * 1.001 END AS b
  FROM events
)
SELECT event_id, COALESCE(abs(a - b) <= 1e-8 + 1e-5 * abs(b), FALSE) AS is_near FROM pairs
"""


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_discount") < 0.095).alias("part"), F.count(F.lit(1)).alias("total"))


def pass_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = fn.percentage(F.col("part"), F.col("total"))
    return _shares(spark, sf_dir).select(
        "l_suppkey", F.round(value, 6).alias("pct"), fn.percentage_text(value).alias("pct_text"))


def threshold_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = fn.percentage(F.col("part"), F.col("total"))
    return _shares(spark, sf_dir).select("l_suppkey", fn.threshold_status(value).alias("status"))


_SHARE_SQL = """
WITH shares AS (
  SELECT l_suppkey, CAST(COUNT(*) FILTER (WHERE l_discount < 0.095) AS DOUBLE) / COUNT(*) * 100.0 AS v
  FROM lineitem GROUP BY l_suppkey
)
"""


def row_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 8 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return orders.select("o_orderkey", digest_of(orders).alias("digest"))


ROW_DIGEST_SQL = """
WITH t AS (
  SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS a, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) AS c,
         CASE WHEN o_orderkey % 8 <> 0 THEN '1:' || o_orderstatus ELSE '-' END AS b FROM orders
)
SELECT o_orderkey, sha256(length(a) || ':' || a || chr(31) || b || chr(31) || length(c) || ':' || c) AS digest
FROM t
"""

_RULES = {
    "failing_nulls": Rule("amount", NULL_RULE),
    "failing_duplicates": Rule("user_id", UNIQUE_RULE),
    "failing_allowed": Rule("event_type", ALLOWED_RULE, allowed=("click", "view", 3, None)),
    "failing_regex": Rule("event_type", REGEX_RULE, pattern="p|s$|(?P<x>v)"),
    "failing_range": Rule("amount", RANGE_RULE, low=5.0, high=100.0),
}

_RULE_SQL = {
    "failing_nulls": "SELECT * FROM ev WHERE amount IS NULL",
    "failing_duplicates": """
SELECT event_id, user_id, event_type, amount
FROM (SELECT *, COUNT(*) OVER (PARTITION BY user_id) AS n FROM ev) AS counted WHERE n > 1""",
    "failing_allowed": "SELECT * FROM ev WHERE event_type NOT IN ('click', 'view')",
    "failing_regex": "SELECT * FROM ev WHERE NOT regexp_matches(event_type, '^(?:p|s$|v)')",
    "failing_range": "SELECT * FROM ev WHERE amount < 5 OR amount > 100",
}


def _failing(rule: Rule):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return failing_rows(gappy_events(spark, sf_dir), rule)

    return run


QUERIES = {
    "project_mapped": Query(project_mapped, "SELECT o_custkey, o_totalprice, o_orderstatus FROM orders"),
    "stringify": Query(stringify, STRINGIFY_SQL),
    "convert_values": Query(convert_values, CONVERT_SQL),
    "dictionary_join": Query(dictionary_join, DICTIONARY_SQL),
    "cast_keys": Query(cast_keys, CAST_KEYS_SQL),
    "normalize_keys": Query(normalize_keys, NORMALIZE_SQL),
    "fill_key_nulls": Query(fill_key_nulls, FILL_SQL),
    "drop_empty_rows": Query(drop_empty_rows, DROP_EMPTY_SQL),
    "to_numeric_coerce": Query(to_numeric_coerce, NUMERIC_SQL),
    "export_cast": Query(export_cast, EXPORT_CAST_SQL),
    "text_equal_ci": Query(text_equal_ci, TEXT_EQUAL_SQL),
    "is_close": Query(is_close, IS_CLOSE_SQL),
    "pass_pct": Query(
        pass_pct, _SHARE_SQL + "SELECT l_suppkey, round(v, 6) AS pct, printf('%.2f%%', v) AS pct_text FROM shares"),
    "threshold_status": Query(
        threshold_status,
        _SHARE_SQL + "SELECT l_suppkey, CASE WHEN v >= 95 THEN 'pass' ELSE 'fail' END AS status FROM shares"),
    "row_digest": Query(row_digest, ROW_DIGEST_SQL),
    **{name: Query(_failing(rule), EVENT_SQL + _RULE_SQL[name]) for name, rule in _RULES.items()},
}
