"""Sources, sinks and set operations. Tables are written as text first and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import NULL_TOKENS, null_tokens_to_null
from ..operators.rules import rule_counts, rule_set
from ..session import scratch_path
from .common import EVENT_RULES, EVENT_SQL, ORDER_SQL, RULE_ROWS_SQL, Query, gappy_events, order_matcher, table


def _write_lines(lines: DataFrame, header: str, path: str) -> None:
    """Raw lines below a header line, without any quoting by the writer."""
    (
        lines.toDF(header).write.option("header", True).option("sep", "\x01")
        .option("quote", "\x02").option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def csv_scan_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    name = F.concat(F.lit('"'), F.col("p_name"), F.lit(', ""x"""'))
    whole = F.concat_ws(",", key.cast("string"), name, "p_brand", F.col("p_size").cast("string"))
    line = (
        F.when(key % 50 == 0, F.concat(whole, F.lit(",extra")))
        .when(key % 50 == 1, F.concat_ws(",", key.cast("string"), name))
        .when(key % 50 == 2, F.concat(whole, F.lit(",,extra")))
        .when(key % 50 == 3, F.concat(whole, F.lit(",")))
        .when(key % 50 == 4, F.lit("  "))
        .otherwise(whole)
    )
    path = scratch_path(spark, "lenient")
    _write_lines(part.select(line), "p_partkey,p_name,p_brand,p_size", path)
    return sources.scan_csv(spark, path)


CSV_SCAN_SQL = """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name || ', "x"' AS p_name,
       CASE WHEN p_partkey % 50 <> 1 THEN p_brand END AS p_brand,
       CASE WHEN p_partkey % 50 <> 1 THEN CAST(p_size AS VARCHAR) END AS p_size
FROM part WHERE p_partkey % 50 NOT IN (0, 2, 3, 4)
"""


_MARK_COUNTS = {",": "c_custkey % 5", ";": "(c_custkey + c_nationkey) % 7", "|": "(3 * c_custkey) % 6", "\t": "c_nationkey % 4"}


def detect_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per nation, whose customers decide how often each candidate stands in a line."""
    marks = [F.repeat(F.lit(mark), F.expr(count).cast("int")) for mark, count in _MARK_COUNTS.items()]
    lines = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.concat("c_name", *marks).alias("value"))
    path = scratch_path(spark, "delimiters")
    lines.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select("c_nationkey", "value").write.partitionBy(
        "c_nationkey").text(path)
    found = sources.detect_delimiters(spark, f"{path}/*")
    nation = F.regexp_extract("file", r"c_nationkey=([0-9]+)/[^/]+$", 1).cast("int")
    return found.select(nation.alias("nation"), "delimiter")


DELIMITER_SQL = f"""
WITH numbered AS (
    SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS line FROM customer
), counts AS (
    SELECT c_nationkey, {", ".join(f"sum({count}) AS n{i}" for i, count in enumerate(_MARK_COUNTS.values()))}
    FROM numbered WHERE line <= 5 GROUP BY c_nationkey
)
SELECT c_nationkey::INTEGER AS nation,
       CASE greatest(n0, n1, n2, n3) WHEN n0 THEN ',' WHEN n1 THEN ';' WHEN n2 THEN '|' ELSE chr(9) END AS delimiter
FROM counts
"""


def chunked_csv_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    path = scratch_path(spark, "chunks")
    sources.export_csv(orders, path)
    return sources.read_csv(spark, path)


def csv_parts_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three loads of orders with their columns in another order, of other types, or left out."""
    orders = table(spark, sf_dir, "orders").withColumn("_part", F.col("o_orderkey") % 3)
    root = scratch_path(spark, "parts")
    part = [orders.where(F.col("_part") == i) for i in range(3)]
    sources.export_csv(part[0].select("o_orderkey", "o_custkey", F.floor("o_totalprice").alias("o_totalprice"), "o_orderstatus"),
                       f"{root}/whole")
    sources.export_csv(part[1].select("o_totalprice", "o_orderstatus", "o_orderkey", F.concat(F.lit("c"), "o_custkey").alias(
        "o_custkey")), f"{root}/texts")
    sources.export_csv(part[2].select("o_custkey", "o_orderkey", "o_totalprice"), f"{root}/fewer")
    return sources.read_parts(spark, f"{root}/*", delimiter=",")


PARTS_SQL = """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN 'c' ELSE '' END || o_custkey::VARCHAR AS o_custkey,
       CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice) ELSE o_totalprice END::DOUBLE AS o_totalprice,
       CASE WHEN o_orderkey % 3 <> 2 THEN o_orderstatus END AS o_orderstatus
FROM orders
"""


def csv_quoted_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with line breaks, quotes and lines that look like records, read by as many tasks as the files have splits."""
    customer = table(spark, sf_dir, "customer")
    lines = F.repeat(F.concat(F.lit('\n"x",'), F.col("c_nationkey").cast("string")), (F.col("c_custkey") % 4).cast("int"))
    path = scratch_path(spark, "breaks")
    sources.export_csv(customer.select("c_custkey", F.concat("c_name", lines).alias("note"), "c_nationkey"), path)
    return sources.scan_csv(spark, path, delimiter=",", multiline="split")


BREAKS_SQL = """
SELECT c_custkey::VARCHAR AS c_custkey, c_name || repeat(chr(10) || '"x",' || c_nationkey::VARCHAR, (c_custkey % 4)::INTEGER) AS note,
       c_nationkey::VARCHAR AS c_nationkey
FROM customer
"""


def source_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two loads: fitting ones and ones of the wrong type."""
    supplier = table(spark, sf_dir, "supplier")
    root = scratch_path(spark, "admission")
    sources.export_csv(supplier, f"{root}/good")
    sources.export_json(supplier, f"{root}/bad")
    files = sources.admit_files(spark, root)
    folder = F.regexp_extract("path", r"/(good|bad)/", 1)
    named = files.where(folder != "")
    return named.select(folder.alias("folder"), "accepted", "reason").distinct()


ADMISSION_SQL = """
SELECT DISTINCT folder, accepted, reason FROM supplier,
  (VALUES ('good', TRUE, NULL), ('bad', FALSE, 'file type is not supported'))
  AS f(folder, accepted, reason)
"""


def normalize_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    odd = customer.toDF(*[f" \ufeff{c} " if i % 2 else f"{c}\t" for i, c in enumerate(customer.columns)])
    return sources.normalize_headers(odd)


def null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    texts = F.array(*[F.lit(token) for token in NULL_TOKENS])
    place = (F.col("c_custkey") % 25).cast("int")
    text = F.coalesce(F.get(texts, place), F.col("c_name"))
    return customer.select("c_custkey", null_tokens_to_null(text).alias("cell"))


NULL_TOKENS_SQL = f"""
SELECT c_custkey, CASE WHEN c_custkey % 25 >= {len(NULL_TOKENS)} THEN c_name END AS cell FROM customer
"""


def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    text = lineitem.select(
        F.col("l_orderkey").cast("string").alias("l_orderkey"),
        F.lpad(F.col("l_linenumber").cast("string"), 3, "0").alias("padded"),
        F.col("l_quantity").cast("string").alias("l_quantity"),
        F.when(F.col("l_linenumber") != 3, F.col("l_discount").cast("string")).alias("l_discount"),
        F.when(F.col("l_linestatus") == "O", "TRUE").otherwise("False").alias("is_open"),
        "l_returnflag",
    )
    return sources.infer_types(text)


INFER_SQL = """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS padded, CAST(l_quantity AS BIGINT) AS l_quantity,
       CASE WHEN l_linenumber <> 3 THEN l_discount END AS l_discount,
       l_linestatus = 'O' AS is_open, l_returnflag
FROM lineitem
"""


def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "unmatched")
    sources.export_csv(order_matcher(spark, sf_dir).unmatched(), path)
    return sources.scan_csv(
        spark, path, delimiter=",",
        columns=["l_orderkey", "l_quantity", "order_id", "quantity", "_merge"])


EXPORT_CSV_SQL = ORDER_SQL + """
SELECT l_orderkey, CAST(l_quantity AS VARCHAR) AS l_quantity, order_id,
       CAST(quantity AS VARCHAR) AS quantity, _merge
FROM merged WHERE _merge <> 'both'
"""


def export_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = gappy_events(spark, sf_dir)
    report = rule_counts(events, rule_set(events, EVENT_RULES))
    path = scratch_path(spark, "report")
    sources.export_json(report, path)
    return spark.read.schema(report.schema).json(path)


def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    parts = [orders.where(F.pmod(F.xxhash64("o_orderkey"), F.lit(3)) == i) for i in range(3)]
    return sources.union_all(parts)


QUERIES = {
    "csv_scan_lenient": Query(csv_scan_lenient, CSV_SCAN_SQL),
    "detect_delimiter": Query(detect_delimiter, DELIMITER_SQL),
    "chunked_csv_union": Query(
        chunked_csv_union, "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"),
    "csv_parts_union": Query(csv_parts_union, PARTS_SQL),
    "csv_quoted_breaks": Query(csv_quoted_breaks, BREAKS_SQL),
    "source_admission": Query(source_admission, ADMISSION_SQL),
    "normalize_headers": Query(normalize_headers, "SELECT * FROM customer"),
    "null_tokens": Query(null_tokens, NULL_TOKENS_SQL),
    "infer_types": Query(infer_types, INFER_SQL),
    "export_csv": Query(export_csv, EXPORT_CSV_SQL),
    "export_report_json": Query(
        export_report_json, EVENT_SQL + RULE_ROWS_SQL + "SELECT * FROM results"),
    "union_all": Query(
        union_all, "SELECT o_orderkey, o_orderstatus FROM orders"),
}
