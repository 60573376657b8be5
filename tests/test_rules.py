"""The five rules, their failing rows, profiles and reports."""

import json

import pytest
from pyspark.sql import functions as F

from paritas.operators import digest, profiling
from paritas.operators.rules import is_allowed, in_range
from paritas.plans import (
    audit_document,
    audit_report,
    execute_validation,
    profile_table,
    skipped_columns,
    validation_details,
)


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(
        [(11, "p", 0.5, 4, "07", "red"), (12, "q", None, 70, "x7", "blue"), (13, "q", 2.5, 90, "42", "green"),
         (14, "r", None, 140, "seven", "pink"), (15, "r", 9.0, 400, "9", "grey")],
        "ident long, letter string, gap double, amount long, code string, colour string")


RULES = {
    "ident": {"validate_uniqueness": True},
    "letter": {"validate_uniqueness": True},
    "gap": {"validate_nulls": True},
    "amount": {"validate_range": True, "min_value": 0, "max_value": 90},
    "code": {"validate_regex": r"\d+$"},
    "colour": {"validate_list_of_values": ["red", "green", "blue"]},
    "absent": {"validate_nulls": True},
}


def table(df):
    return [(r.column_name, r.rule, r.pass_count, r.fail_count, r.pass_pct)
            for r in df.orderBy("rule_no").collect()]


def test_counts(frame):
    assert table(execute_validation(frame, RULES)) == [
        ("ident", "Unique values", 5, 0, "100.00%"),
        ("letter", "Unique values", 3, 2, "60.00%"),
        ("gap", "Null values", 3, 2, "60.00%"),
        ("amount", "Values out of range", 3, 2, "60.00%"),
        ("code", "Values not matching regex", 3, 2, "60.00%"),
        ("colour", "Values outside allowed list", 3, 2, "60.00%"),
    ]
    assert skipped_columns(frame, RULES) == ["absent"]
    named = execute_validation(frame, RULES, report_headers=True).columns
    assert named == ["rule_no", "Column Name", "Rule", "Pass", "Fail", "Pass %", "status"]


def test_details(frame):
    rows = validation_details(frame, RULES).collect()
    found = {}
    for r in rows:
        found.setdefault((r.column_name, r.rule), []).append(r.ident)
    assert {k: sorted(v) for k, v in found.items()} == {
        ("letter", "Unique values"): [12, 13, 14, 15],
        ("gap", "Null values"): [12, 14],
        ("amount", "Values out of range"): [14, 15],
        ("code", "Values not matching regex"): [12, 14],
        ("colour", "Values outside allowed list"): [14, 15],
    }


def test_empty_table(frame):
    every = {"ident": {"validate_nulls": True, "validate_uniqueness": True, "validate_range": True,
                            "validate_regex": "x", "validate_list_of_values": [1]}}
    got = {r[1]: r[2:] for r in table(execute_validation(frame.limit(0), every))}
    assert got.pop("Unique values") == (0, 0, "100.00%")
    assert set(got.values()) == {(0, 0, "0.00%")}
    assert validation_details(frame.limit(0), every).count() == 0
    assert execute_validation(frame, {}).count() == 0
    assert validation_details(frame, {}).count() == 0


def test_switched_off_rules(frame):
    off = {"ident": {"validate_nulls": False, "validate_uniqueness": False, "validate_range": False,
                          "validate_list_of_values": [], "validate_regex": ""}}
    assert table(execute_validation(frame, off)) == [
        ("ident", "Values outside allowed list", 0, 5, "0.00%"),
        ("ident", "Values not matching regex", 5, 0, "100.00%"),
    ]


@pytest.mark.parametrize("kind, values, members, expected", [
    ("bigint", [1, 2, None], ["1"], [False, False, False]),
    ("bigint", [1, 2, None], [1.0, 2.5, "x"], [True, False, False]),
    ("bigint", [1, 0, None], [True, None], [True, False, False]),
    ("bigint", [9007199254740993, 1, 2], [9007199254740993.0, 10**30], [False, False, False]),
    ("double", [1.0, 2.5, None], [1], [True, False, False]),
    ("double", [float("nan"), 2.5, None], [float("nan"), None], [False, False, False]),
    ("string", ["1", "x", None], [1, "x"], [False, True, False]),
    ("string", ["1", "x", None], ["1", None], [True, False, True]),
    ("boolean", [True, False, None], [1], [True, False, False]),
    ("boolean", [True, False, None], ["True"], [False, False, False]),
])
def test_membership_is_strict_about_kinds(spark, kind, values, members, expected):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i")
    test = is_allowed(F.col("v"), df.schema["v"].dataType, members)
    assert [r[0] for r in df.select(test).collect()] == expected


def test_range_of_texts_and_the_rows_it_lists(spark):
    texts = [" 12 ", "1d", "nan", None, "-inf", "5", "1e3"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rules = {"t": {"validate_range": True, "min_value": 5, "max_value": 100}}
    assert table(execute_validation(df, rules))[0][2:4] == (2, 5)
    assert sorted(r.i for r in validation_details(df, rules).collect()) == [4, 6]
    open_ended = df.where(in_range(F.col("t"), df.schema["t"].dataType, None, None))
    assert sorted(r.i for r in open_ended.collect()) == [0, 4, 5, 6]


def test_missing_values_in_rules(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, 1.0), (4, 1.0)], "i int, v double")
    rules = {"v": {"validate_nulls": True, "validate_uniqueness": True, "validate_regex": "<NA>|1"}}
    assert [r[2:4] for r in table(execute_validation(df, rules))] == [(2, 2), (1, 3), (4, 0)]
    listed = validation_details(df, {"v": {"validate_uniqueness": True}}).collect()
    assert sorted(r.i for r in listed) == [1, 2, 3, 4]


def test_dotted_names(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, None, None), (2, "a", 3.0)], "`i.i` int, `s.s` string, `d.d` double")
    rules = {"i.i": {"validate_uniqueness": True}, "s.s": {"validate_nulls": True, "validate_regex": "a"},
             "d.d": {"validate_range": True, "min_value": 3}}
    assert [r[3] for r in table(execute_validation(df, rules))] == [1, 1, 1, 2]
    assert validation_details(df, rules).count() == 5
    assert profile_table(df, ["i.i"]).where("section = 'types'").count() == 3
    assert digest.dataset_fingerprint(df).first().n_rows == 3
    assert profiling.seeded_sample(df, ["i.i"], 2).count() == 2
    assert profiling.topk_values(df, "i.i", 1).first().value == 2


def test_counts_scan_once_for_all_row_rules(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    rules = {c: {"validate_nulls": True, "validate_regex": "1"} for c in df.columns}
    out = execute_validation(df, rules)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("FileScan") == 1 and "Expand" not in plan


def test_descriptions(spark):
    df = spark.createDataFrame([(1, "b", True), (2, "a", None), (None, "b", True), (3, "a", False)],
                               "n int, s string, f boolean")
    row = profiling.describe_numeric(df).first()
    assert tuple(row) == ("n", 3, 2.0, 1.0, 1.0, 1.5, 2.0, 2.5, 3.0)
    got = {r.column_name: tuple(r)[1:] for r in profiling.describe_categorical(df).collect()}
    assert got == {"s": (4, 2, "a", 2), "f": (3, 2, "True", 2)}
    assert {tuple(r) for r in profiling.null_profile(df).collect()} == {("n", 1), ("s", 0), ("f", 1)}
    assert {tuple(r) for r in profiling.value_counts(df, "n").collect()} == {(1, 1), (2, 1), (3, 1)}
    assert {r[0] for r in profiling.distinct_values(df, "n").collect()} == {1, 2, 3, None}


def test_sample_ignores_partitioning(spark):
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    first = [r.o_orderkey for r in profiling.seeded_sample(orders, ["o_orderkey"], 5).collect()]
    again = profiling.seeded_sample(orders.repartition(13), ["o_orderkey"], 5)
    assert first == [3965, 11716, 6092, 10836, 11385] == [r.o_orderkey for r in again.collect()]
    assert profiling.seeded_sample(orders.limit(3), ["o_orderkey"], 5).count() == 3
    other = profiling.seeded_sample(orders, ["o_orderkey"], 5, seed=7)
    assert first != [r.o_orderkey for r in other.collect()]


def test_fingerprint(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "i int, s string")
    one = digest.dataset_fingerprint(df).first()
    assert one == digest.dataset_fingerprint(df.repartition(3).orderBy(F.desc("i"))).first()
    assert one.checksum != digest.dataset_fingerprint(df.distinct()).first().checksum
    assert digest.dataset_fingerprint(df.limit(0)).first().n_rows == 0


def test_profile_and_report(spark, frame):
    lines = profile_table(frame, ["ident"]).collect()
    got = {(r.section, r.column_name, r.metric): r.value for r in lines}
    assert got["types", "amount", "type"] == "bigint"
    assert got["nulls", "gap", "null_count"] == "2"
    assert got["summary", "amount", "p50"] == "90.000000"
    assert got["summary", "letter", "top"] == "q"
    assert sum(r.section == "preview" for r in lines) == 5

    mapping = {"key_source": ["ident"], "key_target": ["id"],
               "mappings": {"colour": {"destinations": ["d"], "function": "Direct mapping"}}}
    target = frame.where("ident > 11").select(F.col("ident").alias("id"), F.col("colour").alias("d"))
    rules = {"d": {"validate_list_of_values": ["red", "blue"]}}
    report = audit_report(frame, target, mapping, rules, "2024-05-06", order_by=["ident"])
    got = {(r.section, r.item, r.metric): r.value for r in report.collect()}
    assert got["matching", "records", "total_match"] == "4"
    assert got["matching", "records", "missing_target"] == "1"
    assert got["data_audit", "source", "rows"] == "5" and got["data_audit", "target", "columns"] == "2"
    assert got["validation_results", "d: Values outside allowed list", "pass_pct"] == "25.00%"
    assert got["report", "report", "generated_at"] == "2024-05-06"
    document = audit_document(report).first()
    assert len(json.loads(document.document)) == len(got)
    assert document.checksum == audit_document(report.repartition(5)).first().checksum


def test_fingerprint_sees_names_gaps_and_separators(spark):
    def of(rows, schema="a string, b string"):
        return digest.dataset_fingerprint(spark.createDataFrame(rows, schema)).first().checksum

    seen = [of([("x", "y")]), of([("x", "y")], "a string, c string"), of([(None, "y")]), of([("<NA>", "y")]),
            of([("x\x1fy", "z")]), of([("x", "y\x1fz")])]
    assert len(set(seen)) == len(seen)


def test_dates_are_checked_like_timestamps(spark):
    from paritas.operators.rules import in_range, is_allowed

    df = spark.sql("select date'2024-01-02' d, timestamp'2024-01-02' t")
    for name in ("d", "t"):
        col, dtype = F.col(name), df.schema[name].dataType
        row = df.select(is_allowed(col, dtype, ["2024-01-02"]), is_allowed(col, dtype, ["2024-01-03"]),
                        in_range(col, dtype, 0, None), in_range(col, dtype, None, 5)).first()
        assert tuple(row) == (True, False, True, False)
