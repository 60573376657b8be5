"""Scalar functions on the edge values."""

import unicodedata

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paritas import functions as fn
from paritas.operators.keys import normalize_keys


def values(df, col):
    return [r[0] for r in df.select(col.alias("x")).collect()]


def texts(spark, items):
    return spark.createDataFrame([(i, t) for i, t in enumerate(items)], "i int, t string").orderBy("i")


def test_numbers_from_text(spark):
    cases = {
        " 12 ": 12.0, "1e3": 1000.0, "1d": None, "1f": None, "0x1A": None, "inf": float("inf"),
        "-Infinity": float("-inf"), "nan": None, "NaN": None, "1_000": None, "": None, "  ": None,
        "5.": 5.0, ".5": 0.5, "1e": None, "1,000": None, "1e400": None, "1 2": None,
        "\t7\n": 7.0, "１２": None, "+3.5": 3.5, "True": None,
    }
    assert values(texts(spark, cases), fn.text_to_double(F.col("t"))) == list(cases.values())


def test_to_numeric_of_other_types(spark):
    df = spark.sql("SELECT true AS b, double('nan') AS d, 3 AS i, timestamp'1970-01-01 00:00:01' AS t, "
                   "date'1970-01-01' AS x")
    row = df.select(*[fn.to_numeric(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns]).first()
    assert tuple(row) == (1.0, None, 3.0, 1e9, 0.0)


def test_canonical_text(spark):
    df = spark.sql("""SELECT true AS b, 1.0D AS d, 12345678.5D AS big, 1e20D AS huge, 1.5e-5D AS tiny,
        0.00012345D AS small, double('nan') AS nan, double('-inf') AS inf, 7L AS l,
        timestamp'2023-01-01 00:00:00' AS ts, timestamp'2023-01-01 00:00:00.25' AS tf,
        CAST(NULL AS STRING) AS s, CAST(1.50 AS DECIMAL(9,2)) AS m""")
    row = df.select(*[fn.stringify(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns]).first()
    assert tuple(row) == (
        "True", "1.0", "12345678.5", "1e+20", "1.5e-05", "0.00012345", "<NA>", "-inf", "7",
        "2023-01-01 00:00:00", "2023-01-01 00:00:00.25", "<NA>", "1.50")


def test_float_text_reads_like_python(spark):
    numbers = [1e7, 9999999.0, 1e15, 1e16, 123456789.123456, 1e-4, 9.99e-4, 1e-5, -2.5e20, 1e100, 0.1, -0.0]
    df = spark.createDataFrame([(v, repr(v)) for v in numbers], "v double, e string")
    wrong = df.where(fn.text_or_null(F.col("v"), T.DoubleType()) != F.col("e"))
    assert wrong.count() == 0


def test_ascii_fold_equals_the_standard_decomposition(spark):
    chars = [chr(c) for c in (*range(0x80, 0xD800), *range(0xE000, 0x20000))]
    expected = ["".join(x for x in unicodedata.normalize("NFKD", c) if x < "\x80") for c in chars]
    df = spark.createDataFrame(list(zip(chars, expected)), "c string, e string")
    assert df.where(fn.ascii_fold(F.col("c")) != F.col("e")).count() == 0


def test_normalized_keys(spark):
    df = spark.createDataFrame([(" São Paulo ",), ("Ⅷ ﬁ",), ("ß",), (None,), (" X ",)], "k string")
    assert [r.k for r in normalize_keys(df, ["k", "absent"]).collect()] == ["sao paulo", "viii fi", "", "<na>", "x"]


def test_pass_percentage_rounds_ties_to_even(spark):
    df = spark.createDataFrame([(97, 800), (1, 8), (0, 0), (125, 1), (1, 3)], "p long, n long")
    pct = fn.percentage(F.col("p"), F.col("n"))
    assert values(df, fn.percentage_text(pct)) == ["12.12%", "12.50%", "0.00%", "12500.00%", "33.33%"]
    assert values(df, fn.threshold_status(pct)) == ["fail", "fail", "fail", "pass", "fail"]


def test_is_close(spark):
    df = spark.createDataFrame(
        [(1.0, 1.000009), (1.0, 1.0001), (0.0, 1e-9), (float("nan"), float("nan")), (None, 1.0),
         (float("inf"), float("inf")), (float("inf"), 1.0)], "a double, b double")
    assert values(df, fn.is_close(F.col("a"), F.col("b"))) == [True, False, True, False, False, True, False]


def test_text_equality(spark):
    df = spark.createDataFrame([(" sp ", "SP"), ("a", "b"), (None, "a"), ("\tx", "X\n")], "a string, b string")
    assert values(df, fn.text_equal_ci(F.col("a"), F.col("b"))) == [True, False, False, True]


@pytest.mark.parametrize("pattern, text, expected", [
    ("a|b$", "ax", True), ("a|b$", "xb", False), ("a|b$", "b", True),
    (r"\d+$", "12\n", True), (r"\d+\Z", "12\n", False), (r"\d+$", "12\r", False),
    (r"\w+$", "été", True), (r"\d", "٣", True), (r"(?a)\d", "٣", False), (r"(?i)É", "é", True),
    (r"(?P<x>a)(?P=x)", "aa", True), (r"[[]x", "[x", True), (r"[a&&b]+$", "a&b", True),
    (r"[]a]+$", "]a", True), (r"a{,2}b", "aab", True), (r"x{", "x{", True), ("b", "ab", False),
    ("(?m)^b", "a\nb", False), ("", "", True), (r"a.c", "a c", True),
])
def test_patterns_match_as_in_python(spark, pattern, text, expected):
    import re

    assert bool(re.match(pattern, text)) is expected
    df = spark.createDataFrame([(text,)], "t string")
    assert values(df, F.col("t").rlike(fn.match_at_start(pattern))) == [expected]


@pytest.mark.parametrize("pattern", ["(", "(a)?(?(1)b|c)", r"\N{BULLET}", "(?x)a b", "(?a:b)"])
def test_patterns_that_are_refused(pattern):
    with pytest.raises(ValueError):
        fn.java_pattern(pattern)
