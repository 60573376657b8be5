"""Canonical text of any value, and the text helpers built on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .missing import NULL_TEXT, fold_nan, is_float

WHITE_SPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


def _float_text(col: Column) -> Column:
    """Java prints 1.0E7 and 1.0E-5 where plain text wants 10000000.0 and 1e-05."""
    raw = col.cast("string")
    size = F.abs(col)
    plain = F.regexp_replace(col.cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
    short = F.regexp_replace(raw, r"\.0E", "E")
    signed = F.regexp_replace(short, r"E(\d)", r"e+$1")
    exponent = F.regexp_replace(F.regexp_replace(signed, "E-", "e-"), r"e([+-])(\d)$", r"e$10$2")
    return (
        F.when(size == float("inf"), F.when(col > 0, "inf").otherwise("-inf"))
        .when(~raw.contains("E"), raw)
        .when((size >= 1e7) & (size < 1e16), plain)
        .when((size >= 1e-4) & (size < 1e-3), F.regexp_replace(
            col.cast("decimal(38,30)").cast("string"), r"(\.\d+?)0+$", "$1"))
        .otherwise(exponent)
    )


def text_or_null(col: Column, dtype: T.DataType) -> Column:
    """Text of a value; missing stays NULL."""
    if isinstance(dtype, T.StringType):
        return col
    if isinstance(dtype, T.BooleanType):
        return F.when(col, "True").when(~col, "False")
    if is_float(dtype):
        return _float_text(fold_nan(col, dtype))
    if isinstance(dtype, T.BinaryType):
        return F.lower(F.hex(col))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(col)
    return col.cast("string")


def stringify(col: Column, dtype: T.DataType, null_text: str = NULL_TEXT) -> Column:
    """Text of a value; missing becomes ``null_text``."""
    return F.coalesce(text_or_null(col, dtype), F.lit(null_text))


def text_equal_ci(left: Column, right: Column) -> Column:
    """Equality of two texts after trimming, regardless of case; missing is never equal."""
    return F.coalesce(F.upper(strip(left)) == F.upper(strip(right)), F.lit(False))


def strip(col: Column) -> Column:
    """Remove every kind of white space at both ends, not only the blank."""
    return F.btrim(col, F.lit(WHITE_SPACE))
