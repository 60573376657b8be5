"""Numbers: lenient parsing, closeness and percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .missing import fold_nan

# Tolerance of ``is_close`` and the percentage from which a rule counts as good.
RELATIVE_TOLERANCE = 1e-5
ABSOLUTE_TOLERANCE = 1e-8
PASS_THRESHOLD = 95.0

_BLANK = r"[ \t\n\x0B\f\r]*"
INTEGER_TEXT = rf"\A{_BLANK}[+-]?[0-9]+{_BLANK}\z"
NUMBER_TEXT = (
    rf"\A{_BLANK}[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf(?:inity)?)){_BLANK}\z"
)


def text_to_double(col: Column) -> Column:
    """Spark alone would also take ``1d`` or ``nan``; an overflow is a failure, not infinity."""
    parsed = col.try_cast("double")
    named_or_finite = (F.abs(parsed) != float("inf")) | col.rlike("[nN]")
    return F.when(col.rlike(NUMBER_TEXT), F.when(named_or_finite, parsed))


def to_numeric(col: Column, dtype: T.DataType) -> Column:
    """Value as a double; whatever cannot be read as a number is NULL."""
    if isinstance(dtype, T.StringType):
        return text_to_double(col)
    if isinstance(dtype, T.BooleanType):
        return col.cast("int").cast("double")
    if isinstance(dtype, T.NumericType):
        return fold_nan(col.cast("double"), T.DoubleType())
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(col.cast("timestamp")).cast("double") * 1000.0
    return F.lit(None).cast("double")


def is_close(left: Column, right: Column) -> Column:
    """Difference within the tolerance relative to ``right``; missing is never close."""
    a, b = left.cast("double"), right.cast("double")
    near = F.abs(a - b) <= F.lit(ABSOLUTE_TOLERANCE) + F.lit(RELATIVE_TOLERANCE) * F.abs(b)
    either_infinite = (F.abs(a) == float("inf")) | (F.abs(b) == float("inf"))
    same = F.when(either_infinite, a == b).otherwise(near)
    return F.coalesce(same & ~F.isnan(a) & ~F.isnan(b), F.lit(False))


def percentage(part: Column, total: Column) -> Column:
    """``part`` of ``total`` in percent; zero for an empty table."""
    return F.when(total > 0, part / total * 100.0).otherwise(F.lit(0.0))


def fixed_text(value: Column, digits: int) -> Column:
    """Number with a fixed count of decimals, ties to even, no grouping of thousands."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits))


def percentage_text(value: Column) -> Column:
    return F.concat(fixed_text(value, 2), F.lit("%"))


def threshold_status(value: Column, threshold: float = PASS_THRESHOLD) -> Column:
    return F.when(value >= threshold, "pass").otherwise("fail")
