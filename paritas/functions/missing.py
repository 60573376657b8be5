"""Missing values: NaN and NULL are one thing, and text stand-ins for them become NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: how a missing value reads once it has been turned into text.
NULL_TEXT = "<NA>"

# The texts a CSV cell may hold to mean "missing".
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def fold_nan(col: Column, dtype: T.DataType) -> Column:
    """NaN to NULL, so that joins, counts and comparisons see a single missing value."""
    return F.when(~F.isnan(col), col) if is_float(dtype) else col


def is_missing(col: Column, dtype: T.DataType) -> Column:
    return (col.isNull() | F.isnan(col)) if is_float(dtype) else col.isNull()


def null_tokens_to_null(col: Column) -> Column:
    return F.when(~col.isin(*NULL_TOKENS), col)
