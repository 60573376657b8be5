"""Key columns: text form, normal form, placeholders, uniqueness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ascii_fold, fields, is_missing, stringify, strip, text_or_null, typed
from .aggregates import drop_incomplete_keys

# Fixed value: placeholder for a missing key component.
KEY_PLACEHOLDER = "__NA__"


def join_key(text: Column) -> Column:
    """The same text under another expression.

    Only a join between two shuffles can be split when a key is hot. A side that was grouped by
    its key counts as shuffled already and would be joined as it is; grouped by one expression
    and joined on another it is shuffled again.
    """
    return F.concat(text, F.lit(""))


def cast_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys as text, so that keys of different types can meet."""
    return df.withColumns({k: stringify(*typed(df, k)) for k in keys})


def normalize_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trimmed, folded to ASCII and lowered. Absent columns are passed over."""
    present = [k for k in keys if k in df.columns]
    return df.withColumns(
        {k: F.lower(ascii_fold(strip(stringify(*typed(df, k))))) for k in present}
    )


def fill_key_nulls(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumns(
        {k: F.coalesce(text_or_null(*typed(df, k)), F.lit(KEY_PLACEHOLDER))
         for k in keys}
    )


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which every column is missing."""
    filled = F.lit(False)
    for name in df.columns:
        filled = filled | ~is_missing(*typed(df, name))
    return df.where(filled)


def prepare_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return fill_key_nulls(drop_empty_rows(df), keys)


def keys_are_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row, ``is_unique``. False without keys or rows; incomplete keys do not count."""
    if not keys:
        return df.limit(0).agg(F.lit(False).alias("is_unique"))
    sizes = drop_incomplete_keys(df, keys).groupBy(*fields(keys)).agg(F.count(F.lit(1)).alias("_size"))
    return sizes.agg(F.coalesce(F.max("_size") == 1, F.lit(False)).alias("is_unique"))
