"""Value conversion and the declarative mapping of a source table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import AGGREGATION, CONVERSION, ConfigError, TableMapping
from ..functions import NULL_TEXT, field, fields, stringify, text_or_null, typed
from .aggregates import aggregate
from .keys import join_key

# A literal map is scanned entry by entry, so beyond this size a join is the better lookup.
LITERAL_MAP_LIMIT = 100


def convert_values(col: Column, dtype: T.DataType, dictionary: Mapping[str, str]) -> Column:
    """Text looked up in the dictionary; what it lacks keeps its own text, missing stays NULL."""
    own = text_or_null(col, dtype)
    if not dictionary:
        return own
    table = F.create_map(*[F.lit(part) for pair in dictionary.items() for part in pair])
    return F.coalesce(F.try_element_at(table, stringify(col, dtype)), own)


def convert_by_join(
    df: DataFrame, column: str, dictionary: DataFrame, key: str = "value", to: str = "converted"
) -> DataFrame:
    """The same lookup against a dictionary held as a table.

    Of several targets of one key the smallest text counts, so that a lookup never adds rows; a key
    without a target is as good as absent.
    Whether the dictionary is broadcast is left to its size. Otherwise the rows are shuffled by
    value, where a frequent value is split by the skew handling of the left side.
    """
    dtype = df.schema[column].dataType
    own = text_or_null(field(column), dtype)
    targets = dictionary.where(field(to).isNotNull()).groupBy(field(key).alias("_key")).agg(
        F.min(field(to).cast("string")).alias("_converted"))
    table = targets.select(join_key(F.col("_key")).alias("_lookup"), "_converted")
    looked_up = df.withColumn("_text", join_key(stringify(field(column), dtype))).join(
        table, F.col("_text") == F.col("_lookup"), "left"
    )
    converted = looked_up.withColumn(column, F.coalesce(F.col("_converted"), own))
    return converted.select(*fields(df.columns))


def _dictionary_table(df: DataFrame, dictionary: Mapping[str, str]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(dictionary.items()), "value string, converted string")


def convert_column(df: DataFrame, column: str, dictionary: Mapping[str, str]) -> DataFrame:
    if len(dictionary) > LITERAL_MAP_LIMIT:
        return convert_by_join(df, column, _dictionary_table(df, dictionary))
    return df.withColumn(column, convert_values(*typed(df, column), dictionary))


def project_mapped(df: DataFrame, mapping: Mapping | TableMapping) -> DataFrame:
    """Key columns and the columns that contribute to the mapping."""
    plan = TableMapping.of(mapping)
    return df.select(*fields([*plan.source_keys, *[entry.column for entry in plan.contributing]]))


def apply_rules(
    df: DataFrame,
    mapping: Mapping | TableMapping,
    order_by: Sequence[str] | None = None,
    scale: int | None = None,
) -> DataFrame:
    """Convert, then reduce the source to one row per complete key.

    ``order_by`` decides which value is the first of a key and must be unique within it. A mapping
    to which no entry contributes leaves the rows as they are. With ``scale`` sums are decimals,
    which do not depend on the order of addition.
    """
    plan = TableMapping.of(mapping)
    entries = plan.contributing
    if not entries:
        return df
    if not plan.source_keys:
        raise ConfigError("the source needs key columns")
    keys = list(plan.source_keys)
    for entry in entries:
        if entry.column in keys:
            raise ConfigError(f"key column {entry.column!r} cannot be mapped as a value as well")
    needed = list(dict.fromkeys([*keys, *[e.column for e in entries]]))
    ordering = {f"_order{i}": field(name) for i, name in enumerate(order_by or [])}
    rows = df.select(*fields(needed), *[col.alias(name) for name, col in ordering.items()])
    reducers = []
    for entry in entries:
        if entry.function == CONVERSION:
            rows = convert_column(rows, entry.column, entry.dictionary)
        reducer = entry.reducer if entry.function == AGGREGATION else "first"
        reducers.append((entry.column, reducer, entry.column))
    return aggregate(rows, keys, reducers, list(ordering) or None, scale)


def distinct_value_targets(df: DataFrame, column: str, dictionary: Mapping[str, str]) -> DataFrame:
    """``source_value, target_value, row_count`` per distinct value.

    A missing value is listed once with count 0, and a value without a target gets an empty text.
    """
    dtype = df.schema[column].dataType
    counted = (
        df.select(text_or_null(field(column), dtype).alias("_text"))
        .groupBy("_text").agg(F.count("_text").alias("row_count"))
    )
    text = F.coalesce(F.col("_text"), F.lit(NULL_TEXT))
    if not dictionary:
        target = F.lit("")
    elif len(dictionary) <= LITERAL_MAP_LIMIT:
        table = F.create_map(*[F.lit(part) for pair in dictionary.items() for part in pair])
        target = F.coalesce(F.try_element_at(table, text), F.lit(""))
    else:
        counted = counted.join(_dictionary_table(df, dictionary), text == F.col("value"), "left")
        target = F.coalesce(F.col("converted"), F.lit(""))
    return counted.select(text.alias("source_value"), target.alias("target_value"), "row_count")
