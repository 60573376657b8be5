"""Counts, summaries and frequencies of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import field, fields, fold_nan, is_missing, stringify, text_or_null, to_numeric, typed
from .quantiles import exact_quantiles

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def _melt(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    pairs = [F.struct(F.lit(n).alias("column_name"), c.alias("value")) for n, c in columns.items()]
    return df.select(F.inline(F.array(*pairs)))


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, sample standard deviation, minimum, quartiles and maximum per column.

    The moments of all columns are one aggregate of the rows as they are. For the quartiles, which
    are exact and bounded per task, the columns are stacked into one keyed column.
    """
    names = list(columns or numeric_columns(df))
    stacked = _melt(df, {n: to_numeric(*typed(df, n)) for n in names})
    numbers = df.select(*[to_numeric(*typed(df, n)).alias(f"v{i}") for i, n in enumerate(names)])
    if not names:
        numbers = numbers.select(F.lit(None).cast("double").alias("v0"))
    wide = numbers.agg(*[
        F.struct(F.lit(n).alias("column_name"), F.count(f"v{i}").alias("count"), F.avg(f"v{i}").alias("mean"),
                 F.stddev_samp(f"v{i}").alias("std"), F.min(f"v{i}").alias("min"), F.max(f"v{i}").alias("max"))
        .alias(f"m{i}") for i, n in enumerate(names or [""])])
    moments = wide.select(F.inline(F.array(*[F.col(f"m{i}") for i in range(len(names) or 1)]))).where(
        F.lit(bool(names)))
    quartiles = exact_quantiles(stacked, ["column_name"], "value", QUARTILES)
    return moments.join(quartiles, ["column_name"], "left").select(
        "column_name", "count", "mean", "std", "min", *QUARTILES, "max"
    )


def describe_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, distinct values, most frequent value and its frequency per column.

    Of several most frequent values the smallest is reported.
    """
    names = list(columns or text_columns(df))
    stacked = _melt(df, {n: text_or_null(*typed(df, n)) for n in names})
    sizes = stacked.groupBy("column_name", "value").agg(F.count("value").alias("_size"))
    known = F.when(F.col("value").isNotNull(), F.struct((-F.col("_size")).alias("size"), "value"))
    return sizes.groupBy("column_name").agg(
        F.sum("_size").alias("count"),
        F.count("value").alias("unique"),
        F.min(known).alias("_best"),
    ).select(
        "column_name", "count", "unique",
        F.col("_best.value").alias("top"), (-F.col("_best.size")).alias("freq"),
    )


def null_profile(df: DataFrame) -> DataFrame:
    """``column_name, null_count`` from one aggregate over all columns."""
    counts = df.agg(
        *[F.count_if(is_missing(*typed(df, c))).alias(c) for c in df.columns]
    )
    return _melt(counts, {c: field(c) for c in df.columns}).withColumnRenamed(
        "value", "null_count"
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    value = fold_nan(*typed(df, column))
    known = df.select(value.alias("value")).where(F.col("value").isNotNull())
    return known.groupBy("value").agg(F.count(F.lit(1)).alias("row_count"))


def topk_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Most frequent values; ties go to the smaller value."""
    return value_counts(df, column).orderBy(F.desc("row_count"), "value").limit(k)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column, the missing one included."""
    value = fold_nan(*typed(df, column))
    return df.select(value.alias("value")).distinct()


def preview(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """First rows in a stated order."""
    return df.orderBy(*fields(order_by)).limit(n)


def seeded_sample(df: DataFrame, key: Sequence[str], n: int = 1000, seed: int = 42) -> DataFrame:
    """The same ``n`` rows for the same seed, however the table is partitioned.

    Rows are ranked by a digest of seed and row key. Each task keeps its own best ``n``.
    """
    parts = [stringify(*typed(df, k)) for k in key]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    return df.orderBy(digest, *fields(key)).limit(n)
