"""Approximate distinct counts and quantiles as columns that can be stored and merged.

A sketch is a small binary value: partitions of a table can be summed up once, kept, and merged later for any
coarser grouping without reading their rows again. All aggregates combine on the map side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import field, fields, fold_nan, to_numeric, typed

#: Size of a distinct sketch as a power of two, and its relative standard error, 1.04 / sqrt(2^13).
DISTINCT_BITS, DISTINCT_ERROR = 13, 0.0115
#: Size of a quantile sketch, and the error of its ranks as a share of all values that 99 of 100 sketches keep.
QUANTILE_SIZE, RANK_ERROR = 1600, 0.002


def value_sketches(df: DataFrame, keys: Sequence[str], distinct: Sequence[str] = (), numbers: Sequence[str] = ()) -> DataFrame:
    """One row per key with ``<column>_distinct`` and ``<column>_values`` sketches of the known values of the columns.

    One scan and one shuffle for all columns. A column without known values has sketches of nothing. Without ``keys`` there
    is one row for the table.
    """
    parts = []
    for name in distinct:
        parts.append(F.hll_sketch_agg(fold_nan(*typed(df, name)).cast("string"), DISTINCT_BITS).alias(f"{name}_distinct"))
    for name in numbers:
        parts.append(F.kll_sketch_agg_double(to_numeric(*typed(df, name)), QUANTILE_SIZE).alias(f"{name}_values"))
    return df.groupBy(*fields(keys)).agg(F.count(F.lit(1)).alias("n_rows"), *parts)


def merged_sketches(stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``value_sketches`` of a coarser grouping from those of a finer one."""
    parts = [F.sum("n_rows").alias("n_rows")]
    for name in stored.columns:
        if name.endswith("_distinct"):
            parts.append(F.hll_union_agg(field(name)).alias(name))
        elif name.endswith("_values"):
            parts.append(F.kll_merge_agg_double(field(name)).alias(name))
    return stored.groupBy(*fields(keys)).agg(*parts)


def read_sketches(stored: DataFrame, keys: Sequence[str], quantiles: Mapping[str, float] | None = None) -> DataFrame:
    """The numbers in the sketches: ``<column>_distinct`` as a count and ``<column>_<quantile>`` for each of ``quantiles``,
    NULL without values."""
    out = []
    for name in stored.columns:
        if name.endswith("_distinct"):
            out.append(F.hll_sketch_estimate(field(name)).alias(name))
        elif name.endswith("_values"):
            base, n = name.removesuffix("_values"), F.kll_sketch_get_n_double(field(name))
            out += [F.when(n > 0, F.kll_sketch_get_quantile_double(field(name), F.lit(float(q)))).alias(f"{base}_{label}")
                    for label, q in (quantiles or {"p50": 0.5}).items()]
    return stored.select(*fields(keys), "n_rows", *out)
