"""Reducers per key: missing values are left out, and no group has to fit into one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ConfigError
from ..functions import field, fields, fold_nan, typed
from .quantiles import exact_quantiles
from .sketches import read_sketches, value_sketches

NUMERIC_ONLY = {"sum", "mean", "median", "std", "var", "prod"}
REDUCERS = NUMERIC_ONLY | {"first", "last", "min", "max", "count", "nunique"}


def _order(order_by: Sequence[str] | None, reducer: str) -> Column:
    if not order_by:
        raise ConfigError(f"{reducer!r} depends on the row order: name the ordering columns")
    return F.struct(*fields(order_by))


def _reducer(reducer: str, col: Column, order_by, scale: int | None) -> Column:
    if reducer == "first":
        return F.min_by(col, F.when(col.isNotNull(), _order(order_by, reducer)))
    if reducer == "last":
        return F.max_by(col, F.when(col.isNotNull(), _order(order_by, reducer)))
    if reducer == "sum":
        exact = col.cast(T.DecimalType(38, scale)) if scale is not None else col
        return F.coalesce(F.sum(exact), F.lit(0))
    if reducer == "prod":
        return F.coalesce(F.product(col), F.lit(1.0))
    plain = {"mean": F.avg, "min": F.min, "max": F.max, "count": F.count,
             "std": F.stddev_samp, "var": F.var_samp}
    return plain[reducer](col)


def check_reducer(reducer: str, column: str, dtype: T.DataType) -> None:
    if reducer not in REDUCERS:
        raise ConfigError(f"unknown reducer {reducer!r} for column {column!r}")
    if reducer in NUMERIC_ONLY and not isinstance(dtype, (T.NumericType, T.BooleanType)):
        raise ConfigError(f"reducer {reducer!r} needs numbers, but {column!r} is {dtype.simpleString()}")


def drop_incomplete_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with a missing key component belong to no group."""
    complete = [fold_nan(*typed(df, k)).isNotNull() for k in keys]
    return df.where(reduce(lambda a, b: a & b, complete))


def distinct_per_key(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Distinct values per key, counted in two steps so that a hot key is spread by value."""
    v = fold_nan(*typed(df, value))
    pairs = df.select(*fields(keys), v.alias("_value")).groupBy(*fields(keys), "_value").agg(F.lit(1).alias("_one"))
    return pairs.groupBy(*fields(keys)).agg(F.count("_value").alias(name))


def aggregate(
    df: DataFrame,
    keys: Sequence[str],
    reducers: Sequence[tuple[str, str, str]],
    order_by: Sequence[str] | None = None,
    scale: int | None = None,
    approx: bool = False,
) -> DataFrame:
    """One row per complete key for ``(column, reducer, output name)`` triples.

    All reducers that combine on the map side share one aggregate. Medians and distinct counts
    are computed apart and joined on the key, because their state grows with the group. With ``approx`` these two
    are read from sketches instead: a value of the column whose rank is off by about ``RANK_ERROR`` of the
    group at most, and a count that is off by some ``DISTINCT_ERROR``.
    """
    keys, names = list(keys), fields(keys)
    rows = drop_incomplete_keys(df, keys)
    together, apart = [], []
    for column, reducer, name in reducers:
        dtype = df.schema[column].dataType
        check_reducer(reducer, column, dtype)
        if approx and reducer in ("median", "nunique"):
            kind, read = ("numbers", "p50") if reducer == "median" else ("distinct", "distinct")
            found = read_sketches(value_sketches(rows, keys, **{kind: [column]}), keys)
            apart.append((name, found.select(*names, field(f"{column}_{read}").alias(name))))
        elif reducer == "median":
            apart.append((name, exact_quantiles(rows, keys, column, {name: 0.5})))
        elif reducer == "nunique":
            apart.append((name, distinct_per_key(rows, keys, column, name)))
        else:
            col = fold_nan(field(column), dtype)
            if isinstance(dtype, T.BooleanType) and reducer in NUMERIC_ONLY:
                col = col.cast("int")
            together.append(_reducer(reducer, col, order_by, scale).alias(name))
    out = rows.groupBy(*names).agg(*together) if together else rows.select(*names).distinct()
    for _, side in apart:
        out = out.join(side, keys, "left")
    return out.select(*names, *fields(name for _, _, name in reducers))
