"""Columns by their literal name: loaded headers may contain dots, which Spark would split."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def field(name: str) -> Column:
    return F.col(quoted(name))


def fields(names: Iterable[str]) -> list[Column]:
    return [field(name) for name in names]


def typed(df: DataFrame, name: str) -> tuple[Column, T.DataType]:
    """A column with its type, as the scalar functions take it."""
    return field(name), df.schema[name].dataType
