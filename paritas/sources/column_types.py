"""Column types from text, found in one pass over the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import INTEGER_TEXT, field, stringify, text_to_double

# The texts that mean true and false.
TRUE_TEXTS = ("True", "TRUE", "true")
FALSE_TEXTS = ("False", "FALSE", "false")

_SAFE_LONG = 9.2e18  # closer to the limit of a long only its own text can tell


def _as_long(col: Column) -> Column:
    return F.when(col.rlike(INTEGER_TEXT), col.try_cast("bigint"))


def inferred_types(df: DataFrame, empty: str = "bigint") -> dict[str, str]:
    """``bigint``, ``double``, ``boolean`` or ``string`` per text column.

    One aggregate over all columns; a single row reaches the driver. Numbers that are all whole
    become ``bigint`` even when written as ``1.0``. A column without values is of the type ``empty``.
    """
    parsed, checks = [], []
    for place, name in enumerate(df.columns):
        col = field(name)
        # Parsed below the aggregate, so that each text is read once and not once per check.
        parsed += [
            col.alias(f"text{place}"),
            col.isNotNull().alias(f"known{place}"),
            text_to_double(col).alias(f"number{place}"),
            F.coalesce(col.isin(*TRUE_TEXTS, *FALSE_TEXTS), F.lit(False)).alias(f"is_flag{place}"),
        ]
        known, number = F.col(f"known{place}"), F.col(f"number{place}")
        fits = (F.abs(number) < _SAFE_LONG) | _as_long(F.col(f"text{place}")).isNotNull()
        whole = (F.rint(number) == number) & fits
        checks += [
            F.count_if(known).alias(f"known{place}"),
            F.count_if(known & number.isNull()).alias(f"double{place}"),
            F.count_if(known & ~F.coalesce(whole, F.lit(False))).alias(f"whole{place}"),
            F.count_if(known & ~F.col(f"is_flag{place}")).alias(f"boolean{place}"),
        ]
    failures = df.select(*parsed).agg(*checks).first()
    types = {}
    for place, name in enumerate(df.columns):
        if not failures[f"known{place}"]:
            types[name] = empty
        elif not failures[f"whole{place}"]:
            types[name] = "bigint"
        elif not failures[f"double{place}"]:
            types[name] = "double"
        elif not failures[f"boolean{place}"]:
            types[name] = "boolean"
        else:
            types[name] = "string"
    return types


def common_types(parts: Sequence[dict[str, str]]) -> dict[str, str]:
    """The least type that holds a column's types in all parts. ``void`` (no values) is below every type, ``bigint`` below
    ``double``; all other unlike types meet in ``string``. A column without values anywhere is ``bigint``."""
    merged: dict[str, str] = {}
    for types in parts:
        for name, kind in types.items():
            kinds = {merged.get(name, "void"), kind} - {"void"}
            merged[name] = ("void" if not kinds else kinds.pop() if len(kinds) == 1
                            else "double" if kinds == {"bigint", "double"} else "string")
    return {name: "bigint" if kind == "void" else kind for name, kind in merged.items()}


def apply_types(df: DataFrame, types: dict[str, str], wanted: dict[str, str] | None = None) -> DataFrame:
    """``df`` with its text columns read as ``types``, and these then turned into the wider types ``wanted``."""
    out = []
    for name in df.columns:
        col, kind = field(name), types.get(name, "string")
        if kind == "bigint":
            cast = F.coalesce(_as_long(col), text_to_double(col).cast("bigint"))
        elif kind == "double":
            cast = text_to_double(col)
        elif kind == "boolean":
            cast = F.when(col.isin(*TRUE_TEXTS), True).when(col.isin(*FALSE_TEXTS), False)
        else:
            cast = col
        target = (wanted or {}).get(name, kind)
        if kind == "void":
            cast = F.lit(None).cast(target)
        elif target == "string" != kind:
            cast = F.when(cast.isNotNull(), stringify(cast, T.DataType.fromDDL(kind)))
        elif target != kind:
            cast = cast.cast(target)
        out.append(cast.alias(name))
    return df.select(*out)


def infer_types(df: DataFrame) -> DataFrame:
    return apply_types(df, inferred_types(df))
