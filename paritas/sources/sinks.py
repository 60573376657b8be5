"""Writers. Output stays partitioned; nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import field, text_or_null, typed


def export_cast(df: DataFrame) -> DataFrame:
    """Make every column writable as CSV: nested and binary values become text."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    return df.select(
        *[
            (text_or_null(field(f.name), f.dataType) if isinstance(f.dataType, nested)
             else field(f.name)).alias(f.name)
            for f in df.schema.fields
        ]
    )


def export_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """Header CSV without an index; missing values are empty."""
    text = df.select(
        *[text_or_null(*typed(df, name)).alias(name) for name in df.columns]
    )
    (
        text.write.option("header", True)
        .option("sep", delimiter)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object per row; a report is a single row."""
    df.write.json(path)
