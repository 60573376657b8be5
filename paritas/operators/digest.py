"""Digests of rows and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_missing, stringify, typed

# The 64 hexadecimal digits of a digest are added up in lanes. A lane of 16 digits stays below 2 * 10^19,
# so that a sum of 10^18 rows fits into 38 decimal digits. Its halves of 32 bits are added up as longs within
# each partition, which holds for 2^31 rows of one.
_LANES, _LANE_DIGITS, _HALF_DIGITS = 4, 16, 8


def row_digest(df: DataFrame, columns: Sequence[str] | None = None, separator: str = "\x1f") -> Column:
    """SHA-256 of the canonical texts of a row.

    A missing value is told apart from the text that stands for it elsewhere, and each text is
    preceded by its length, so that a separator inside a value cannot imitate two values.
    """
    texts = []
    for name in columns or df.columns:
        text = stringify(*typed(df, name))
        texts.append(F.when(is_missing(*typed(df, name)), "-").otherwise(
            F.concat(F.length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat_ws(separator, *texts), 256)


def dataset_fingerprint(
    df: DataFrame, columns: Sequence[str] | None = None, separator: str = "\x1f"
) -> DataFrame:
    """``n_rows, n_columns, digest_sum, checksum``: equal for the same rows in any order.

    The row digests are added up in lanes, all of their bits, so partitions combine freely and
    repeated rows still count. ``digest_sum`` lists the sums of the lanes. The checksum also covers the
    names of the columns.
    """
    names = list(columns or df.columns)
    digests = df.select(row_digest(df, names, separator).alias("_digest"))
    halves = [F.conv(F.substring("_digest", 1 + _HALF_DIGITS * i, _HALF_DIGITS), 16, 10).cast("bigint")
              for i in range(_LANES * _LANE_DIGITS // _HALF_DIGITS)]
    parts = digests.groupBy(F.spark_partition_id().alias("_part")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(half).alias(f"_half{i}") for i, half in enumerate(halves)])
    whole = [F.coalesce(F.sum(F.col(f"_half{i}").cast("decimal(28,0)")), F.lit(0)).cast("decimal(38,0)") for i in range(len(halves))]
    sums = [(high * F.lit(1 << 32) + low).cast("decimal(38,0)").cast("string") for high, low in zip(whole[::2], whole[1::2])]
    totals = parts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.concat_ws(",", *sums).alias("digest_sum"))
    header = [F.lit(f"{len(name)}:{name}") for name in names]
    seed = F.concat_ws(separator, F.col("n_rows").cast("string"), F.lit(str(len(names))), *header, F.col("digest_sum"))
    return totals.select(
        "n_rows", F.lit(len(names)).alias("n_columns"), "digest_sum", F.sha2(seed, 256).alias("checksum")
    )
