"""Questions about the files of a load, answered for a whole directory at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .heads import file_heads

# Candidate delimiters in order of preference, and the load limits.
DELIMITERS = (",", ";", "|", "\t")
SNIFFED_LINES = 5
MAX_FILE_BYTES = 500 * 1024 * 1024
ACCEPTED_SUFFIXES = (".csv",)


def _delimiter_votes(lines: DataFrame, by: list[str]) -> DataFrame:
    """Most frequent delimiter per group; ties go to the earlier candidate."""
    counts = lines.groupBy(*by).agg(
        *[
            F.sum(F.length("value") - F.length(F.replace("value", F.lit(mark), F.lit(""))))
            .alias(f"_n{place}")
            for place, mark in enumerate(DELIMITERS)
        ]
    )
    most = F.greatest(*[F.col(f"_n{place}") for place in range(len(DELIMITERS))])
    winner = F.lit(DELIMITERS[0])
    for place in reversed(range(len(DELIMITERS))):
        winner = F.when(F.col(f"_n{place}") == most, F.lit(DELIMITERS[place])).otherwise(winner)
    return counts.select(*by, F.when(most > 0, winner).otherwise(DELIMITERS[0]).alias("delimiter"))


def detect_delimiters(spark: SparkSession, path: str) -> DataFrame:
    """``file, delimiter`` for every text file below ``path``, from its first five lines.

    Some kilobytes of each file are read, however large it is. Files without a byte are left out.
    """
    return _delimiter_votes(file_heads(spark, path, SNIFFED_LINES), ["file"])


def delimiter_of(spark: SparkSession, path: str) -> str:
    """Delimiter of a load whose files all have one format: reads five lines and stops."""
    head = spark.read.text(path).limit(SNIFFED_LINES)
    return _delimiter_votes(head, []).first()["delimiter"]


def admit_files(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """``path, length, accepted, reason`` per file. File contents are never read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select("path", "length")
    )
    suffix = F.regexp_extract("path", r"[^/](\.[^./]+)$", 1)
    reason = F.when(F.col("length") > max_bytes, F.lit("file is larger than the limit")).when(
        ~suffix.isin(*ACCEPTED_SUFFIXES), F.lit("file type is not supported")
    )
    return files.select("path", "length", reason.isNull().alias("accepted"), reason.alias("reason"))
