"""The first lines of many files, without reading the rest of them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a file in which its first lines are looked for; a longer line counts as far as it goes.
HEAD_BYTES = 1 << 20
_STEP_BYTES = 1 << 14
#: Stores whose files Arrow opens by name. Files elsewhere are read by Spark, as whole lines.
ARROW_SCHEMES = ("file", "hdfs", "s3", "s3a", "gs")

_SCHEMA = "file string, line int, value string"


def head_lines(source: BinaryIO, lines: int, most_bytes: int = HEAD_BYTES) -> list[str]:
    """The first ``lines`` lines of an open file, within its first ``most_bytes`` bytes."""
    held = b""
    while len(held) < most_bytes:
        more = source.read(min(_STEP_BYTES, most_bytes - len(held)))
        held += more
        # a return at the very end may be half a line break
        if not more or len(held[:-1].splitlines()) > lines:
            break
    return [line.decode("utf-8", "replace") for line in held.splitlines()[:lines]]


def file_heads(spark: SparkSession, path: str | list[str], lines: int, most_bytes: int = HEAD_BYTES) -> DataFrame:
    """``file, line, value``: the first ``lines`` lines of each file below ``path``, numbered from 0.

    Files are listed by Spark and opened in its tasks, which read some kilobytes of each; what is read
    does not grow with the files. An empty file has no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path")
    first = files.head(1)
    scheme = first[0].path.split(":", 1)[0] if first else "file"
    if scheme not in ARROW_SCHEMES:
        return _whole_lines(spark, path, lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name in batch.column("path").to_pylist():
                if name.startswith("file:"):
                    store, inside = fs.LocalFileSystem(), "/" + name[len("file:"):].lstrip("/")
                else:
                    store, inside = fs.FileSystem.from_uri(name.replace("s3a://", "s3://", 1))
                with store.open_input_stream(inside, compression="detect", buffer_size=_STEP_BYTES) as source:
                    found = head_lines(source, lines, most_bytes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()),
                     pa.array(found, pa.string())], names=["file", "line", "value"])

    return files.mapInArrow(run, _SCHEMA)


def _whole_lines(spark: SparkSession, path: str | list[str], lines: int) -> DataFrame:
    numbered = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_position")).where(F.col("_start") == 0)
    line = F.row_number().over(Window.partitionBy("file").orderBy("_position")) - 1
    return numbered.withColumn("line", line).where(F.col("line") < lines).select("file", "line", "value")
