"""Small helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

DEFAULT_BPE = "word_bpe_49k.json"


def vocabulary_path(name: str) -> str:
    """Where the public vocabulary file ``name`` lies on this machine and its executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def settled(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back.

    Cuts the lineage in files that every executor can read, so that later passes neither repeat
    costly Python work nor depend on executors that are gone.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    """``function`` over each Arrow batch of ``df``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return df.mapInArrow(run, schema)


def batch(schema: dict[str, pa.DataType], **columns) -> pa.RecordBatch:
    arrays = [columns[name] if isinstance(columns[name], pa.Array)
              else pa.array(columns[name], type=kind) for name, kind in schema.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(schema))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if getattr(context, "_paritas_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="paritas-code-")) / "paritas_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._paritas_shipped = True
