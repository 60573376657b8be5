"""Token ids in ORC files: run-length coded integers, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import batch, map_batches
from .tokens import WordBpe, resident, slices

SCHEMA = "part int, row long, doc_id long, n_tokens long, ids array<int>"
_WRITE = {"part": pa.int32(), "row": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(),
          "ids": pa.list_(pa.int32())}
_READ = {"part": pa.int32(), "row": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(),
         "ids_crc32": pa.int64()}


def encoder(path: str) -> WordBpe:
    return resident(("encoder", path), lambda: WordBpe(path))


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2,
              stripe_bytes: int = 64 << 20, index_rows: int = 1000) -> None:
    """Writes the ids of every whole text to ORC files below ``path`` in ascending doc_id order.

    The files are ranges of doc_id (null first; rows with the same doc_id in the order of a hash of
    their text). Their rows hold the number of the range, the place in it, doc_id, n_tokens and
    the ids with ``end_id`` at the end; a null text has that one id. Integers are run-length coded
    by the format, each stripe has row indexes every ``index_rows`` rows and Bloom filters on
    doc_id, so that readers take stripes in parallel and skip those without a wanted document.
    """
    tie = F.xxhash64(F.col("text"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), tie.asc()]
    ranges = texts.repartitionByRange(*order).sortWithinPartitions(*order)

    def encode(batches):
        from pyspark import TaskContext

        part, row = TaskContext.get().partitionId(), 0
        bpe = encoder(vocabulary)
        end = np.array([end_id], dtype=bpe.dtype).tobytes()
        for rows in batches:
            at = 0
            for texts in slices(rows.column("text").to_pylist()):
                coded = [ids + end for ids in bpe.encode(texts)]
                n = np.array([len(b) // bpe.dtype.itemsize for b in coded], dtype=np.int64)
                values = np.frombuffer(b"".join(coded), dtype=bpe.dtype).astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield batch(
                    _WRITE, part=np.full(len(n), part, dtype=np.int32),
                    row=np.arange(row, row + len(n)),
                    doc_id=rows.column("doc_id").slice(at, len(n)), n_tokens=n,
                    ids=pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)))
                at += len(n)
                row += len(n)

    (ranges.mapInArrow(encode, SCHEMA).write
        .option("compression", "zstd").option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", index_rows).option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01").orc(path))


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of ``write_ids``; with ``doc_ids`` only those documents, where stripes and row
    groups without them are skipped by their statistics and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def id_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers). Empty files give no rows."""

    def digest(rows: pa.RecordBatch):
        lists = rows.column("ids")
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        cuts = lists.offsets.to_numpy().tolist()
        yield batch(
            _READ, **{c: rows.column(c) for c in ("part", "row", "doc_id", "n_tokens")},
            ids_crc32=[zlib.crc32(values[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])])

    stored = read_ids(spark, path)
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("_total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file range
    totals = totals.select("part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    digests = map_batches(stored, digest,
                          "part int, row long, doc_id long, n_tokens long, ids_crc32 long")
    return (
        digests.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .join(totals, "part")
        .select("doc_id", (F.col("_before") + F.col("_inside")).alias("start"), "n_tokens", "ids_crc32")
    )


def encode_to_orc(docs: DataFrame, vocabulary: str, path: str | None = None) -> DataFrame:
    """``write_ids`` followed by ``id_digests`` of the same files."""
    path = path or scratch_path(docs.sparkSession, "orc-ids")
    write_ids(docs, path, vocabulary)
    return id_digests(docs.sparkSession, path)
