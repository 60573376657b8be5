"""Token counts by a shortcut for whole tokens.

The strings of the vocabulary that encode alone as one token are found once, before the job
(``tokens.whole_tokens``); pre-tokens among them count one, only the rest are merged.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_batches
from .tokens import TokenCounter, resident, slices, whole_tokens

_COUNTS = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_tokens": pa.int64()}


def _counter(path: str, whole) -> TokenCounter:
    """The whole tokens follow from the path alone, so a worker that is used again keeps its counter."""
    return resident(("counter", path), lambda: TokenCounter(path, whole.value))


def _count_function(docs: DataFrame, vocabulary: str):
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(vocabulary))

    def count(texts: list[str | None]) -> list[int]:
        counter = _counter(vocabulary, whole)
        return [n for part in slices(texts) for n in counter.count(part)]

    return count


def with_token_counts(docs: DataFrame, vocabulary: str, name: str) -> DataFrame:
    """``docs`` with the number of tokens of ``text`` as a further column ``name``."""
    count = _count_function(docs, vocabulary)
    columns = docs.columns
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(rows: pa.RecordBatch):
        counts = pa.array(count(rows.column("text").to_pylist()), pa.int64())
        yield pa.RecordBatch.from_arrays([*map(rows.column, columns), counts], names=[*columns, name])

    return map_batches(docs, run, f"{schema}, `{name}` long")


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """Number of tokens of every whole text, as the library gives them.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. One row per input row:
    doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens). A null text is
    empty and has no tokens; a null doc_id stays null; repeated rows are counted each. The strings
    of special tokens inside a text count one, the library's default. The only thing sent to the
    executors is the list of whole tokens, bounded by the vocabulary.
    """
    count = _count_function(docs, vocabulary)

    def run(rows: pa.RecordBatch):
        texts = rows.column("text").to_pylist()
        yield batch(_COUNTS, doc_id=rows.column("doc_id"),
                    n_bytes=[len((t or "").encode()) for t in texts], n_tokens=count(texts))

    counted = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                      F.col("text").cast("string").alias("text")),
                          run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
