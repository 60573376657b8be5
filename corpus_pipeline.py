"""A corpus pipeline of the operators in ``paritas.llm``: named stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.llm.common import DEFAULT_BPE, settled, ship, table, vocabulary_path
from paritas.llm.mixing import mix
from paritas.llm.near_copies import near_copies
from paritas.llm.packing import pack_documents
from paritas.llm.queries import Query
from paritas.llm.sentence_spans import remove_repeats
from paritas.llm.token_counts import with_token_counts
from paritas.llm.toxicity import toxicity_scores

#: No source is read more often than this in the mix, and none less than once.
MAX_PASSES = 1.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents but those predicted toxic; rows are told apart by their id and a hash of the text."""
    scores = toxicity_scores(docs, table(spark, sf_dir, "labels"))
    toxic = scores.where("predicted = 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    return docs.join(toxic.distinct(), docs.doc_id.cast("long").eqNullSafe(F.col("_id"))
                     & (F.xxhash64(docs.text) == F.col("_hash")), "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, Jaccard 0.8 or more), that with the
    smallest id and hash of the text, once; those without an id all stay."""
    ship(spark)
    known = docs.where(F.col("doc_id").isNotNull())
    first = near_copies(known).groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash")).distinct()
    known = known.withColumn("_text_hash", F.xxhash64("text"))
    kept = known.join(first, (F.col("doc_id").cast("long") == F.col("_id")) & (F.col("_text_hash") == F.col("_hash")),
                      "left_semi").dropDuplicates(["doc_id", "_text_hash"]).drop("_text_hash")
    return kept.union(docs.where(F.col("doc_id").isNull()))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand in an earlier document; emptied documents go."""
    ship(spark)
    cleaned = remove_repeats(docs)
    return cleaned.where("n_removed = 0 or text <> ''").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mix reads them: each at least once."""
    ship(spark)
    counted = settled(with_token_counts(docs, vocabulary_path("byte_bpe_50k.json"), "_mix_tokens"), "mix-tokens")
    return mix(counted, "_mix_tokens", budget="cover", max_passes=MAX_PASSES).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    ship(spark)
    return pack_documents(docs, vocabulary_path(DEFAULT_BPE))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Tokenizers and trained scores have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERY = Query(run, ORACLE_SQL)
