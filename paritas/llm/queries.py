"""One query per corpus operator over the whole test tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from .common import DEFAULT_BPE, settled, table, vocabulary_path
from .fertility import fertility_verdicts
from .hard_negatives import hard_negatives
from .hilbert_search import nearest
from .html_density import extract_main_text
from .jaccard_join import jaccard_components
from .mixing import mix
from .orc_ids import encode_to_orc
from .packing import pack_documents
from .sentence_spans import remove_repeats
from .simhash_trie import near_duplicates
from .token_counts import count_tokens, with_token_counts
from .toxicity import toxicity_scores
from .whitening import whitened


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def op1_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op2_token_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility_verdicts(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


def op3_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path(DEFAULT_BPE))


def op4_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_to_orc(table(spark, sf_dir, "documents"), vocabulary_path(DEFAULT_BPE))


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op8_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    counted = with_token_counts(docs, vocabulary_path("byte_bpe_50k.json"), "n_tokens").drop("text")
    return mix(settled(counted, "mix-tokens"), "n_tokens", max_passes=2.0, target_entropy=0.97)


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=4, least=(85, 100))


JACCARD_SQL = """
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
), grams AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS gram
    FROM words, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (
    SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared
    FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT u, v FROM common JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v
    WHERE 100 * shared >= 85 * (a.n + b.n - shared)
), near AS (
    SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION SELECT reach.doc_id, near.v FROM reach JOIN near ON near.u = reach.other
)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.other) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


HARD_NEGATIVES_SQL = """
WITH vectors AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_inner_product(a.x, b.x)::BIGINT AS score
    FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT alike
WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

QUERIES = {
    "op1_html_density": Query(op1_html_density),
    "op2_token_fertility": Query(op2_token_fertility),
    "op3_bm25_packing": Query(op3_bm25_packing),
    "op4_orc_token_ids": Query(op4_orc_token_ids),
    "op5_sentence_spans": Query(op5_sentence_spans),
    "op6_toxic_segments": Query(op6_toxic_segments),
    "op7_token_counts": Query(op7_token_counts),
    "op8_hilbert_search": Query(op8_hilbert_search),
    "op9_simhash_trie": Query(op9_simhash_trie),
    "op10_temperature_mixing": Query(op10_temperature_mixing),
    "op11_jaccard_join": Query(op11_jaccard_join, JACCARD_SQL),
    "op12_embedding_whitening": Query(op12_embedding_whitening),
    "op13_hard_negatives": Query(op13_hard_negatives, HARD_NEGATIVES_SQL),
}
