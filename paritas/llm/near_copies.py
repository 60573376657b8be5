"""Groups of near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash fingerprints of the shingles, linked by the binary trie join, name candidates. Fingerprints of 64 bits miss
most pairs near the limit, so bands of min-hashes name further ones; a pair of similarity 0.8 shares none with probability
1.2e-7. Every link is counted from the texts by the similarity join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled
from .jaccard_join import similar_groups
from .simhash_trie import divided, links, roots

SHINGLE_WORDS = 5
#: The least similarity as a fraction of whole numbers, so that it is compared exactly.
LEAST = (4, 5)


def simhash_candidates(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of ``nodes`` (node, fingerprint): each node with one of its fingerprint, and fingerprints that the trie links."""
    ends = settled(nodes.groupBy("fingerprint").agg(F.min("node").alias("end")), "fingerprint-ends")
    alike = nodes.select("node", "fingerprint").join(ends, "fingerprint").where("node <> end").select(
        F.col("node").alias("u"), F.col("end").alias("v"))
    linked = settled(links(divided(roots(ends.select("fingerprint")))), "fingerprint-links")
    named = [ends.select(F.col("fingerprint").alias(side), F.col("end").alias(f"end_{side}")) for side in ("u", "v")]
    close = linked.join(named[0], "u").join(named[1], "v").select(F.col("end_u").alias("u"), F.col("end_v").alias("v"))
    return alike.union(close)


def near_copies(docs: DataFrame) -> DataFrame:
    """The group of every row of ``docs`` (doc_id, text): doc_id, text_hash (xxhash64), component.

    Groups are what links of a similarity of at least ``LEAST`` connect. Texts with the same set of
    shingles are one node; null, empty and blank texts are alike. Repeated rows and rows without an id are in the
    group of their text.
    """
    found = similar_groups(docs, SHINGLE_WORDS, LEAST, bands=True, more_pairs=simhash_candidates)
    return found.select("doc_id", "text_hash", F.coalesce("component", F.lit(0).cast("long")).alias("component"))
