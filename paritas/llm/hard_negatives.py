"""Hard negatives of anchors by slot-decomposed selection.

The upper limits of an anchor's positives split the scores into disjoint slots. Every part of the table keeps the
best candidates of each slot, which combine across parts; the answer of a positive is the merge of the slots
from its own downwards, so that windows that overlap are served by one selection.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, settled

#: Anchors and rows that meet in one task, about.
ANCHOR_BLOCK, ROW_BLOCK = 4096, 16_384
LABELS = 10

_CELL = "anchor_id long, slot int, vec_id long, score long"
_FOUND = {"anchor_id": pa.int64(), "slot": pa.int32(), "vec_id": pa.int64(), "score": pa.int64()}


def labelled_vectors(rows: DataFrame, scale: int) -> tuple[DataFrame, int]:
    """vec_id, label, vector (whole numbers) of the rows that take part, each different row once, and the width."""
    vector = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    known = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                        vector.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    widths = known.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).collect()
    if not widths:
        return known, 0
    width = max(widths, key=lambda w: (w.n, w.width)).width
    largest = float(math.isqrt(((1 << 63) - 1) // max(width, 1)) // scale - 1)  # so that a score fits into a long
    known = known.where((F.size("vector") == width) & ~F.exists("vector", lambda x: F.abs(x) > largest))
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(LABELS))).otherwise(F.col("label"))
    whole = F.transform("vector", lambda x: F.floor(x * scale).cast("long"))
    return known.select("vec_id", label.alias("label"), whole.alias("vector")).distinct(), width


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    column = table.column("vector").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:  # doubles hold every partial sum
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k different ids by falling score, then by id."""
    places = np.arange(len(scores))
    if len(scores) > 4 * k:
        places = np.flatnonzero(scores >= np.partition(scores, -2 * k)[-2 * k])
    order = places[np.lexsort((ids[places], -scores[places]))]
    _, first = np.unique(ids[order], return_index=True)
    if len(first) < k and len(places) < len(scores):  # repeated ids took the room
        order = np.lexsort((ids, -scores))
        _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def _cells(vectors: DataFrame, anchors: DataFrame, n_vectors: int, n_anchors: int, select, width: int) -> DataFrame:
    """``select(scores, ids, labels, anchor)`` over each block of anchors with each block of rows.

    The stated queries meet all rows in a grid: rows are dealt once per block of anchors, anchors once per block of rows.
    """
    sides = max(1, -(-n_anchors // ANCHOR_BLOCK)), max(1, -(-n_vectors // ROW_BLOCK))
    rows = (vectors.withColumn("part", F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(sides[1])))
            .withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides[0] - 1)))))
    asked = (anchors.withColumn("side", F.pmod(F.xxhash64("vec_id"), F.lit(sides[0])).cast("int"))
             .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sides[1] - 1).cast("long")))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], t) for c, t in _FOUND.items()})
        scores = inner_products(_matrix(right, width), _matrix(left, width))
        ids, labels = left.column("vec_id").to_numpy(), left.column("label").to_numpy()
        found = [f for anchor, own in zip(right.drop_columns(["vector"]).to_pylist(), scores)
                 for f in select(own, ids, labels, anchor)]
        anchor, slot, vec, score = (np.concatenate(x) if found else [] for x in (zip(*found) if found else [()] * 4))
        return pa.Table.from_batches([batch(_FOUND, anchor_id=anchor, slot=slot, vec_id=vec, score=score)])

    return rows.groupBy("side", "part").cogroup(asked.groupBy("side", "part")).applyInArrow(run, _CELL)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k different vec_ids of each group with their rank; a partial selection comes before the shuffle."""
    best = found.groupBy(*keys, "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 10, lower: int = 30, upper: int = 90,
                   every: int = 100, scale: int = 256) -> DataFrame:
    """Hard negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` needs vec_id, label and embedding; other columns are ignored. Rows with a null id, label or vector or a
    null or non-finite component take no part, nor do those of another than the most frequent width or with
    components so large that a score could leave the range of a long. Where vec_id is divisible by 7 the label is
    (label + 1) modulo 10. Components become floor(scale * x); a score is the inner product with the anchor; higher
    scores come first, then smaller ids. Anchors are the rows whose vec_id is divisible by ``every``; their positives
    the first ``positives`` others of their label. Negatives have another label and
    lower * positive_score <= 100 * negative_score <= upper * positive_score; the first ``negatives`` are returned, none
    for a negative positive_score. Of an id on several rows the best-scored counts, an anchor never meets its own id, and of
    several rows of an anchor's id the least by label and vector asks.
    """
    spark = rows.sparkSession
    vectors, width = labelled_vectors(rows, scale)
    if not width:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                         "positive_score long, negative_score long")
    vectors = settled(vectors, "labelled-vectors")
    anchors = settled(vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(
        F.min(F.struct("label", "vector")).alias("_own")).select("vec_id", "_own.label", "_own.vector"), "anchors")
    n_vectors, n_anchors = vectors.count(), anchors.count()

    def same_label(scores, ids, labels, anchor):
        places = np.flatnonzero((labels == anchor["label"]) & (ids != anchor["vec_id"]))
        places = places[best_of(scores[places], ids[places], positives)]
        yield np.full(len(places), anchor["vec_id"]), np.zeros(len(places), int), ids[places], scores[places]

    near = settled(_first(_cells(vectors, anchors, n_vectors, n_anchors, same_label, width), ["anchor_id"], positives)
                   .select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
                           (F.col("rank") - 1).cast("int").alias("slot")), "positives")
    limits = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.sort_array(F.collect_list("positive_score"), asc=False).alias("limits"))

    def by_slot(scores, ids, labels, anchor):
        """The best of each slot: below the upper limit of its positive and above that of the next one."""
        limits = [upper * p // 100 for p in anchor["limits"]]
        least = min(-(-lower * p // 100) for p in anchor["limits"])
        other = np.flatnonzero((labels != anchor["label"]) & (scores >= least) & (scores <= limits[0]) & (ids != anchor["vec_id"]))
        own = scores[other]
        for slot, limit in enumerate(limits):
            below = limits[slot + 1] if slot + 1 < len(limits) else least - 1
            places = other[(own <= limit) & (own > below)]
            if len(places):
                places = places[best_of(scores[places], ids[places], negatives)]
                yield np.full(len(places), anchor["vec_id"]), np.full(len(places), slot), ids[places], scores[places]

    slots = _first(_cells(vectors, anchors.join(limits, "vec_id"), n_vectors, n_anchors, by_slot, width),
                   ["anchor_id", "slot"], negatives)
    slots = settled(slots.select("anchor_id", F.col("slot").alias("_slot"), F.col("vec_id").alias("negative_id"),
                                 F.col("score").alias("negative_score")), "slots")
    inside = (lower * F.col("positive_score") <= 100 * F.col("negative_score")) & (
        100 * F.col("negative_score") <= upper * F.col("positive_score"))
    merged = near.join(slots, "anchor_id").where((F.col("_slot") >= F.col("slot")) & inside)
    best = merged.groupBy("anchor_id", "positive_id", "positive_score", "negative_id").agg(
        F.max("negative_score").alias("negative_score"))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (best.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
