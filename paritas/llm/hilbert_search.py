"""Nearest neighbours by inner product from several shifted Hilbert orderings.

Vectors are projected to a few dimensions in several ways; each projection is ordered along a shifted
Hilbert curve and range-partitioned, and a query's candidates are the vectors around it on every
curve. The k-th best of them is a bound; blocks of consecutive vectors of the first curve whose
bounding ball could hold something better are searched as well, so that the answer is exact.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, map_batches, settled

#: Orderings, projected dimensions, bits per dimension (together at most 62), neighbours on either side.
CURVES, DIMENSIONS, BITS, REACH = 4, 6, 10, 200
#: Vectors of a block, and queries that meet a block at once.
BLOCK, QUERIES = 4096, 1024
SEED = 11
#: Rounding that sums of products may show, relative to the lengths of the vectors.
SLACK = 1e-9

_HITS = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
_HIT_SCHEMA = "query_id long, vec_id long, score double"
_BLOCKS = {"first": pa.int64(), "n": pa.int64(), "ids": pa.binary(), "vectors": pa.binary(),
           "bounds": pa.binary(), "centre": pa.binary(), "radius": pa.float64(), "least": pa.float64()}
_BLOCK_SCHEMA = ("first long, n long, ids binary, vectors binary, bounds binary, centre binary, "
                 "radius double, least double")


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``cells`` (unsigned coordinates of ``bits`` bits) on a Hilbert curve, by
    the transposed form of the index (Skilling 2004)."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    keys = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            keys = keys << 1 | (x[i] >> bit & 1)
    return keys


def curve_keys(vectors: np.ndarray, longest: float, curve: int) -> np.ndarray:
    """Hilbert keys of the curve's projection. A further coordinate makes all vectors equally long, so
    that the largest inner product is the smallest distance."""
    rng = np.random.default_rng((SEED, curve))
    n = vectors.shape[1]
    axes = np.linalg.qr(rng.normal(size=(n + 1, n + 1)))[0][:, :min(DIMENSIONS, n + 1)]
    shift = rng.random(axes.shape[1])
    rest = np.sqrt(np.maximum(longest ** 2 - (vectors ** 2).sum(axis=1), 0))
    spread = np.hstack([vectors, rest[:, None]]) @ axes * (np.sqrt(n + 1) / longest)
    # about evenly over the cells for directions without a preference; the shift moves the cells
    even = 1 / (1 + np.exp(-1.702 * spread))
    cells = ((even * 0.5 + 0.5 * shift) * (1 << BITS)).astype(np.int64)
    return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1), BITS)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)


def _best(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int,
          bounds: np.ndarray | None = None):
    """(query_id, vec_id, score) of the k best vectors of each query, not itself, not below its bound.
    Scores are summed anew in one fixed order, so that equal vectors have equal scores."""
    scores = queries @ vectors.T
    slack = SLACK * (np.linalg.norm(queries, axis=1) * np.linalg.norm(vectors, axis=1).max(initial=0) + 1e-300)
    found = []
    for i in range(len(queries)):
        own = scores[i]
        least = -np.inf
        if len(own) > k + 1:
            least = np.partition(own, -(k + 1))[-(k + 1)]
        if bounds is not None:
            least = max(least, bounds[i])
        places = np.flatnonzero(own >= least - 2 * slack[i])
        places = places[ids[places] != query_ids[i]]
        exact = (vectors[places] * queries[i]).sum(axis=1)
        order = np.lexsort((ids[places], -exact))[:k]
        found.append((np.full(len(order), query_ids[i]), ids[places][order], exact[order]))
    return (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def valid_vectors(rows: DataFrame) -> tuple[DataFrame, int, float]:
    """vec_id and embedding (doubles) of the vectors that take part, their width and longest length.
    Of vectors of several widths the most frequent one takes part, of equally frequent ones the wider."""
    vector = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    usable = (~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
              & F.exists(vector, lambda x: x != 0))
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False)))
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    widths = (vectors.groupBy(F.size("embedding").alias("width"))
              .agg(F.count("*").alias("n"), F.sqrt(F.max(squares)).alias("longest")).collect())
    if not widths:
        return vectors, 0, 1.0
    most = max(widths, key=lambda w: (w.n, w.width))
    return vectors.where(F.size("embedding") == most.width), most.width, most.longest


def on_curve(vectors: DataFrame, width: int, longest: float, curve: int) -> DataFrame:
    kinds = {"vec_id": pa.int64(), "embedding": pa.list_(pa.float64()), "key": pa.int64()}

    def run(rows: pa.RecordBatch):
        yield batch(kinds, vec_id=rows.column("vec_id"), embedding=rows.column("embedding"),
                    key=curve_keys(_matrix(rows.column("embedding"), width), longest, curve))

    return map_batches(vectors, run, "vec_id long, embedding array<double>, key long")


def window_hits(ordered: DataFrame, width: int, k: int, every: int) -> DataFrame:
    """The k best of the neighbours of each query on one curve, at most ``REACH`` on either side."""

    def run(batches):
        ids, vectors = np.zeros(0, np.int64), np.zeros((0, width))
        done = 0  # rows before have been answered

        def answer(until: int):
            places = np.arange(done, until)
            places = places[ids[places] % every == 0]
            found = [tuple(_best(vectors[p:p + 1], ids[p:p + 1], vectors[max(p - REACH, 0):p + REACH + 1],
                                 ids[max(p - REACH, 0):p + REACH + 1], k)) for p in places.tolist()]
            if found:
                q, v, s = (np.concatenate(x) for x in zip(*found))
                yield batch(_HITS, query_id=q, vec_id=v, score=s)

        for rows in batches:
            ids = np.concatenate([ids, rows.column("vec_id").to_numpy()])
            vectors = np.concatenate([vectors, _matrix(rows.column("embedding"), width)])
            until = max(len(ids) - REACH, done)
            yield from answer(until)
            drop = max(until - REACH, 0)
            ids, vectors, done = ids[drop:], vectors[drop:], until - drop
        yield from answer(len(ids))

    return ordered.mapInArrow(run, _HIT_SCHEMA)


def top(hits: DataFrame, k: int) -> DataFrame:
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.distinct().withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def blocks(ordered: DataFrame, width: int, size: int, bounded: bool) -> DataFrame:
    """Consecutive vectors of a curve as one row: ids, vectors, and a ball that holds them all; with
    ``bounded`` also what each has to exceed (column bound), and the least of that."""

    def pack_rows(held):
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column("vec_id").to_numpy()
        vectors = _matrix(table.column("embedding").combine_chunks(), width)
        bounds = table.column("bound").to_numpy() if bounded else np.zeros(0)
        centre = vectors.mean(axis=0)
        return batch(_BLOCKS, first=[int(ids.min())], n=[len(ids)], ids=[ids.tobytes()], vectors=[vectors.tobytes()],
                     bounds=[bounds.tobytes()], centre=[centre.tobytes()],
                     radius=[float(np.linalg.norm(vectors - centre, axis=1).max())],
                     least=[float(bounds.min()) if bounded else 0.0])

    def packed(batches):
        held, n = [], 0
        for rows in batches:
            for at in range(0, rows.num_rows, size):
                held.append(rows.slice(at, size))
                n += held[-1].num_rows
                if n >= size:
                    yield pack_rows(held)
                    held, n = [], 0
        if held:
            yield pack_rows(held)

    return ordered.mapInArrow(packed, _BLOCK_SCHEMA)


def better_hits(vector_blocks: DataFrame, query_blocks: DataFrame, n_query_blocks: int, width: int, k: int) -> DataFrame:
    """Hits above the queries' bounds in all pairs of blocks whose balls allow for one."""
    right = query_blocks.select(F.col("number").alias("q_number"), *(F.col(c).alias(f"q_{c}") for c in
                                ("ids", "vectors", "bounds", "centre", "radius", "least")))
    pairs = (vector_blocks.select("number", "centre", "radius")
             .withColumn("q_number", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_query_blocks - 1).cast("long")))))
    pairs = pairs.join(right.select("q_number", "q_centre", "q_radius", "q_least"), "q_number")
    kinds = {"number": pa.int64(), "q_number": pa.int64()}

    def possible(rows: pa.RecordBatch):
        a, b = (np.frombuffer(b"".join(rows.column(c).to_pylist())).reshape(-1, width) for c in ("centre", "q_centre"))
        r, s = rows.column("radius").to_numpy(), rows.column("q_radius").to_numpy()
        most = (a * b).sum(axis=1) + r * np.linalg.norm(b, axis=1) + s * np.linalg.norm(a, axis=1) + r * s
        chosen = pa.array(most * (1 + SLACK) + SLACK >= rows.column("q_least").to_numpy())
        yield pa.RecordBatch.from_arrays([rows.column(c).filter(chosen) for c in kinds], names=list(kinds))

    pairs = map_batches(pairs, possible, "number long, q_number long")
    joined = (pairs.join(vector_blocks.select("number", "ids", "vectors"), "number")
              .join(right.select("q_number", "q_ids", "q_vectors", "q_bounds"), "q_number"))

    def search(rows: pa.RecordBatch):
        for row in rows.to_pylist():
            ids, query_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
            q, v, s = _best(np.frombuffer(row["q_vectors"]).reshape(-1, width), query_ids,
                            np.frombuffer(row["vectors"]).reshape(-1, width), ids, k,
                            np.frombuffer(row["q_bounds"]))
            yield batch(_HITS, query_id=q, vec_id=v, score=s)

    return map_batches(joined, search, _HIT_SCHEMA)


def _numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """Written rows with a gapless number; there is one row per block."""
    stored = settled(rows, "blocks")
    number = F.row_number().over(Window.orderBy("first")) - 1
    keys = settled(stored.select("first").withColumn("number", number.cast("long")), "block-numbers")
    return stored.join(keys, "first"), keys.count()


def nearest(rows: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The ``k`` nearest vectors of each query: query_id, rank, vec_id, score.

    ``rows`` needs vec_id and embedding. Queries are the vectors whose vec_id is divisible by
    ``every``; their candidates are all others. Nearness is the inner product in double precision, ties go to
    the smaller vec_id. Vectors that are null or zero or hold null or non-finite components take no
    part, nor do those with a null id or of another than the most frequent width. Of repeated ids the
    pair with a better score counts, and a query never finds its own id.
    """
    spark = rows.sparkSession
    vectors, width, longest = valid_vectors(rows)
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = settled(vectors, "vectors")
    curves = [on_curve(vectors, width, longest, c).repartitionByRange("key", "vec_id")
              .sortWithinPartitions("key", "vec_id") for c in range(CURVES)]
    near = top(reduce(DataFrame.union, (window_hits(c, width, k, every) for c in curves)), k)
    near = settled(near.select("query_id", "vec_id", "score", "rank"), "window-hits")
    bound = near.groupBy("query_id").agg(
        F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("bound"))
    wanted = vectors.where(F.col("vec_id") % every == 0).join(bound.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
    wanted = wanted.withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    keyed = on_curve(wanted.select("vec_id", "embedding"), width, longest, 0).join(
        wanted.select("vec_id", "bound").groupBy("vec_id").agg(F.min("bound").alias("bound")), "vec_id")
    vector_blocks, _ = _numbered(blocks(curves[0], width, BLOCK, False))
    query_blocks, n = _numbered(blocks(keyed.repartitionByRange("key", "vec_id").sortWithinPartitions("key", "vec_id"),
                                       width, QUERIES, True))
    found = near.select("query_id", "vec_id", "score")
    if n:
        found = found.union(better_hits(vector_blocks, query_blocks, n, width, k))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return top(best, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
