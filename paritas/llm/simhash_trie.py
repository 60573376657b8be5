"""Near-duplicate documents: SimHash fingerprints linked by a binary trie joined with itself.

Pairs of trie nodes are traversed together with the number of bits in which their paths differ, and
dropped once that exceeds the limit. The tries' roots are spread over the cluster: two fingerprints
with at most four differing bits agree in two of six blocks of bits, so each choice of two blocks
with each of their values is a root below which the rest of the bits is searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_batches, settled
from .components import connected_components
from .tokens import slices

SHINGLE_WORDS = 4
HASH_SEED = 42
MOST_BITS = 4
#: Starts and widths of the six blocks from the lowest bit on.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Roots with more fingerprints are divided by their next bits before they are searched.
ROOT_LIMIT = 20_000
_SPLIT_BITS = 8
_FRONTIER = 1_000_000  # node pairs traversed at a time

_PRINTS = {"doc_id": pa.int64(), "fingerprint": pa.int64()}


def fingerprints_of(texts: list[str]) -> np.ndarray:
    """SimHash of each text as unsigned 64-bit integers."""
    hashes: list[int] = []
    sizes = []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        words = text.encode().lower().split()  # of bytes: A-Z only, and exactly the six ASCII blanks
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
        starts = np.concatenate([[0], ends + 1])
        n = max(len(words) - SHINGLE_WORDS + 1, min(len(words), 1))
        lasts = ends[SHINGLE_WORDS - 1:] if len(words) >= SHINGLE_WORDS else ends[-1:]
        hashes += [digest(joined[a:b], HASH_SEED) for a, b in zip(starts[:n].tolist(), lasts.tolist())]
        sizes.append(n)
    sizes = np.array(sizes)
    result = np.zeros(len(texts), dtype=np.uint64)
    if hashes:
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1)
        full = np.flatnonzero(sizes)
        begins = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        ones = np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
        packed = np.packbits(2 * ones > sizes[full, None], axis=1)
        result[full] = np.ascontiguousarray(packed).view("<u8").reshape(-1)
    return result


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (as a signed long) of every whole text; a null text has no words."""

    def run(rows: pa.RecordBatch):
        found = [fingerprints_of(t) for t in slices(rows.column("text").to_pylist())]
        yield batch(_PRINTS, doc_id=rows.column("doc_id"), fingerprint=np.concatenate(found).view(np.int64))

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                   F.col("text").cast("string").alias("text")),
                       run, "doc_id long, fingerprint long")


def roots(prints: DataFrame) -> DataFrame:
    """root, side, fingerprint: each fingerprint below the root of every two of its blocks."""
    def block(i: int):
        start, width = BLOCKS[i]
        return F.shiftrightunsigned("fingerprint", start).bitwiseAND(F.lit((1 << width) - 1))

    keys = [F.shiftleft(F.lit(number).cast("long"), 22).bitwiseOR(
                F.shiftleft(block(a), 11).bitwiseOR(block(b)))
            for number, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2))]
    return prints.select(F.explode(F.array(*keys)).alias("root"), F.lit(2).alias("side"), "fingerprint")


def divided(work: DataFrame) -> DataFrame:
    """``work`` with its large roots divided by further bits until none exceeds the limit.

    A root is split into its children with themselves (side 2) and into the pairs of children that
    differ in few enough bits (sides 0 and 1), so that no task has to hold a large root and no pair is
    lost. Only pairs of children that exist are formed; a root has at most 256 of either side.
    """
    done = None
    for level in range(64 // _SPLIT_BITS):
        sizes = work.groupBy("root").agg(F.count("*").alias("_n")).where(F.col("_n") > ROOT_LIMIT)
        sizes = settled(sizes.select("root"), "large-roots")
        if sizes.isEmpty():
            break
        small = work.join(sizes, "root", "left_anti")
        done = settled(small if done is None else done.union(small), "small-roots")
        child = F.shiftrightunsigned("fingerprint", 64 - _SPLIT_BITS * (level + 1)).bitwiseAND(
            F.lit((1 << _SPLIT_BITS) - 1))
        large = work.join(sizes, "root", "left_semi").withColumn("child", child)
        children = settled(large.select("root", "side", "child").distinct(), "children")
        left = children.where("side <> 1").select("root", "side", F.col("child").alias("a"))
        right = children.where("side <> 0").select("root", F.col("child").alias("b"))
        pairs = left.join(right, "root").where(
            (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS) & ((F.col("side") == 0) | (F.col("a") <= F.col("b"))))
        pairs = pairs.withColumn("below", F.xxhash64("root", F.lit(level), "a", "b"))
        own = (F.col("side") == 2) & (F.col("a") == F.col("b"))
        parts = F.when(own, F.array(F.struct(F.col("a").alias("child"), F.lit(2).alias("from"), F.lit(2).alias("to")))).otherwise(
            F.array(F.struct(F.col("a").alias("child"), F.col("side").alias("from"), F.lit(0).alias("to")),
                    F.struct(F.col("b").alias("child"), F.when(F.col("side") == 2, 2).otherwise(1).alias("from"),
                             F.lit(1).alias("to"))))
        members = settled(pairs.select("root", "below", F.inline(parts)), "pairs-of-children")
        work = settled(
            large.join(members.withColumnRenamed("from", "side"), ["root", "side", "child"])
            .select(F.col("below").alias("root"), F.col("to").alias("side"), "fingerprint"), "divided-roots")
    return work if done is None else done.union(work)


def linked_pairs(root: np.ndarray, side: np.ndarray, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs below one root with at most ``MOST_BITS`` differing bits, in parts.

    The rows are sorted by root, side and fingerprint: a trie node is a range of rows, the children at
    a bit are found by counting. All roots are traversed at once, level by level.
    """
    n = len(prints)
    starts = np.flatnonzero(np.concatenate([[True], (root[1:] != root[:-1]) | (side[1:] != side[:-1])]))
    ends = np.append(starts[1:], n)
    own = side[starts] == 2
    a_lo, a_hi = starts[own], ends[own]
    first = np.flatnonzero((side[starts[:-1]] == 0) & (side[starts[1:]] == 1)
                           & (root[starts[:-1]] == root[starts[1:]]))
    stack = [(0, a_lo, a_hi, a_lo, a_hi, np.zeros(len(a_lo), dtype=np.int8)),
             (0, starts[first], ends[first], starts[first + 1], ends[first + 1],
              np.zeros(len(first), dtype=np.int8))]
    zeros: dict[int, np.ndarray] = {}
    while stack:
        bit, a_lo, a_hi, b_lo, b_hi, differ = stack.pop()
        same = a_lo == b_lo
        keep = (a_hi > a_lo) & (b_hi > b_lo) & (differ <= MOST_BITS) & (~same | (a_hi - a_lo > 1))
        a_lo, a_hi, b_lo, b_hi, differ = (x[keep] for x in (a_lo, a_hi, b_lo, b_hi, differ))
        if not len(a_lo):
            continue
        if len(a_lo) > _FRONTIER:
            middle = len(a_lo) // 2
            for part in (slice(None, middle), slice(middle, None)):
                stack.append((bit, a_lo[part], a_hi[part], b_lo[part], b_hi[part], differ[part]))
            continue
        leaf = (a_hi - a_lo == 1) & (b_hi - b_lo == 1)
        if leaf.any():
            i, j = a_lo[leaf], b_lo[leaf]
            close = np.bitwise_count(prints[i] ^ prints[j]) <= MOST_BITS
            yield i[close], j[close]
            a_lo, a_hi, b_lo, b_hi, differ = (x[~leaf] for x in (a_lo, a_hi, b_lo, b_hi, differ))
        if not len(a_lo) or bit == 64:
            continue
        if bit not in zeros:
            zeros[bit] = np.concatenate([[0], np.cumsum((prints >> np.uint64(63 - bit)) & np.uint64(1) == 0)])
            zeros.pop(bit - 2, None)
        count = zeros[bit]
        a_mid, b_mid = a_lo + count[a_hi] - count[a_lo], b_lo + count[b_hi] - count[b_lo]
        cross = a_lo != b_lo
        more = (differ + 1).astype(np.int8)
        stack.append((bit + 1,
                      np.concatenate([a_lo, a_mid, a_lo, a_mid[cross]]),
                      np.concatenate([a_mid, a_hi, a_mid, a_hi[cross]]),
                      np.concatenate([b_lo, b_mid, b_mid, b_lo[cross]]),
                      np.concatenate([b_mid, b_hi, b_hi, b_mid[cross]]),
                      np.concatenate([differ, differ, more, more[cross]])))


class Forest:
    """Sets of equal things over 0..n-1, each named by its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.parent[i], self.parent[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                on = self.parent[self.parent]
                if (on == self.parent).all():
                    break
                self.parent = on


_LINKS = {"u": pa.int64(), "v": pa.int64()}


def links(work: DataFrame) -> DataFrame:
    """Edges (u, v) between fingerprints that connect exactly what the close pairs connect."""
    dealt = work.repartition("root").sortWithinPartitions("root", "side", "fingerprint")

    def run(batches):
        held: list[pa.RecordBatch] = []
        for rows in batches:
            held.append(rows)
            if sum(r.num_rows for r in held) < 2 * ROOT_LIMIT:
                continue
            # all but the last root are complete
            table = pa.Table.from_batches(held)
            root = table.column("root").to_numpy()
            cut = int(np.searchsorted(root == root[-1], True))
            if cut:
                yield join(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield join(pa.Table.from_batches(held))

    def join(table: pa.Table) -> pa.RecordBatch:
        root, side = table.column("root").to_numpy(), table.column("side").to_numpy()
        prints = table.column("fingerprint").to_numpy().view(np.uint64)
        order = np.lexsort((prints, side, root))
        root, side, prints = root[order], side[order], prints[order]
        names, places = np.unique(prints, return_inverse=True)
        forest = Forest(len(names))
        for i, j in linked_pairs(root, side, prints):
            forest.join(places[i], places[j])
        linked = np.flatnonzero(forest.parent != np.arange(len(names)))
        return batch(_LINKS, u=names[linked].view(np.int64), v=names[forest.parent[linked]].view(np.int64))

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of every document of ``docs`` (doc_id, text).

    One row per input row: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest
    doc_id that links of at most ``MOST_BITS`` differing bits reach, itself included). Null, empty and
    blank texts have fingerprint zero and are linked like any other. Equal fingerprints are joined as
    one; a null doc_id gets the smallest known one of its component, or null if there is none.
    """
    prints = settled(fingerprints(docs), "fingerprints")
    texts = settled(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id")), "texts")
    joined = connected_components(links(divided(roots(texts.select("fingerprint")))))
    named = texts.join(joined.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", F.coalesce("component", "fingerprint").alias("component"), "least_id")
    named = settled(named, "named-texts")
    least = settled(named.groupBy("component").agg(F.min("least_id").alias("component_id")), "least-ids")
    members = settled(named.join(least, "component").select("fingerprint", "component_id"), "members")
    return prints.join(members, "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
