"""Similarity join of texts by the Jaccard similarity of their word n-grams, by vertical partitioning.

The global order of the n-grams (that of their hashes, which loads all parts alike) is cut into fragments, and
every set into the segments that fall into them. Two similar sets differ in a bounded number of n-grams, so with
more fragments than that they agree in whole segments: these, hashed, name the candidates. The overlap of a
candidate pair is counted fragment by fragment, in tasks of their own, and summed per pair.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_batches, settled
from .components import connected_components
from .tokens import slices

HASH_SEED = 42
#: Sizes of sets from one class to the next; the fragments of a pair are those of its larger set's class.
CLASS_RATIO = 1.5
#: Longs of the parity bitmap of a set. Two bitmaps differ in no more bits than the sets in members.
BITMAP_LONGS = 8
#: Members of a set that are counted in one fragment, about.
COUNTED = 2048
#: So many sets of each key are held against all others of the key before sets still apart meet each other.
HUBS = 2

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_SETS = {"doc_id": pa.int64(), "text_hash": pa.int64(), "node": pa.int64(), "size": pa.int64(),
         "fingerprint": pa.int64(), "bits": pa.list_(pa.int64()), "keys": pa.list_(pa.int64()), "need": pa.int32()}
_SET_SCHEMA = ("doc_id long, text_hash long, node long, size long, fingerprint long, bits array<long>, keys array<long>, "
               "need int")
_SEGMENTS = {"node": pa.int64(), "level": pa.int32(), "part": pa.int32(), "grams": pa.binary()}
_COUNTS = {"u": pa.int64(), "v": pa.int64(), "both": pa.int64()}


def gram_hashes(text: str | None, words: int) -> np.ndarray:
    """Hash of each run of ``words`` words of ``text``, repeats included; a shorter text is one run, one without
    words none. A-Z are lower-cased, words are what the six ASCII blanks separate."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined, ends, end = b" ".join(found), [], -1
    for word in found:
        end += len(word) + 1
        ends.append(end)
    digest = xxhash.xxh64_intdigest
    if len(ends) <= words:
        return np.array([digest(joined, HASH_SEED)], dtype=np.uint64)
    starts = [0, *(e + 1 for e in ends)]
    return np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(starts, ends[words - 1:])], dtype=np.uint64)


def most_different(sizes: int, least: tuple[int, int]) -> int:
    """In how many members two similar sets of together ``sizes`` members may differ."""
    return sizes * (least[1] - least[0]) // (least[1] + least[0])


@lru_cache(maxsize=4)
def classes(least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """First size and number of fragments of each size class up to 2^31 members."""
    starts = [1]
    while starts[-1] < 1 << 31:
        starts.append(max(starts[-1] + 1, int(starts[-1] * CLASS_RATIO)))
    differ = [most_different(2 * (b - 1), least) for b in starts[1:]]
    return np.array(starts), np.array([d + 2 + d // 8 for d in differ])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    return (x ^ (x >> np.uint64(29))) * _MIX[1]


def segment_keys(sets: list[np.ndarray], kind: np.ndarray, least: tuple[int, int]) -> tuple[list[np.ndarray], list[int]]:
    """Keys of the segments of each sorted, non-empty set under the class ``kind``, and how many of its keys it shares
    with every similar set.

    A set may differ from a similar one in at most d members, hence in as many fragments. Its keys are those of its first
    d + 1 + spare non-empty segments; at least 1 + spare of the set whose keys end earlier agree with the other's. A
    set with too few non-empty segments has all of them and its empty ones as keys; two similar sets that agree in empty
    segments only both are of this sort.
    """
    starts, fragments = classes(least)
    fragments = fragments[kind]
    sizes = np.array([len(s) for s in sets])
    partner = np.minimum(sizes * least[1] // least[0], starts[kind + 1] - 1)
    differ = most_different(sizes + np.maximum(partner, sizes), least)
    smallest = most_different(2 * -(-sizes * least[0] // least[1]), least)  # what its smallest similar set allows for, at least
    owner = np.repeat(np.arange(len(sets)), sizes)
    grams = np.concatenate(sets)
    piece = ((grams >> np.uint64(32)) * fragments[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (piece[1:] != piece[:-1])]))
    sums = np.add.reduceat(_mixed(grams), begins)
    owners, pieces = owner[begins], piece[begins]
    keys = _mixed(sums ^ _mixed(pieces.astype(np.uint64) * _MIX[2] + kind[owners].astype(np.uint64)))
    parts, need = np.split(keys, np.flatnonzero(np.diff(owners)) + 1), []
    for i, d in enumerate(differ.tolist()):
        spare = min(1 + d // 8, len(parts[i]) - d - 1)
        if spare < 0:
            empty = np.setdiff1d(np.arange(fragments[i]), pieces[owners == i]).astype(np.uint64)
            parts[i] = np.concatenate([parts[i], _mixed(_mixed(empty * _MIX[2] + np.uint64(kind[i])))])
            need.append(1)
        else:
            parts[i] = parts[i][:d + 1 + spare]
            need.append(1 + min(spare, 1 + int(smallest[i]) // 8))
    return parts, need


#: Bands of min-hashes as keys instead of segments: fewer keys of a long set, and a pair of similarity s shares none
#: with probability (1 - s^BAND_ROWS)^BANDS, 1.2e-7 at 0.8.
BANDS, BAND_ROWS = 40, 5
_ODD = np.random.default_rng(HASH_SEED).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """The bands of each non-empty set."""
    bands = np.zeros((len(sets), BANDS), dtype=np.uint64)
    hashes = np.concatenate(sets)
    begins = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    for k, (odd, weight) in enumerate(zip(*_ODD)):
        smallest = np.minimum.reduceat(hashes * odd, begins)
        bands[:, k // BAND_ROWS] += (smallest ^ (smallest >> np.uint64(29))) * weight
    return _mixed(bands + np.arange(BANDS, dtype=np.uint64)[None, :])


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    width = 64 * BITMAP_LONGS
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    places = _mixed(np.concatenate(sets) + _MIX[2]) >> np.uint64(64 - width.bit_length() + 1)
    odd = np.bincount(owner * width + places.astype(np.int64), minlength=len(sets) * width) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, width), axis=1).view(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash: the bits that are set in more than half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view("<i8")[0])


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows).view(np.int64)))


def _describe(texts: list[str], words: int, least: tuple[int, int], bands: bool):
    """node, size, fingerprint, bitmap, keys and need of each text."""
    none = np.zeros(0, dtype=np.uint64)
    hashes = [gram_hashes(t, words) for t in texts]
    sets = [np.unique(h) for h in hashes]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    bits, keys, need = [none] * len(sets), [none] * len(sets), [1] * len(sets)
    starts = classes(least)[0]
    partner = sizes * least[1] // least[0]  # the largest similar set
    usable = np.flatnonzero((sizes > 0) & ((sizes + np.maximum(partner, 1)) * (least[1] - least[0]) >= least[1] + least[0]))
    if len(usable):
        for i, row in zip(usable.tolist(), _bitmaps([sets[i] for i in usable])):
            bits[i] = row.view(np.uint64)
        if bands:
            for i, row in zip(usable.tolist(), band_keys([sets[i] for i in usable])):
                keys[i] = row
        else:
            own, last = (np.searchsorted(starts, x, "right") - 1 for x in (sizes, partner))
            for step in range(int((last - own).max()) + 1):
                chosen = usable[(own + step <= last)[usable]]
                if len(chosen):
                    parts, wanted = segment_keys([sets[i] for i in chosen], (own + step)[chosen], least)
                    for i, part, n in zip(chosen.tolist(), parts, wanted):
                        need[i] = min(need[i], n) if len(keys[i]) else n
                        keys[i] = np.concatenate([keys[i], part])
    nodes = [xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0 for s in sets]
    return (np.array(nodes, dtype=np.uint64).view(np.int64), sizes,
            [fingerprint(h) if bands else 0 for h in hashes], bits, keys, need)


def gram_sets(docs: DataFrame, words: int, least: tuple[int, int], bands: bool = False) -> DataFrame:
    """Of every row of ``docs`` (doc_id, text_hash, text): the digest ``node`` and the size of its set, and the bitmap
    and keys of a set that can have similar ones, with the number of keys it needs to share. With ``bands`` keys are
    bands of min-hashes, and there is a SimHash fingerprint."""

    def run(rows: pa.RecordBatch):
        at = 0
        for texts in slices(rows.column("text").to_pylist()):
            part = rows.slice(at, len(texts))
            node, size, prints_of, bits, keys, need = _describe(texts, words, least, bands)
            yield batch(_SETS, doc_id=part.column("doc_id"), text_hash=part.column("text_hash"), node=node, size=size,
                        fingerprint=prints_of, bits=_lists(bits), keys=_lists(keys), need=need)
            at += len(texts)

    return map_batches(docs.select("doc_id", "text_hash", "text"), run, _SET_SCHEMA)


def level_of(size: int, counted: int) -> int:
    """The cut for counting: into 2^level parts, of about ``counted`` members each."""
    return max(0, (max(size, 1) - 1) // counted).bit_length()


def counted_segments(texts: DataFrame, words: int, least: tuple[int, int]) -> DataFrame:
    """node, level, part, grams of the sets of ``texts`` (node, text), under the cut of each pair they can be in."""
    counted = COUNTED

    def run(rows: pa.RecordBatch):
        for node, text in zip(rows.column("node").to_pylist(), rows.column("text")):
            grams = np.unique(gram_hashes(text.as_py(), words))
            for level in range(level_of(len(grams), counted), level_of(len(grams) * least[1] // least[0], counted) + 1):
                bounds = np.searchsorted(grams >> np.uint64(64 - level), np.arange((1 << level) + 1)) if level else [0, len(grams)]
                full = [(i, a, b) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a]
                yield batch(_SEGMENTS, node=[node] * len(full), level=[level] * len(full), part=[f[0] for f in full],
                            grams=[grams[a:b].tobytes() for _, a, b in full])

    return map_batches(texts.select("node", "text"), run, "node long, level int, part int, grams binary")


def similar_pairs(pairs: DataFrame, segments: DataFrame, least: tuple[int, int]) -> DataFrame:
    """u, v of the rows of ``pairs`` (u, v, size_u, size_v) that are similar: the members in common are counted in
    each fragment and summed."""
    larger = F.greatest("size_u", "size_v")
    parts = F.floor((larger - 1) / COUNTED).cast("long")
    level = F.when(parts == 0, 0).otherwise(F.length(F.bin(parts))).cast("int")
    cut = pairs.select("u", "v", level.alias("level"))
    one = segments.select(F.col("node").alias("u"), "level", "part", F.col("grams").alias("_a"))
    other = segments.select(F.col("node").alias("v"), "level", "part", F.col("grams").alias("_b"))

    def run(rows: pa.RecordBatch):
        both = [len(np.intersect1d(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64), True))
                for a, b in zip(rows.column("_a"), rows.column("_b"))]
        yield batch(_COUNTS, u=rows.column("u"), v=rows.column("v"), both=both)

    counted = map_batches(cut.join(one, ["u", "level"]).join(other, ["v", "level", "part"]).select("u", "v", "_a", "_b"),
                          run, "u long, v long, both long")
    total = counted.groupBy("u", "v").agg(F.sum("both").alias("both"))
    return (total.join(pairs, ["u", "v"])
            .where(least[1] * F.col("both") >= least[0] * (F.col("size_u") + F.col("size_v") - F.col("both"))).select("u", "v"))


def _possible(least: tuple[int, int], a: str = "", b: str = ""):
    """Whether sizes and bitmaps of two sets (columns behind the prefixes) leave room for a similar pair."""
    size, other = F.col(f"{a}size"), F.col(f"{b}size")
    differ = sum(F.bit_count(F.col(f"{a}bits")[i].bitwiseXOR(F.col(f"{b}bits")[i])) for i in range(BITMAP_LONGS))
    return ((least[1] * F.least(size, other) >= least[0] * F.greatest(size, other))
            & ((least[0] + least[1]) * differ <= (least[1] - least[0]) * (size + other)))


def fitting_pairs(pairs: DataFrame, nodes: DataFrame, least: tuple[int, int]) -> DataFrame:
    """u, v, size_u, size_v of the rows of ``pairs`` (u, v) whose sizes and bitmaps allow for similarity."""
    for name in ("u", "v"):
        pairs = pairs.join(nodes.select(F.col("node").alias(name), F.col("size").alias(f"{name}_size"),
                                        F.col("bits").alias(f"{name}_bits")), name)
    return pairs.where(_possible(least, "u_", "v_")).select(
        "u", "v", F.col("u_size").alias("size_u"), F.col("v_size").alias("size_v"))


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def hub_pairs(members: DataFrame) -> DataFrame:
    """Each set with ``HUBS`` sets of each of its keys: the least by number, which keys of one group share, and others
    that the key chooses."""
    ranks = [F.min("node"), *(F.min_by("node", F.xxhash64("node", "key", F.lit(i))) for i in range(1, HUBS))]
    hubs = members.groupBy("key").agg(F.array_distinct(F.array(*ranks)).alias("hubs"))
    joined = members.join(hubs, "key").select("node", F.explode("hubs").alias("hub")).where("node <> hub")
    return joined.select(*_ordered("node", "hub")).distinct()


def remaining_pairs(members: DataFrame, nodes: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The possible pairs of different components in each segment; those of its largest component, which are
    most of a large group of copies, are never held against each other."""
    counted = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = (counted.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("n"))
               .where("n > 1").select("key", F.col("most.component").alias("largest")))
    known = members.join(largest, "key").join(nodes.select("node", "size", "bits"), "node")
    left = known.where(F.col("component") != F.col("largest"))
    right = known.select("key", *(F.col(c).alias(f"_{c}") for c in ("node", "size", "bits", "component")))
    apart = ((F.col("component") != F.col("_component"))
             & ((F.col("_component") == F.col("largest")) | (F.col("node") < F.col("_node"))))
    joined = left.join(right, "key").where(apart & _possible(least, "", "_"))
    return joined.select(*_ordered("node", "_node")).distinct()


def similar_groups(docs: DataFrame, words: int, least: tuple[int, int], bands: bool = False, more_pairs=None) -> DataFrame:
    """doc_id, text_hash, n_shingles and component (a number; null for an empty set) of every row of ``docs``.

    Rows share a component if links of a Jaccard similarity of at least ``least[0] / least[1]`` connect their
    texts. Equal sets are one node. ``more_pairs`` may name further pairs (u, v) of nodes (node, fingerprint).
    Candidates are held against ``HUBS`` members of each of their keys first, so that a large group of copies
    is joined by few comparisons; what is still apart is compared with all that shares a key with it.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                       F.col("text").cast("string").alias("text"))
    sets = settled(gram_sets(docs, words, least, bands), "gram-sets")
    nodes = settled(sets.where(F.size("keys") > 0).select("node", "size", "bits", "fingerprint", "need")
                    .dropDuplicates(["node"]), "nodes")
    keyed = sets.select(F.explode("keys").alias("key"), "node")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = settled(keyed.join(settled(shared, "shared-keys"), "key", "left_semi").distinct(), "key-members")
    # keys of one node's copies are not shared, and a node that shares too few keys has no similar one
    shared = settled(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared-keys")
    members = members.join(shared, "key", "left_semi")
    enough = members.groupBy("node").agg(F.count("*").alias("n")).join(nodes.select("node", "need"), "node").where("n >= need")
    members = settled(members.join(enough.select("node"), "node", "left_semi"), "key-members")
    pairs = hub_pairs(members)
    if more_pairs is not None:
        pairs = pairs.union(more_pairs(nodes.select("node", "fingerprint")).select(*_ordered("u", "v"))).distinct()
    pairs = settled(fitting_pairs(pairs, nodes, least), "pairs")
    wanted = members.select("node").union(pairs.select("u")).union(pairs.select("v")).distinct()
    labels = settled(wanted.select("node", F.col("node").alias("component")), "labels")
    first = (sets.join(labels.select("node"), "node", "left_semi").groupBy("node")
             .agg(F.min(F.struct("doc_id", "text_hash")).alias("_first"))
             .select("node", F.col("_first.doc_id").alias("_id"), F.col("_first.text_hash").alias("_hash")))
    texts = docs.join(first, docs.doc_id.eqNullSafe(F.col("_id")) & (docs.text_hash == F.col("_hash")))
    segments = settled(counted_segments(texts, words, least).dropDuplicates(["node", "level", "part"]), "counted-segments")
    labels = _joined(labels, pairs, segments, least)
    left = fitting_pairs(remaining_pairs(members.join(labels, "node"), nodes, least), nodes, least)
    left = settled(left.join(pairs, ["u", "v"], "left_anti"), "remaining-pairs")
    if not left.isEmpty():
        labels = _joined(labels, left, segments, least)
    found = sets.select("doc_id", "text_hash", "node", F.col("size").alias("n_shingles")).join(labels, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "node"))
    return found.select("doc_id", "text_hash", "n_shingles", component.alias("component"))


def _joined(labels: DataFrame, pairs: DataFrame, segments: DataFrame, least: tuple[int, int]) -> DataFrame:
    """``labels`` (node, component) with the components joined that similar ``pairs`` link."""
    close = settled(similar_pairs(pairs, segments, least), "links")
    own = [labels.select(F.col("node").alias(n), F.col("component").alias(f"c{n}")) for n in ("u", "v")]
    moved = connected_components(close.join(own[0], "u").join(own[1], "v").select(
        F.col("cu").alias("u"), F.col("cv").alias("v"))).select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return settled(labels.join(moved, "component", "left").select("node", F.coalesce("_to", "component").alias("component")), "labels")


def jaccard_components(docs: DataFrame, words: int = 4, least: tuple[int, int] = (85, 100)) -> DataFrame:
    """Set size and component of every row of ``docs`` (doc_id, text; other columns are ignored).

    One row per input row: doc_id, n_shingles, component_id (the smallest doc_id that links of a Jaccard
    similarity of at least ``least[0] / least[1]`` reach, itself included). A text of fewer words than
    ``words`` is one n-gram. Null, empty and blank texts have none and are linked with nothing. Repeated rows are
    linked; of an id on several texts each row has its text's component; a null doc_id gets the smallest known one of its
    component, or null. N-grams are compared by 64-bit hashes.
    """
    found = settled(similar_groups(docs, words, least), "similar-groups")
    least_ids = found.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("_least"))
    return found.join(least_ids, "component", "left").select(
        "doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"))
