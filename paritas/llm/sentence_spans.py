"""Removal of passages that repeat across documents, by hashed runs of consecutive sentences."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_batches
from .tokens import slices

#: A run has at least so many sentences and words; from each sentence the shortest such run is taken,
#: and backwards from each sentence that ends none of these, so that a repeated passage is covered up
#: to its last sentence.
RUN_SENTENCES, RUN_WORDS = 2, 20
#: Sentences of more words are cut behind the word that begins the pair of least hash in each window of so
#: many pairs, so that passages fall into the same pieces wherever they stand. Two places of a passage have all
#: cuts in common but those of the first and the last window, and no piece is longer than the window: any
#: 51 words in common hold a whole run.
CUT_WINDOW = 10
#: Runs that a task reduces to one candidate per hash at a time.
BLOCK_RUNS = 1_000_000

_ENDS = re.compile(r"(?:[.!?…]+[\"'”’»)\]]*(?=\s)|[。！？]+|\n)\s*")
_WORDS = re.compile(r"\S+\s*")
_KEPT_WORDS = 500_000
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


class _Hashes(dict):
    """Hashes of words, kept; starts anew when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        found = self[word] = zlib.crc32(word.encode())
        return found


_hashes = _Hashes()


def _window_minima(keys: np.ndarray) -> np.ndarray:
    """Least key of each window of ``CUT_WINDOW``."""
    width = 1
    while 2 * width <= CUT_WINDOW:
        keys, width = np.minimum(keys[:-width], keys[width:]), 2 * width
    rest = CUT_WINDOW - width
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def sentences(text: str) -> list[int]:
    """Ends of the sentences of ``text`` and of the pieces of long ones; together they are all of it."""
    ends = [m.end() for m in _ENDS.finditer(text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    lengths = list(map(len, _WORDS.findall(text)))
    if len(lengths) <= CUT_WINDOW:
        return ends
    starts = np.cumsum([len(text) - sum(lengths), *lengths[:-1]])
    hashes = np.array(list(map(_hashes.__getitem__, text.lower().split())), dtype=np.uint64)
    if len(hashes) != len(starts):  # lower case never adds white space
        raise ValueError("words of a text and of its lower case differ")
    pairs = (hashes[:-1] * np.uint64(_MULTIPLIER) ^ hashes[1:]) * np.uint64(_INVERSE)
    # the last of equal hashes is the least
    keys = pairs >> np.uint64(32) << np.uint64(32) | np.arange(len(pairs), 0, -1, dtype=np.uint64)
    least = _window_minima(keys)
    owner = np.searchsorted(np.array(ends), starts, side="right")
    inside = owner[:-CUT_WINDOW] == owner[CUT_WINDOW:]
    behind = len(pairs) - (least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64) + 1
    return sorted({*ends, *starts[np.unique(behind)].tolist()})


def _powers(base: int, n: int) -> np.ndarray:
    result = np.full(n, base, dtype=np.uint64)
    result[:1] = 1
    return np.multiply.accumulate(result)


def runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, first sentence and end of every run of the texts."""
    hashes, n_words, counts = [], [], []
    digest = xxhash.xxh3_64_intdigest
    for text in texts:
        start, ends = 0, sentences(text)
        for end in ends:
            words = text[start:end].lower().split()
            hashes.append(digest(" ".join(words).encode()))
            n_words.append(len(words))
            start = end
        counts.append(len(ends))
    n = len(hashes)
    firsts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    weights, inverse = _powers(_MULTIPLIER, n), _powers(_INVERSE, n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(np.array(hashes, dtype=np.uint64) * weights, out=sums[1:])
    words = np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)
    i = np.arange(n)
    forward = np.maximum(np.searchsorted(words, words[:-1] + RUN_WORDS), i + RUN_SENTENCES)
    inside = forward <= firsts[owner + 1]
    begin, end = i[inside], forward[inside]
    # the last start from which the words suffice up to each end
    back = np.minimum(np.searchsorted(words, words[1:] - RUN_WORDS, side="right") - 1, i + 1 - RUN_SENTENCES)
    inside = back >= firsts[owner]
    inside[end - 1] = False
    spans = np.unique(np.concatenate([begin * (n + 1) + end, back[inside] * (n + 1) + i[inside] + 1]))
    begin, end = spans // (n + 1), spans % (n + 1)
    mixed = (sums[end] - sums[begin]) * inverse[begin]
    mixed ^= mixed >> np.uint64(32)
    mixed = mixed * np.uint64(_MULTIPLIER) + (end - begin).astype(np.uint64)
    numbers = owner[begin]
    return mixed.view(np.int64), numbers, begin - firsts[numbers], end - firsts[numbers]


#: ``place`` is the first sentence times 2^32 and the end; hash is the document's key for covered rows.
_RUNS = {"hash": pa.int64(), "covered": pa.bool_(), "doc_id": pa.int64(), "doc_key": pa.int32(), "place": pa.int64()}
_RUN_SCHEMA = "hash long, covered boolean, doc_id long, doc_key int, place long"
_COVERS = {"doc_id": pa.int64(), "doc_key": pa.int32(), "place": pa.int64()}


def _first_of_each(hashes, *order) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order and, in it, a mask of the first row of each hash."""
    rank = np.lexsort((*reversed(order), hashes))
    ordered = hashes[rank]
    return rank, np.concatenate([[True], ordered[1:] != ordered[:-1]])[:len(rank)]


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc_id, doc_key, place of all runs that stand, in the order of documents and of sentences within
    them, behind another run with the same hash.

    Each task first keeps one candidate per hash in every block of runs, the others of the block
    being repeats already. The shuffle therefore brings together no more rows of one hash than there
    are blocks, however common a passage is; there the sorted candidates are scanned once.
    """

    def candidates(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def reduced():
            hashes, ids, keys, place = (np.concatenate(x) for x in zip(*held))
            rank, first = _first_of_each(hashes, ids, keys, place)
            hashes, ids, keys, place = (x[rank] for x in (hashes, ids, keys, place))
            dealt_by = np.where(first, hashes, ids * 31 + keys)  # a repeat needs its document only
            return batch(_RUNS, hash=dealt_by, covered=~first, doc_id=ids, doc_key=keys, place=place)

        for rows in batches:
            ids = rows.column("doc_id").to_numpy(zero_copy_only=False)
            keys, at = rows.column("doc_key").to_numpy(), 0
            for texts in slices(rows.column("text").to_pylist()):
                hashes, numbers, begin, end = runs(texts)
                held.append((hashes, ids[at + numbers], keys[at + numbers], begin << 32 | end))
                at += len(texts)
                if sum(len(h[0]) for h in held) >= BLOCK_RUNS:
                    yield reduced()
                    held.clear()
        if held:
            yield reduced()

    def repeats(batches):
        last = None
        for rows in batches:
            if not rows.num_rows:
                continue
            hashes = rows.column("hash").to_numpy()
            covered = rows.column("covered").to_numpy(zero_copy_only=False)
            again = np.concatenate([[last is not None and hashes[0] == last], hashes[1:] == hashes[:-1]])
            open_runs = ~covered
            again &= open_runs & np.concatenate([[last is not None], open_runs[:-1]])
            last = hashes[-1] if open_runs[-1] else None
            chosen = pa.array(covered | again)
            yield pa.RecordBatch.from_arrays([rows.column(c).filter(chosen) for c in _COVERS], names=list(_COVERS))

    texts = docs.select(F.col("_span_id").alias("doc_id"),
                        F.col("_span_key").alias("doc_key"), F.col("text").cast("string").alias("text"))
    dealt = (texts.mapInArrow(candidates, _RUN_SCHEMA).repartition("hash")
             .sortWithinPartitions("covered", "hash", "doc_id", "doc_key", "place"))
    return dealt.mapInArrow(repeats, "doc_id long, doc_key int, place long")


def without(text: str, covers: list[tuple[int, int]]) -> tuple[str, int]:
    """``text`` without the sentences of the given runs, and how many these are."""
    ends = sentences(text)
    gone = np.zeros(len(ends) + 1, dtype=np.int64)
    for begin, end in covers:
        gone[begin] += 1
        gone[end] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    starts = [0, *ends[:-1]]
    return "".join(text[a:b] for a, b, g in zip(starts, ends, gone.tolist()) if not g), int(gone.sum())


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the sentences removed that a repeated run covers, except in its first place.

    ``docs`` needs doc_id and text and keeps its columns and rows; text changes, n_chars follows it
    where it is there, and n_removed (sentences) is added. Order is by doc_id (null first), then by a
    hash of the text, then by place; repeated rows with one id and text count as one
    document and come back alike. Texts without repeats, null and empty ones stay as they are; an
    exact copy becomes empty. Runs shorter than ``RUN_WORDS`` words are never removed.
    """
    kept = docs.withColumn("_span_key", F.hash("text")).withColumn(
        "_span_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    covers = repeated_runs(kept.select("_span_id", "_span_key", "text")).groupBy("doc_id", "doc_key").agg(
        F.collect_set("place").alias("_span_covers"))  # no more than twice a text's sentences
    covers = covers.select(F.col("doc_id").alias("_span_id"), F.col("doc_key").alias("_span_key"), "_span_covers")
    joined = kept.join(covers, ["_span_id", "_span_key"], "left")
    columns = docs.columns
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)

    def rewrite(rows: pa.RecordBatch):
        texts = rows.column("text").to_pylist()
        removed = [0] * len(texts)
        covers = rows.column("_span_covers")
        for i in np.flatnonzero(covers.is_valid().to_numpy(zero_copy_only=False)).tolist():
            texts[i], removed[i] = without(texts[i], [(c >> 32, c & 0xFFFFFFFF) for c in covers[i].as_py()])
        arrays = [rows.column(c) if c != "text" else pa.array(texts, pa.string()) for c in columns]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(removed, pa.int64())], names=[*columns, "n_removed"])

    cleaned = map_batches(joined.select(*columns, "_span_covers"), rewrite, f"{schema}, n_removed long")
    if "n_chars" in columns:
        cleaned = cleaned.withColumn(
            "n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")))
    return cleaned
