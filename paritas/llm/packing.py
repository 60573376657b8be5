"""Sequences of documents that belong together, by lexical retrieval.

Documents are dealt into shards in the order of a sketch of their rarer tokens. Each shard has a
BM25 inverted index; from a seed document the window is filled with its nearest unused neighbours,
and where the last one has to be cut, its rest is the next seed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_batches, settled
from .orc_ids import encoder
from .tokens import slices

WINDOW = 4096
#: Tokens of a shard, the unit of one index; a task packs one shard after the other.
SHARD_TOKENS = 4_000_000
SHARD_DOCUMENTS = 60_000
#: BM25's parameters, and the rarest tokens of a seed that make up its query.
K1, B, QUERY_TOKENS = 1.2, 0.75, 24
#: Neighbours taken from one search before the next one is made.
NEIGHBOURS = 16
#: Tokens of earlier merges than these are too common for the sketch.
SKETCH_FROM = 2000

_TOKENS = {"doc_id": pa.int64(), "sketch": pa.int64(), "n": pa.int64(), "ids": pa.binary()}
_DF = {"token": pa.int32(), "n": pa.int64()}
_PIECES = {name: pa.int64() for name in
           ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}


def _sketch_ranks(size: int) -> list[np.ndarray]:
    rng = np.random.default_rng(7)
    ranks = []
    for _ in range(3):
        rank = rng.permutation(size).astype(np.int64) & 0xFFFF
        rank[:SKETCH_FROM] = 0xFFFF
        ranks.append(rank)
    return ranks


def tokenized(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, sketch, number and bytes of the ids (``end_id`` last) of every whole text."""

    def run(rows: pa.RecordBatch):
        bpe, at = encoder(vocabulary), 0
        ranks = _sketch_ranks(len(bpe._ends))
        end = np.array([end_id], dtype=bpe.dtype).tobytes()
        for texts in slices(rows.column("text").to_pylist()):
            coded = [ids + end for ids in bpe.encode(texts)]
            sketches = []
            for data in coded:
                ids = np.frombuffer(data, dtype=bpe.dtype)
                a, b, c = (int(rank[ids].min()) for rank in ranks)
                sketches.append(a << 32 | b << 16 | c)
            yield batch(_TOKENS, doc_id=rows.column("doc_id").slice(at, len(texts)), sketch=sketches,
                        n=[len(b) // bpe.dtype.itemsize for b in coded], ids=coded)
            at += len(texts)

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                   F.col("text").cast("string").alias("text")),
                       run, "doc_id long, sketch long, n long, ids binary")


def _document_tokens(ids: list[np.ndarray]) -> np.ndarray:
    """Sorted ``token << 32 | document`` of all tokens of all documents."""
    owner = np.repeat(np.arange(len(ids), dtype=np.uint64), [len(i) for i in ids])
    keys = np.concatenate(ids).astype(np.uint64) << np.uint64(32) | owner
    keys.sort()
    return keys


def document_frequencies(tokens: DataFrame, dtype: np.dtype) -> dict[int, int]:
    """Documents with each token, and at -1 all documents, at -2 all tokens. As many rows as the
    vocabulary has tokens come to the driver, whatever the size of the corpus."""

    def run(rows: pa.RecordBatch):
        ids = [np.frombuffer(b, dtype=dtype) for b in rows.column("ids").to_pylist()]
        found: dict[int, int] = {-1: len(ids), -2: sum(map(len, ids))}
        total = np.zeros(np.iinfo(dtype).max + 1 if dtype.itemsize == 2 else 1 << 20, dtype=np.int64)
        for i in range(0, len(ids), 1000):
            keys = _document_tokens(ids[i:i + 1000])
            first = np.concatenate([[True], keys[1:] != keys[:-1]])
            part = np.bincount((keys[first] >> np.uint64(32)).astype(np.int64))
            total[:len(part)] += part
        found |= {int(t): int(total[t]) for t in np.flatnonzero(total)}
        yield batch(_DF, token=list(found), n=list(found.values()))

    counts = map_batches(tokens.select("ids"), run, "token int, n long")
    return {r.token: r.n for r in counts.groupBy("token").agg(F.sum("n").alias("n")).collect()}


class Shard:
    """An inverted index of some documents and what of them is not packed yet."""

    def __init__(self, ids: list[np.ndarray], names: list, idf: np.ndarray, mean_length: float):
        self.ids = ids
        self.names = names
        self.idf = idf
        n = len(ids)
        keys = _document_tokens(ids)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.append(first, len(keys))).astype(np.float32)
        keys = keys[first]
        tokens = (keys >> np.uint64(32)).astype(np.int64)
        self.documents = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.offsets = np.searchsorted(tokens, np.arange(len(idf) + 1))
        lengths = np.array([len(i) for i in ids], dtype=np.float32)
        norm = K1 * (1 - B + B * lengths / max(mean_length, 1.0))
        self.weights = idf[tokens] * counts * (K1 + 1) / (counts + norm[self.documents])
        self.unused = np.ones(n, dtype=bool)
        self._next = 0

    def first_unused(self) -> int | None:
        while self._next < len(self.ids) and not self.unused[self._next]:
            self._next += 1
        return self._next if self._next < len(self.ids) else None

    def neighbours(self, seed: int) -> np.ndarray:
        """The best unused documents for the seed's rarest tokens, best first; ties in shard order."""
        tokens = np.unique(self.ids[seed])
        shared = self.offsets[tokens + 1] - self.offsets[tokens] > 1
        tokens = tokens[shared]
        if len(tokens) > QUERY_TOKENS:
            tokens = tokens[np.argpartition(-self.idf[tokens], QUERY_TOKENS)[:QUERY_TOKENS]]
        if not len(tokens):
            return np.zeros(0, dtype=np.int64)
        ranges = [slice(a, b) for a, b in zip(self.offsets[tokens].tolist(), self.offsets[tokens + 1].tolist())]
        scores = np.bincount(np.concatenate([self.documents[r] for r in ranges]),
                             weights=np.concatenate([self.weights[r] for r in ranges]),
                             minlength=len(self.ids))
        scores[~self.unused] = 0
        best = (np.argpartition(-scores, NEIGHBOURS)[:NEIGHBOURS] if len(scores) > NEIGHBOURS
                else np.arange(len(scores)))
        best = best[scores[best] > 0]
        return best[np.lexsort((best, -scores[best]))]

    def pack(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, start, length, sequence, offset) of all pieces; each sequence is full, but for
        the last tokens of the shard, whose sequences are powers of two."""
        sequence, filled = 0, 0
        waiting: list[int] = []
        held: list[list[int]] = []
        inside: set = set()  # ids in the window: a repeated document goes elsewhere if another one fits
        document = self.first_unused()
        while document is not None:
            self.unused[document] = False
            inside.add(self.names[document])
            start, size = 0, len(self.ids[document])
            while start < size:
                length = min(size - start, WINDOW - filled)
                held.append([document, start, length, sequence, filled])
                start, filled = start + length, filled + length
                if filled == WINDOW:
                    yield from map(tuple, held)
                    held.clear()
                    sequence, filled = sequence + 1, 0
                    waiting, inside = [], {self.names[document]}
            while waiting and not self.unused[waiting[-1]]:
                waiting.pop()
            if not waiting:
                # a new window's seed is the document whose rest begins it, or the next one in order
                waiting = [d for d in self.neighbours(document)[::-1].tolist() if self.names[d] not in inside]
            document = waiting.pop() if waiting else self.first_unused()
        yield from _in_powers(held, sequence, filled)


def _in_powers(held: list[list[int]], sequence: int, filled: int) -> Iterator[tuple[int, int, int, int, int]]:
    """The pieces of an unfinished window, cut again into sequences whose lengths are powers of two."""
    room, at = 0, 0
    for document, start, length, _, _ in held:
        while length:
            if not room:
                room, at = 1 << (filled.bit_length() - 1), 0
            part = min(length, room)
            yield document, start, part, sequence, at
            start, length, room, at, filled = start + part, length - part, room - part, at + part, filled - part
            if not room:
                sequence += 1


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text) in sequences of at most ``WINDOW`` tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; every id of every row
    lies in exactly one piece. A null text has the end id only; repeated rows are packed each; no
    rows give no pieces. Sequences are full except for at most twelve at the end of a shard, whose
    lengths are powers of two, so nothing is padded. sequence_id is the task's number times 2^32 and
    a count.
    """
    tokens = settled(tokenized(docs, vocabulary, end_id), "packing-tokens")
    dtype = encoder(vocabulary).dtype
    found = document_frequencies(tokens, dtype)
    n_docs, n_tokens = found.pop(-1, 0), found.pop(-2, 0)
    idf = np.zeros(len(encoder(vocabulary)._ends) + 1, dtype=np.float32)
    for token, n in found.items():
        idf[token] = np.log1p((n_docs - n + 0.5) / (n + 0.5))
    shared = docs.sparkSession.sparkContext.broadcast((idf, n_tokens / max(n_docs, 1)))
    order = ["sketch", "_tie"]
    dealt = (tokens.withColumn("_tie", F.xxhash64("doc_id")).repartitionByRange(*order)
             .sortWithinPartitions(*order, "doc_id", "n", "ids"))

    def run(batches):
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 32
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        size = 0

        def packed():
            nonlocal sequence
            shard = Shard(ids, doc_ids, *shared.value)
            rows = list(shard.pack())
            documents, start, length, number, offset = (np.array(c, dtype=np.int64) for c in zip(*rows))
            crc = [zlib.crc32(ids[d][a:a + n].astype("<u4").tobytes())
                   for d, a, n in zip(documents.tolist(), start.tolist(), length.tolist())]
            done = batch(_PIECES, doc_id=[doc_ids[d] for d in documents.tolist()], start=start, length=length,
                         ids_crc32=crc, doc_tokens=[len(ids[d]) for d in documents.tolist()],
                         sequence_id=sequence + number, offset=offset)
            sequence += int(number.max()) + 1
            return done

        for rows in batches:
            for doc_id, data in zip(rows.column("doc_id").to_pylist(), rows.column("ids").to_pylist()):
                doc_ids.append(doc_id)
                ids.append(np.frombuffer(data, dtype=dtype))
                size += len(ids[-1])
                if size >= SHARD_TOKENS or len(ids) >= SHARD_DOCUMENTS:
                    yield packed()
                    doc_ids.clear()
                    ids.clear()
                    size = 0
        if ids:
            yield packed()

    return dealt.select("doc_id", "ids").mapInArrow(
        run, ", ".join(f"{name} long" for name in _PIECES))
