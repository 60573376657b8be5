"""Token counts, ORC files and packing against the libraries themselves."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paritas.llm import orc_ids, packing
from paritas.llm.common import DEFAULT_BPE, vocabulary_path
from paritas.llm.token_counts import count_tokens, with_token_counts
from paritas.llm.tokens import TokenCounter, WordBpe, load, slices, whole_tokens
from paritas.session import scratch_path

from . import fixtures

BYTES = "byte_bpe_50k.json"


def expected_ids(texts):
    found = load(vocabulary_path(DEFAULT_BPE)).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array(e.ids + [2], dtype="<u4") for e in found]


def corpus_texts(spark, name="documents", column="text"):
    return [r[0] for r in spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").select(column).collect()]


def test_word_encoder_equals_library(spark):
    texts = [t or "" for t in fixtures.awkward_texts()] + corpus_texts(spark)
    texts += [chr(c) + "a" + chr(c) + "1" + chr(c) for c in range(0x20, 0x250)]
    coder = WordBpe(vocabulary_path(DEFAULT_BPE), cache_words=500)
    found = [i for part in slices(texts, 5000) for i in coder.encode(part)]
    expected = coder.library.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(f, coder.dtype).tolist() for f in found] == [e.ids for e in expected]


def test_counter_equals_library(spark):
    path = vocabulary_path(BYTES)
    texts = [t or "" for t in fixtures.awkward_texts()] + corpus_texts(spark) + corpus_texts(spark, "pages", "html")
    texts += [chr(c) + "a " + chr(c) + "1" + chr(c) * 2 + " " + chr(c) for c in range(0x00, 0x250)]
    texts += ["a  b", "a \nb", "\n\n a\n", " x <|endoftext|>y", "a b 　 c"]
    counter = TokenCounter(path, whole_tokens(path), cache_words=500)
    found = [n for part in slices(texts, 5000) for n in counter.count(part)]
    assert found == [len(e.ids) for e in counter.library.encode_batch(texts, add_special_tokens=False)]


def test_whole_tokens_are_single():
    path = vocabulary_path(BYTES)
    tokenizer, whole = load(path), whole_tokens(path)
    some = sorted(whole)[::97]
    assert all(len(tokenizer.encode(t, add_special_tokens=False).ids) == 1 for t in some)
    assert "<|endoftext|>" not in whole and " the" in whole


def test_count_tokens_of_awkward_rows(spark):
    docs = fixtures.awkward(spark)
    found = count_tokens(docs, vocabulary_path(BYTES), limit=100).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    tokenizer = load(vocabulary_path(BYTES))
    assert len(found) == docs.count()
    for r in found:
        text = texts[r.doc_id] or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 100)
    assert count_tokens(fixtures.empty(spark), vocabulary_path(BYTES)).count() == 0
    more = with_token_counts(docs, vocabulary_path(BYTES), "n")
    assert more.columns == [*docs.columns, "n"] and more.where("n is null").count() == 0


def test_orc_round_trip(spark):
    docs = fixtures.awkward(spark)
    path = scratch_path(spark, "orc-test")
    orc_ids.write_ids(docs, path, vocabulary_path(DEFAULT_BPE), index_rows=1000)
    rows = orc_ids.read_ids(spark, path).orderBy("part", "row").collect()
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i) and len(ids) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    expected = dict(zip(texts, expected_ids(texts.values())))
    assert all(r.ids == expected[r.doc_id].tolist() and r.n_tokens == len(r.ids) for r in rows)
    start = 0
    digests = orc_ids.id_digests(spark, path).orderBy("start").collect()
    for r in digests:
        assert (r.start, r.ids_crc32) == (start, zlib.crc32(expected[r.doc_id].tobytes()))
        start += r.n_tokens
    assert len(digests) == len(rows)


def test_orc_reads_wanted_documents_only(spark):
    path = scratch_path(spark, "orc-prune")
    orc_ids.write_ids(fixtures.documents(spark, [f"text {i}" for i in range(3000)]), path, vocabulary_path(DEFAULT_BPE))
    wanted = orc_ids.read_ids(spark, path, [5, 2999, 10_000])
    assert sorted(r.doc_id for r in wanted.collect()) == [5, 2999]
    assert "PushedFilters: [In(doc_id" in wanted._jdf.queryExecution().toString()


def test_orc_of_nothing(spark):
    assert orc_ids.encode_to_orc(fixtures.empty(spark), vocabulary_path(DEFAULT_BPE)).count() == 0


def check_pieces(pieces, texts):
    """Every id in one piece, sequences gapless, full or a power of two."""
    expected = dict(zip(texts, expected_ids(texts.values())))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert by_doc.keys() == texts.keys()
    for doc_id, own in by_doc.items():
        ids, at = expected[doc_id], 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == packing.WINDOW or at & (at - 1) == 0 and at < packing.WINDOW


def test_packing_keeps_every_token(spark):
    docs = fixtures.documents(spark, fixtures.awkward_texts() + [fixtures.prose(i) for i in range(60)])
    pieces = packing.pack_documents(docs, vocabulary_path(DEFAULT_BPE)).collect()
    check_pieces(pieces, {r.doc_id: r.text for r in docs.collect()})


def test_packing_of_repeated_and_missing_rows(spark):
    docs = fixtures.awkward(spark)
    pieces = packing.pack_documents(docs, vocabulary_path(DEFAULT_BPE))
    total = sum(len(i) for i in expected_ids([r.text for r in docs.collect()]))
    assert pieces.agg(F.sum("length")).first()[0] == total
    assert packing.pack_documents(fixtures.empty(spark), vocabulary_path(DEFAULT_BPE)).count() == 0


def test_packing_over_several_shards(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = packing.pack_documents(docs, vocabulary_path(DEFAULT_BPE)).collect()
    check_pieces(pieces, {r.doc_id: r.text for r in docs.collect()})


def test_neighbours_are_the_best_of_bm25(monkeypatch):
    monkeypatch.setattr(packing, "QUERY_TOKENS", 1000)
    rng = np.random.default_rng(0)
    ids = [np.concatenate([rng.integers(0, 50, 40), np.full(5, 100 + i % 4)]).astype(np.uint16) for i in range(24)]
    df = np.bincount(np.concatenate([np.unique(i) for i in ids]), minlength=200)
    idf = np.log1p((24 - df + 0.5) / (df + 0.5)).astype(np.float32)
    shard = packing.Shard(ids, list(range(24)), idf, 45.0)
    shard.unused[[0, 7]] = False
    near = shard.neighbours(0).tolist()
    scores = brute_bm25(ids, idf, 45.0, ids[0])
    best = sorted((i for i in range(24) if i not in (0, 7)), key=lambda i: -scores[i])[:packing.NEIGHBOURS]
    assert near == best


def brute_bm25(ids, idf, mean, query):
    tokens = sorted(set(query.tolist()), key=lambda t: -idf[t])[:packing.QUERY_TOKENS]
    scores = []
    for doc in ids:
        norm = packing.K1 * (1 - packing.B + packing.B * len(doc) / mean)
        tf = [(doc == t).sum() for t in tokens]
        scores.append(sum(idf[t] * f * (packing.K1 + 1) / (f + norm) for t, f in zip(tokens, tf) if f))
    return scores
