"""SimHash components and sentence spans against brute force."""

import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from paritas.llm import near_copies as near
from paritas.llm import simhash_trie as trie
from paritas.llm import sentence_spans as spans
from paritas.llm.components import connected_components

from . import fixtures


def brute_fingerprint(text: str | None) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = ([" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4
                else [" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints) -> dict:
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [least.get(root(i)) for i in range(len(ids))]


def near_copies():
    base = fixtures.prose(5, 400)
    words = base.split()
    copies = [" ".join(words[:i * 17] + ["changed"] + words[i * 17 + 1:]) for i in range(20)]
    return [base, base, *copies, *(fixtures.prose(i, 60) for i in range(30))]


def test_near_duplicates_equal_brute_force(spark):
    docs = fixtures.awkward(spark).union(fixtures.documents(spark, near_copies(), start=100))
    rows = docs.collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    expected = sorted((str(r.doc_id), f"{p:016x}", str(c)) for r, p, c in
                      zip(rows, prints, brute_components([r.doc_id for r in rows], prints)))
    found = trie.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == expected
    assert len({e[2] for e in expected}) < len(expected) - 15


def test_near_duplicates_on_the_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    expected = dict(zip((r.doc_id for r in rows), brute_components([r.doc_id for r in rows], prints)))
    assert {r.doc_id: r.component_id for r in trie.near_duplicates(docs).collect()} == expected
    assert trie.near_duplicates(fixtures.empty(spark)).count() == 0


def random_prints(seed, n=400):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    parts = [base]
    for bits in (1, 2, 4, 5, 6):
        near = base[rng.integers(0, n, n // 2)].copy()
        for _ in range(bits):
            near ^= np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)
        parts.append(near)
    return np.unique(np.concatenate(parts))


@pytest.mark.parametrize("seed", range(4))
def test_trie_join_finds_exactly_the_close_pairs(seed):
    prints = random_prints(seed)
    n = len(prints)
    root, side = np.zeros(n, dtype=np.int64), np.full(n, 2)
    found = [p for i, j in trie.linked_pairs(root, side, prints) for p in zip(i.tolist(), j.tolist())]
    close = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= trie.MOST_BITS
    assert sorted(found) == [(i, j) for i, j in zip(*np.nonzero(np.triu(close, 1)))]


@pytest.mark.parametrize("limit", [60])
def test_large_roots_are_divided_without_loss(spark, monkeypatch, limit):
    monkeypatch.setattr(trie, "ROOT_LIMIT", limit)
    rng = np.random.default_rng(3)
    tight = np.uint64(0x1234_5678_9ABC_DEF0) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    tight ^= np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)
    prints = np.unique(np.concatenate([random_prints(9, 40), tight]))
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fingerprint long")
    edges = [(r.u, r.v) for r in trie.links(trie.divided(trie.roots(df))).collect()]
    place = {int(p): i for i, p in enumerate(prints.view(np.int64))}
    found, expected = trie.Forest(len(prints)), trie.Forest(len(prints))
    found.join(np.array([place[u] for u, _ in edges]), np.array([place[v] for _, v in edges]))
    expected.join(*np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= trie.MOST_BITS))
    assert (found.parent == expected.parent).all()


def brute_groups(docs) -> dict:
    """The smallest id that links of a Jaccard similarity of 0.8 over five words reach."""
    sets = {}
    for doc_id, text in docs:
        words = (text or "").lower().split()
        sets[doc_id] = {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}
    group = {i: i for i in sets}
    holders = {}
    for i in sorted(sets):
        shared = {}
        for s in sets[i]:
            for j in holders.setdefault(s, []):
                shared[j] = shared.get(j, 0) + 1
            holders[s].append(i)
        near_ones = {group[j] for j, n in shared.items() if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n)}
        if not sets[i]:
            near_ones = {group[j] for j in sets if j < i and not sets[j]}
        if near_ones:
            least = min(near_ones)
            group = {k: least if g in near_ones or k == i else g for k, g in group.items()}
    return group


def copies_at_many_similarities():
    """Texts of 200 words and copies with 1 to 6 changed words, at Jaccard 0.73 to 0.95; some link others."""
    texts = []
    for seed in range(12):
        words = fixtures.prose(700 + seed, 200).split()
        texts.append(" ".join(words))
        for changes in range(1, 7):
            changed = list(words)
            for c in range(changes):
                changed[20 + 30 * c + seed] = f"other{seed}x{changes}x{c}"
            texts.append(" ".join(changed))
    return texts


def test_stage_drops_copies_of_similarity_08(spark):
    texts = copies_at_many_similarities() + ["", None, "one", "One", "a b c d e f g h i", "a b c d e f g h i j"]
    group = brute_groups(list(enumerate(texts)))
    left = corpus_pipeline.drop_near_duplicates(spark, fixtures.documents(spark, texts), "").collect()
    assert sorted(r.doc_id for r in left) == sorted(set(group.values()))
    assert 12 < len(set(group.values())) < 40


def test_stage_keeps_different_texts_of_one_id(spark):
    one, two, three = (fixtures.prose(i, 60) for i in (801, 802, 803))
    rows = [(5, one), (5, two), (5, two), (3, one), (9, three), (9, three + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert left[:2] == [(3, one), (5, two)] and len(left) == 3 and left[2] in rows[4:]


def test_groups_on_the_test_table_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    group = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    found = {r.doc_id: r.component for r in near.near_copies(docs).collect()}
    least = {c: min(i for i in found if found[i] == c) for c in set(found.values())}
    assert {i: least[c] for i, c in found.items()} == group
    assert near.near_copies(fixtures.empty(spark)).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (200, 201), (201, 200)]
    found = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    expected = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)} | {200: 200, 201: 200}
    assert {r.node: r.component for r in found} == expected
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_removal(docs):
    """Texts in order of their ids with every run seen before removed."""
    seen, result = set(), {}
    for doc_id, text in docs:
        ends = spans.sentences(text)
        pieces = [text[a:b] for a, b in zip([0, *ends], ends)]
        words = [p.lower().split() for p in pieces]
        gone = [False] * len(pieces)
        runs = set()
        for i in range(len(pieces)):
            for j in range(i + spans.RUN_SENTENCES, len(pieces) + 1):
                if sum(map(len, words[i:j])) >= spans.RUN_WORDS:
                    runs.add((i, j))
                    break
        ended = {j for _, j in runs}
        for i in range(len(pieces)):
            for j in range(i + 1 - spans.RUN_SENTENCES, -1, -1):
                if i + 1 not in ended and sum(map(len, words[j:i + 1])) >= spans.RUN_WORDS:
                    runs.add((j, i + 1))
                    break
        for i, j in sorted(runs):
            key = tuple(" ".join(w) for w in words[i:j])
            if key in seen:
                gone[i:j] = [True] * (j - i)
            seen.add(key)
        result[doc_id] = "".join(p for p, g in zip(pieces, gone) if not g)
    return result


def passage_docs():
    passage = fixtures.prose(77, 60)
    wordy = " ".join(f"flow{i * i % 9973}x" for i in range(120))  # no full stop at all
    texts = [fixtures.prose(i, 90) for i in range(8)]
    texts[2] = f"{texts[2]}\n{passage}\n{fixtures.prose(40, 30)}"
    texts[5] = f"{fixtures.prose(41, 30)} {passage} {texts[5]}"
    texts[6] = f"{passage}"
    texts += [f"Intro words here {wordy} and then on", f"{fixtures.prose(50, 25)} {wordy}", texts[0], "", texts[1][:200]]
    return texts, passage, wordy


def test_repeats_are_removed_but_the_first(spark):
    texts, passage, wordy = passage_docs()
    docs = fixtures.documents(spark, texts)
    found = {r.doc_id: r for r in spans.remove_repeats(docs).collect()}
    assert {i: r.text for i, r in found.items()} == brute_removal(list(enumerate(texts)))
    assert passage in found[2].text and passage not in found[5].text and found[6].text == ""
    assert found[0].text == texts[0] and found[10].text == ""
    assert wordy in found[8].text and len(found[9].text) < len(texts[9]) - len(wordy) / 2
    assert all(found[i].text == texts[i] and found[i].n_removed == 0 for i in (0, 1, 2, 3, 4, 7, 8, 11))
    assert all(r.n_chars == len(r.text) for r in found.values())


@pytest.mark.parametrize("kind", ["prose", "tabs", "few words", "one word"])
def test_passages_inside_sentences_are_removed_at_any_offset(spark, kind):
    passage = {"prose": fixtures.prose(90, 51).replace(".", ""), "tabs": fixtures.prose(91, 51).replace(".", "").replace(" ", "\t"),
               "few words": " ".join("ab cd ef".split()[i * i % 7 % 3] for i in range(51)), "one word": "and " * 50 + "and"}[kind]
    gap = "\t" if kind == "tabs" else " "
    texts = []
    for i in range(30):
        before, after = (fixtures.prose(900 + 2 * i + k, 40).replace(".", "").split() for k in (0, 1))
        texts.append(gap.join([*before[:i], passage, *after[:30 - i]]) + ". " + fixtures.prose(990 + i, 12))
    found = {r.doc_id: r.text for r in spans.remove_repeats(fixtures.documents(spark, texts)).collect()}
    assert found[0] == texts[0] or kind in ("few words", "one word")
    for i in range(1, 30):
        kept = len(found[i].split()) - (len(texts[i].split()) - 51)
        assert kept <= 2 * spans.CUT_WINDOW, (i, found[i])


def test_repeats_of_awkward_rows(spark):
    docs = fixtures.awkward(spark)
    found = spans.remove_repeats(docs)
    assert found.columns == [*docs.columns, "n_removed"] and found.count() == docs.count()
    rows = {r.doc_id: r for r in found.collect()}
    assert rows[0].text is None and rows[3].text == "one" and rows[13].text == ""
    assert spans.remove_repeats(fixtures.empty(spark)).count() == 0


def test_small_blocks_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    found = {r.doc_id: r.text for r in spans.remove_repeats(docs.repartition(7)).collect()}
    assert found == brute_removal(texts)
