"""The similarity join against brute force."""

import random

import pytest

from paritas.llm import jaccard_join as join

from . import fixtures


def brute_grams(text, words):
    found = (text or "").encode().lower().split()
    return {b" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def brute(rows, words, least):
    """(doc_id, size, component) of each row."""
    sets = [brute_grams(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and least[1] * both >= least[0] * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[root(i)] = min(doc_id, ids.get(root(i), doc_id))
    return sorted(((d, len(s), ids.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def varied(seed, n, length, edits):
    """Copies of one text with up to ``edits`` words changed, cut off or put in."""
    rng = random.Random(seed)
    base = fixtures.prose(seed, length).split()
    texts = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(words))
            words[at:at + rng.randint(0, 2)] = [rng.choice(["new", "other", f"w{rng.randrange(10 ** 6)}"])] * rng.randint(0, 2)
        texts.append(" ".join(words[rng.choice([0, 0, 0, 3, 12]):]))
    return texts


@pytest.mark.parametrize("words, least", [(4, (85, 100)), (5, (4, 5)), (2, (1, 2)), (1, (9, 10))])
def test_components_equal_brute_force(spark, words, least):
    texts = [*varied(1, 60, 140, 9), *varied(2, 40, 12, 2), *varied(3, 30, 7, 1), *varied(4, 20, 900, 40),
             *(fixtures.prose(i, 30) for i in range(20)), *(" ".join("abcdefgh"[:n]) for n in range(1, 9))]
    docs = fixtures.awkward(spark).union(fixtures.documents(spark, texts, start=1000))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = sorted(map(tuple, join.jaccard_components(docs, words, least).collect()), key=str)
    assert found == brute(rows, words, least)


def test_components_of_an_empty_table(spark):
    assert join.jaccard_components(fixtures.empty(spark)).columns == ["doc_id", "n_shingles", "component_id"]
    assert join.jaccard_components(fixtures.empty(spark)).count() == 0
    assert sorted(join.jaccard_components(fixtures.documents(spark, [None, "", " "])).collect()) == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]


def test_overlaps_are_summed_over_fragments(spark, monkeypatch):
    monkeypatch.setattr(join, "COUNTED", 64)
    texts = [*varied(4, 12, 700, 40), *varied(5, 12, 60, 4)]
    docs = fixtures.documents(spark, texts)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, join.jaccard_components(docs, 4, (85, 100)).collect()), key=str) == brute(rows, 4, (85, 100))


def test_similar_sets_share_a_key():
    rng = random.Random(7)
    least = (85, 100)
    import numpy as np

    for _ in range(3000):
        size = rng.choice([6, 7, 9, 14, 40, 150, 400])
        a = {rng.getrandbits(64) for _ in range(size)}
        b = set(a)
        for _ in range(rng.randrange(0, size // 6 + 2)):
            if rng.random() < 0.5 and len(b) > 1:
                b.discard(rng.choice(sorted(b)))
            else:
                b.add(rng.getrandbits(64))
        if a == b or 100 * len(a & b) < 85 * len(a | b):
            continue
        one, two = (np.array(sorted(s), dtype=np.uint64) for s in (a, b))
        kind = int(np.searchsorted(join.classes(least)[0], max(len(a), len(b)), "right") - 1)
        keys, need = zip(*((set(k[0].tolist()), n[0]) for k, n in (join.segment_keys([s], np.array([kind]), least) for s in (one, two))))
        assert len(keys[0] & keys[1]) >= max(need) >= 1, (len(a), len(b))


def test_a_large_group_makes_few_pairs(spark, monkeypatch):
    """Copies of one text that are mostly too far from each other: pairs held against each other grow with the
    group, not with its square."""
    made = []
    kept = join.similar_pairs
    monkeypatch.setattr(join, "similar_pairs", lambda pairs, *a: (made.append(pairs.count()), kept(pairs, *a))[1])
    for n in (300, 1200):
        join.jaccard_components(fixtures.documents(spark, varied(9, n, 140, 8)), 4, (85, 100)).count()
        made.append(None)
    at = made.index(None)
    small, large = sum(made[:at]), sum(made[at + 1:-1])
    assert large < 8 * small and large < 20 * 1200, (small, large)
