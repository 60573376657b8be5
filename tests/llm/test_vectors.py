"""Whitening and hard negatives against brute force."""

import numpy as np
import pytest

from paritas.llm import hard_negatives as hard
from paritas.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int, score int, slot string, x int, n string"


def vectors(seed=0, n=400, width=8):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=width).round(3).tolist(), int(rng.integers(0, 4)), 1, "s", 2, "n") for i in range(n)]
    nan, inf = float("nan"), float("inf")
    odd = [(1001, None, 1), (1002, [None] * width, 1), (1003, [nan] * width, 1), (1004, [inf] * width, 1), (1005, [], 1),
           (1006, [0.0] * width, None), (1100, [1.0] * (width + 1), 2), (None, [0.5] * width, 1), (1200, [0.0] * width, 1)]
    return rows + [(a, b, c, 1, "s", 2, "n") for a, b, c in odd]


def brute_negatives(rows):
    known = {}
    for vec_id, vector, label, *_ in rows:
        if (vec_id is None or label is None or not vector or len(vector) != 8
                or any(x is None or not np.isfinite(x) for x in vector)):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        known.setdefault(vec_id, []).append((label, [int(np.floor(256 * x)) for x in vector]))
    found = []
    for anchor in sorted(i for i in known if i % 100 == 0):
        label, own = min(known[anchor])
        scores = [(i, other, sum(a * b for a, b in zip(own, x))) for i, all_of in known.items() if i != anchor for other, x in all_of]
        best = lambda chosen, k: sorted(
            {i: max(s for j, _, s in chosen if j == i) for i, _, _ in chosen}.items(), key=lambda c: (-c[1], c[0]))[:k]
        for positive, p in best([s for s in scores if s[1] == label], 5):
            inside = [s for s in scores if s[1] != label and 30 * p <= 100 * s[2] <= 90 * p]
            found += [(anchor, positive, r, i, p, s) for r, (i, s) in enumerate(best(inside, 10), 1)]
    return sorted(found)


@pytest.mark.parametrize("repeated", [False, True])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, repeated):
    monkeypatch.setattr(hard, "ANCHOR_BLOCK", 2)
    monkeypatch.setattr(hard, "ROW_BLOCK", 100)
    rows = vectors()
    if repeated:  # equal rows, ties under other ids, and an id with several vectors
        rows += rows[:60] * 3 + [(5000 + i, rows[i % 7][1], i % 3, 1, "s", 2, "n") for i in range(90)] + [(100, rows[5][1], 0, 1, "s", 2, "n")]
    found = sorted(map(tuple, hard.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert found == brute_negatives(rows) and len(found) > 100


def test_hard_negatives_of_few_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert hard.hard_negatives(empty).columns == columns and hard.hard_negatives(empty).count() == 0
    rows = [(0, [1.0], 0), (1, [-1.0], 1), (2, [0.5], 1), (3, [1e30], 1), (100, [-2.0], 5)]
    found = hard.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert [tuple(r) for r in found] == [(0, 2, 1, 1, 1, 1)] or all(r.anchor_id in (0, 100) for r in found)


def test_products_beyond_doubles_are_exact():
    a, b = np.array([[1 << 30, 3]]), np.array([[(1 << 30) + 1, 5], [7, 1 << 29]])
    assert hard.inner_products(a, b).tolist() == [[(1 << 30) * ((1 << 30) + 1) + 15, 7 * (1 << 30) + 3 * (1 << 29)]]


def brute_whitened(rows, width):
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in r[1]] for r in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums)
    deviation = (centred ** 2).sum(axis=1).tolist()
    z = (centred / n).astype(np.float64)
    values, axes = np.linalg.eigh(z.T @ z / n)
    return deviation, z, values[::-1], axes[:, ::-1]


def usable(rows, width):
    return [r for r in rows if r[1] and len(r[1]) == width and all(x is not None and np.isfinite(x) for x in r[1])]


@pytest.mark.parametrize("seed, width", [(0, 8), (3, 40)])
def test_whitening_equals_a_dense_decomposition(spark, monkeypatch, seed, width):
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    rows = vectors(seed, 300, width)
    rows += rows[:20]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = whitening.whitened(df).toPandas()
    known = usable(rows, width)
    deviation, z, values, axes = brute_whitened(known, width)
    kept = min(32, width)
    assert len(found) == kept * len(known) and (found.n == len(known)).all()
    assert (found.identity_error < 1e-9).all() and found.identity_error.nunique() == 1
    key = lambda i, d: (-1 if i is None or i != i else int(i), d)
    mine = sorted(key(i, d) for i, d in zip(found[found.component == 1].vec_id, found[found.component == 1].deviation))
    assert mine == sorted(key(r[0], d) for r, d in zip(known, deviation))
    share = found.groupby("component").explained.first()
    assert np.allclose(share, values[:kept] / values.sum(), rtol=1e-10)
    one = found[(found.vec_id >= 25) & (found.vec_id < 60)].pivot(index="vec_id", columns="component", values="whitened")
    places = [next(k for k, r in enumerate(known) if r[0] == i) for i in one.index]
    expected = z[places] @ axes[:, :kept] / np.sqrt(values[:kept])
    assert np.allclose(np.abs(one.values), np.abs(expected), atol=1e-8)


def test_rank_one_updates_with_ties_and_zeros():
    rng = np.random.default_rng(1)
    for n, width in ((60, 12), (3, 12), (1, 1), (20, 5)):
        rows = rng.normal(size=(n, width))
        if width == 12:
            rows[:, 3], rows[:, 5] = rows[:, 2], 0
            rows[n // 2:] = rows[:n - n // 2]  # repeated rows
        values, axes = whitening.empty_spectrum(width)
        for row in rows:
            values, axes = whitening.rank_one(values, axes, row)
        assert np.allclose(axes.T @ axes, np.eye(width), atol=1e-12)
        assert np.allclose(axes * values @ axes.T, rows.T @ rows, atol=1e-11 * (rows ** 2).sum())
    same = whitening.rank_one(values, axes, np.zeros(width))
    assert np.array_equal(same[0], values)


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 4, schema)).count() == 0, "no spread, no component"
    found = whitening.whitened(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (None, [2.0, 1.0]), (4, None)], schema)).collect()
    assert sorted(round(r.whitened, 6) ** 2 for r in found) == pytest.approx([0, 1.5, 1.5], abs=1e-5)
    assert [r.component for r in found] == [1] * 3 and all(r.explained == pytest.approx(1) for r in found)
    large = whitening.whitened(spark.createDataFrame([(1, [float(2 ** 50)]), (2, [0.0])], schema)).collect()
    assert [r.deviation for r in large] == [None, None] and [abs(r.whitened) for r in large] == pytest.approx([1, 1])
