"""Embedding links against all pairs."""

from __future__ import annotations

from collections import Counter

import brute
import numpy as np
import pytest

from tickloom.llm import subspaces

LAYOUT = "vec_id long, embedding array<float>, label int, class string, block int, links long"


def plain(rows: list[tuple], cosine: float = 0.9) -> Counter:
    """vec_id, n_links, component_id, kept."""
    ids = [brute.LAST if k is None else k for k, _ in rows]
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    links, parent = [set() for _ in rows], {k: k for k in ids}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    vectors = [np.float32(v).astype(float) if good else None for (_, v), good in zip(rows, ok)]
    for i in range(len(rows)):
        for j in range(i):
            x, y = vectors[i], vectors[j]
            if ok[i] and ok[j] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[i].add(j)
                links[j].add(i)
                a, b = sorted((root(ids[i]), root(ids[j])))
                parent[b] = a
    hide = lambda k: None if k == brute.LAST else k
    return Counter((hide(k), len(n), hide(root(k) if good else k), (root(k) if good else k) == k) for k, n, good in zip(ids, links, ok))


def cloud(seed: int, n: int, dims: int = 64) -> list[tuple]:
    """Unlike vectors, exact and scaled copies, a tight group, chains of neighbours, pairs just above and below 0.9."""
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dims))
    out = [*base]
    out += [base[3]] * 5 + [base[3] * 1e-3, -base[3], base[4] * 1e30]
    out += [base[7] + r.normal(size=dims) * 0.1 for _ in range(40)]
    step = base[9]
    for _ in range(15):
        step = step / np.linalg.norm(step) + r.normal(size=dims) * 0.4 / np.sqrt(dims)
        out.append(step)
    for i in range(30):
        x = base[10 + i] / np.linalg.norm(base[10 + i])
        y = r.normal(size=dims)
        y -= (y @ x) * x
        c = 0.9 + (i - 15) * 1e-4
        out.append(c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y))
    order = r.permutation(len(out))
    return [(int(k), [float(c) for c in np.float32(v)]) for k, v in zip(order, out)]


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 0, "x", 1, 2) for k, v in rows], LAYOUT).repartition(3)


NAMES = ["vec_id", "n_links", "component_id", "kept"]


@pytest.mark.parametrize("dims,cell", [(64, 65_536), (64, 40), (40, 60), (3, 30)])
def test_equals_all_pairs(spark, dims, cell):
    rows = cloud(dims, 120, dims)
    assert brute.keyed(subspaces.near_vectors(frame(spark, rows), cell=cell).collect(), *NAMES) == plain(rows)


def test_unusable_vectors_repeated_rows_and_lengths(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.1]
    rows = [(1, None), (2, []), (3, [0.0] * 4), (4, [1.0, None, 2.0, 3.0]), (5, [float("nan"), 1.0, 2.0, 3.0]), (6, [float("inf")] * 4)]
    rows += [(9, a), (8, b), (9, a), (None, a), (11, a[:3]), (12, [2 * x for x in a[:3]]), (13, [5.0]), (14, [-2.0]), (15, [3.0])]
    assert brute.keyed(subspaces.near_vectors(frame(spark, rows)).collect(), *NAMES) == plain(rows)
    assert subspaces.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_one_id_with_two_vectors_is_one_component(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [0.0, 1.0]), (3, [1.0, 0.01])]
    assert {(r.vec_id, r.component_id) for r in subspaces.near_vectors(frame(spark, rows)).collect()} == {(3, 3), (5, 3), (7, 3)}


def test_dense_and_sparse_ways_agree():
    """A tight group counts through matrices, the same pairs one by one give the same."""
    rows = [v for _, v in cloud(5, 60)]
    raw = [np.float64(np.float32(v)).tobytes() for v in rows]
    import pyarrow as pa

    total = np.zeros((2, len(rows)))
    for way in (0, 1):
        for block in range(4):
            n = len(rows)
            table = pa.table({"dims": [64] * n, "block": [block] * n, "low": [0] * n, "high": [0] * n, "first": [True] * n,
                              "class": list(range(n)), "copies": [1] * n, "vector": raw})
            meeting = subspaces._Meeting(table, 0.9)
            if way:
                meeting.meet(slab=256)
            else:
                i, j = np.triu_indices(n, 1)
                meeting._exact(i, j)
            total[way] += meeting.links
    assert (total[0] == total[1]).all() and total[0].sum() > 1000


def test_rotation_keeps_products_and_bits():
    x = np.random.default_rng(1).normal(size=(50, 24))
    y = subspaces.rotated(x)
    assert np.allclose(x @ x.T, y @ y.T) and (subspaces.rotated(x[7:8]) == y[7:8]).all()


def test_cells_hold_every_neighbour():
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 4)) / 4
    cells = subspaces.Cells(x[:100], 4)
    own, near = cells.near(x, 0.02)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= 0.02
    i, j = np.nonzero(d)
    assert near[np.arange(400), own].all() and near[i, own[j]].all() and near.mean() < 0.9
