"""The k-means tree and its search against the cosines of all pairs."""

import numpy as np
import pytest

from cardwright.llm import nearest as module
from cardwright.llm.nearest import Tree, nearest

ROW = "vec_id long, embedding array<float>"
ASKED = "vec_id % 50 = 0"


def brute(rows, k=5):
    """query: [(id, score)], of all others; rows that share an id count with their first vector."""
    kept = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            kept[i] = min(kept.get(i, v), v)
    lengths = [len(v) for v in kept.values()]
    most = min(set(lengths), key=lambda n: (-lengths.count(n), n)) if lengths else 0
    kept = {i: np.array(v, np.float32).astype(float) for i, v in kept.items() if len(v) == most}
    ids, x = np.array(sorted(kept)), np.array([kept[i] for i in sorted(kept)])
    out = {}
    for q in ids[ids % 50 == 0].tolist():
        y = kept[q]
        score = x @ y / np.sqrt((x * x).sum(1) * (y @ y))
        order = [j for j in np.lexsort((ids, -np.round(score, 12))) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def checked(found, rows, k=5):
    """The share of true neighbours found; every row told is well-formed and its score right."""
    want, got = brute(rows, k), {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {q for q, near in want.items() if near}
    hit = 0
    for q, near in got.items():
        near.sort()
        assert [r for r, _, _ in near] == list(range(1, len(want[q]) + 1)) and len({i for _, i, _ in near}) == len(near) and q not in {i for _, i, _ in near}
        assert all((a[2], -a[1]) > (b[2], -b[1]) for a, b in zip(near, near[1:], strict=False))
        hit += len({i for _, i, _ in near} & {i for i, _ in want[q]})
        known = dict(want[q])
        assert all(abs(s - known[i]) < 1e-12 for _, i, s in near if i in known)
    return hit / max(1, sum(map(len, want.values())))


def vectors(n, dims=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    x = np.where(rng.random((n, 1)) < 0.5, centres[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, dims)), rng.normal(size=(n, dims)))
    return [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]


def test_recall_and_scores(spark):
    rows = vectors(4000)
    assert checked(nearest(spark.createDataFrame(rows, ROW), ASKED), rows) >= 0.93


def test_hot_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 40)
    monkeypatch.setattr(module, "ASKED", 5)
    rows = vectors(1500)
    rng = np.random.default_rng(5)
    for i in range(0, 1500, 3):  # a third is nearly the same, a part of it exactly
        rows[i] = (i, rows[0][1] if i % 2 else [float(np.float32(v + 0.001 * rng.normal())) for v in rows[0][1]])
    assert checked(nearest(spark.createDataFrame(rows, ROW), ASKED), rows) >= 0.9


def test_copies_go_by_id(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 120)] + [(200, [2.0, 4.0, 6.0]), (300, [0.0, 0.0, 1.0])]
    found = nearest(spark.createDataFrame(rows, ROW), ASKED)
    near = {}
    for r in found.orderBy("rank").collect():
        near.setdefault(r.query_id, []).append(r.vec_id)
    assert near == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 100: [0, 1, 2, 3, 4], 200: [0, 1, 2, 3, 4], 300: [0, 1, 2, 3, 4]}


def test_rows_without_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(300, 4)
    odd = [(50, None), (100, [0.0] * 4), (150, [1.0, nan, 0.0, 0.0]), (200, [1.0, inf, 0.0, 0.0]), (400, [1.0, None, 2.0, 3.0]), (None, [1.0] * 4), (450, []), (500, [1.0, 2.0]), (600, [1.0, -0.0, 0.0, 0.0]), (601, [1e-38, 0.0, 0.0, 0.0]), (650, [3e38, 3e38, 0.0, 0.0])]
    rows = [r for r in rows if r[0] not in (50, 100, 150, 200)] + odd + [rows[7], rows[7], (9, [9.0, 9.0, 9.0, 9.0]), (250, [5.0, 1.0, 1.0, 1.0])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], ROW + ", class string, leaf int")
    assert checked(nearest(table, ASKED, recall=1.0), rows) >= 0.99


@pytest.mark.parametrize("rows", [[], [(1, [1.0])], [(50, None)], [(50, [1.0, 2.0])], [(50, [1.0, 2.0]), (51, [2.0, 1.0])]])
def test_small_tables(spark, rows):
    assert checked(nearest(spark.createDataFrame(rows, ROW), ASKED), rows) in (0, 1)


def test_best_bin_first_reaches_every_leaf():
    x = np.array([v for _, v in vectors(800)])
    tree = Tree(x, 30)
    assert tree.n_leaves == 30 and set(tree.assign(x).tolist()) <= set(range(30))
    order = tree.visits(x[5], 30)
    assert sorted(order) == list(range(30)) and tree.visits(x[5], 7) == order[:7]
    same = np.mean([tree.visits(v, 1)[0] == leaf for v, leaf in zip(x, tree.assign(x), strict=True)])
    assert same > 0.5 and Tree(np.ones((50, 3)), 8).n_leaves == 1
