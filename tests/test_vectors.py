"""Blocked products, silhouettes and bounded heaps against plain numpy, in one pass and in many."""

import numpy as np
import pytest

from textmill.operators import vectors


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5)], "abcd"[i % 3] if i else "one") for i in range(200)]  # many ties; a label of one
    odd = [(900, None, "a"), (901, [1.0, 2.0], "a"), (902, [1.0, None, 0.0, 0.0, 0.0], "a"), (None, [1.0] * 5, "a"), (903, [1.0] * 5, None)]
    return rows, spark.createDataFrame(rows + odd, "id long, v array<double>, label string").repartition(5)


@pytest.mark.parametrize("cells", [1 << 22, 30])
def test_nearest(points, cells):
    rows, df = points
    kept = rows + [(903, [1.0] * 5, None)]
    got = {}
    for r in vectors.nearest(df.where("id % 20 = 0"), df, "id", "v", 7, cells).collect():
        got.setdefault(r.query, []).append((r["rank"], r.neighbour, r.similarity))
    for i, v, _ in rows:
        if i % 20 == 0:
            scored = sorted((-float(np.dot(v, w)), j) for j, w, _ in kept if j != i)[:7]
            assert sorted(got.pop(i)) == [(n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    assert got == {} and vectors.nearest(df.limit(0), df, "id", "v", 3).count() == 0


@pytest.mark.parametrize("cells", [1 << 22, 12])
def test_silhouettes(points, cells):
    rows, df = points
    data, names = np.array([v for _, v, _ in rows]), np.array([c for *_, c in rows])
    far = ((data[:, None] - data[None]) ** 2).sum(2)
    got = {r.id: r.silhouette for r in vectors.silhouettes(df, "id", "v", "label", cells).collect()}
    assert len(got) == len(rows)
    for i, (k, _, name) in enumerate(rows):
        same = (names == name) & (np.arange(len(rows)) != i)
        a = far[i, same].mean() if same.any() else None
        b = min(far[i, names == other].mean() for other in set(names) - {name})
        assert got[k] == pytest.approx(0.0 if a is None else (b - a) / max(a, b), abs=1e-9)


def test_one_cluster_has_none(points):
    _, df = points
    assert {r.silhouette for r in vectors.silhouettes(df.where("label = 'a'"), "id", "v", "label").collect()} == {None}
    assert vectors.silhouettes(df.limit(0), "id", "v", "label").count() == 0


@pytest.mark.parametrize("cells", [1 << 22, 25])
def test_pair_statistics(points, cells):
    rows, df = points
    got = {r.same: r for r in vectors.pair_statistics(df.where("id % 20 = 0"), df, "id", "v", "label", cells).collect()}
    for same in (True, False):
        x = np.array([np.dot(v, w) for i, v, a in rows if i % 20 == 0 for j, w, b in rows if j > i and (a == b) == same])
        assert (got[same].pairs, got[same].least, got[same].most) == (len(x), x.min(), x.max())
        assert got[same]["mean"] == pytest.approx(x.mean()) and got[same].uniformity == pytest.approx(np.exp(-2 * (2 - 2 * x)).mean())
