"""The density hierarchy beside a quadratic version that removes the heaviest edges from the top."""

import numpy as np
import pytest

from screenforge.operators import cluster, density
from screenforge.operators import pairs as PR
from screenforge.operators.density import LEAST, core_distances, density_hierarchy, entries, tile_trees


def spanning_tree(x, min_samples):
    n = len(x)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, min(min_samples, n - 1)]
    d = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    group = list(range(n))
    tree = []
    for w, i, j in sorted((d[i, j], i, j) for i in range(n) for j in range(i + 1, n)):
        if group[i] != group[j]:
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
            tree.append((w, i, j))
    return tree


def sides(points, edges):
    """Components of ``points`` over ``edges``, each with its edges."""
    near = {p: [] for p in points}
    for e in edges:
        near[e[1]].append(e[2])
        near[e[2]].append(e[1])
    left, out = set(points), []
    while left:
        stack = [left.pop()]
        seen = set(stack)
        while stack:
            for q in near[stack.pop()]:
                if q not in seen:
                    seen.add(q)
                    stack.append(q)
        left -= seen
        out.append((seen, [e for e in edges if e[1] in seen]))
    return out


def brute(x, size, min_samples):
    """Label per point: smallest index of its cluster, None for noise."""
    if len(x) < size:
        return [None] * len(x)

    def best(points, edges, born, root):
        """(stability, clusters) of the best choice inside a cluster."""
        total, own, members = 0.0, set(points), set(points)
        while True:
            heaviest = max(edges)
            level = 1 / max(heaviest[0], LEAST)
            parts = sides(own, [e for e in edges if e != heaviest])
            big = [p for p in parts if len(p[0]) >= size]
            if len(big) == 1:
                total += (len(own) - len(big[0][0])) * (level - born)
                own, edges = big[0]
                continue
            total += len(own) * (level - born)
            found = [best(*p, level, False) for p in big]
            below = sum(f[0] for f in found)
            if root or (found and total < below):
                return below, [c for f in found for c in f[1]]
            return total, [members]

    labels = [None] * len(x)
    for members in best(set(range(len(x))), spanning_tree(x, min_samples), 0.0, True)[1]:
        for p in members:
            labels[p] = min(members)
    return labels


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r], "x") for i, r in enumerate(x)], "id long, features array<double>, cluster string")


@pytest.mark.parametrize("case", ["groups", "nested", "grid", "line"])
def test_labels_equal_the_quadratic_version(spark, case):
    rng = np.random.default_rng(7)
    if case == "groups":
        x, size, samples = np.vstack([rng.normal(c, s, (n, 3)) for c, s, n in [(0, 0.3, 60), (4, 0.5, 45), (8, 0.2, 30)]] + [rng.uniform(-2, 10, (25, 3))]), 25, 25
    elif case == "nested":
        x, size, samples = np.vstack([rng.normal([a, b], 0.25, (15, 2)) for a in (0, 9) for b in (0, 2, 4)] + [rng.uniform(0, 10, (20, 2))]), 6, 4
    elif case == "grid":  # ties everywhere, and repeated points
        x, size, samples = np.array([(i % 6, i // 6) for i in range(36)] + [(20 + i % 4, i // 4) for i in range(16)] + [(3, 3)] * 8 + [(40, 40)] * 7, float), 5, 3
    else:  # distances that grow along a line: the longest way from a point to its component
        x, size, samples = np.cumsum(np.concatenate([np.linspace(0.1, 2, 40), [9], np.linspace(0.2, 1, 30)]))[:, None], 8, 1
    want = brute(x, size, samples)
    assert len({v for v in want if v is not None}) >= 2
    for block in (23, 1000):
        got = {r["id"]: r["cluster"] for r in density_hierarchy(frame(spark, x), size, samples, block).collect()}
        assert [got[i] for i in range(len(x))] == want


def test_entries_are_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (70, 2))
    points = frame(spark, x).select("id", "features")
    edges = tile_trees(points.join(core_distances(points, 3, 20), "id"), 20)
    got = {r["id"]: tuple(r["entry"]) for r in entries(edges, 10).collect()}
    group, want = {i: {i} for i in range(70)}, {}
    for w, i, j in spanning_tree(x, 3):
        merged = group[i] | group[j]
        for p in merged:
            group[p] = merged
            if len(merged) >= 10:
                want.setdefault(p, (w, i, j))
    assert {p: e[1:] for p, e in got.items()} == {p: e[1:] for p, e in want.items()}
    assert all(got[p][0] == pytest.approx(want[p][0]) for p in want)


def test_small_null_and_broken_input(spark):
    few = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), (None, [3.0]), ("c", None), ("d", [float("nan")]), ("e", [None])], "id string, features array<double>")
    assert {r["id"]: r["cluster"] for r in density_hierarchy(few).collect()} == dict.fromkeys("abcde")
    assert density_hierarchy(few.limit(0)).count() == 0
    same = spark.createDataFrame([(f"{i:02d}", [float(i // 10)]) for i in range(30)] + [("x", None)], "id string, features array<double>")
    got = {r["id"]: r["cluster"] for r in density_hierarchy(same, 5, 3).collect()}
    assert got == {**{f"{i:02d}": f"{i // 10}0" for i in range(30)}, "x": None}
    assert "density_hierarchy" in cluster.CLUSTERERS


def test_few_points_are_compared_again(spark, monkeypatch):
    """The tree comes from neighbours; tiles of all points against all are not worked off again."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.4, (n, 3)) for c, n in ((0, 130), (5, 20), (9, 15))] + [np.full((12, 3), 7.0)])
    asked, tiles = [], PR.tile_reduce
    monkeypatch.setattr(density.PR, "tile_reduce", lambda left, *rest, **more: (asked.append(left.count()), tiles(left, *rest, **more))[1])
    monkeypatch.setattr(density, "tile_trees", None)
    got = {r["id"]: r["cluster"] for r in density_hierarchy(frame(spark, x), 10, 8, 50).collect()}
    assert [got[i] for i in range(len(x))] == brute(x, 10, 8)
    assert asked[0] == len(x) and max(asked[1:]) < len(x) / 2
