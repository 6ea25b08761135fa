"""Ward's tree and its cut beside merging one nearest pair at a time."""

import numpy as np
import pyarrow as pa
import pytest

from screenforge.operators import cluster, ward
from screenforge.operators.ward import ward_mergers, ward_subclusters


def brute(points):
    """Mergers {(lo, hi): height} of {id: vector}, by the increase of the squared error."""
    groups = {i: [v] for i, v in points.items()}
    error = lambda vs: ((np.array(vs) - np.mean(vs, axis=0)) ** 2).sum()
    out = []
    while len(groups) > 1:
        names = sorted(groups)
        cost, lo, hi = min((round(error(groups[a] + groups[b]) - error(groups[a]) - error(groups[b]), 12), a, b) for k, a in enumerate(names) for b in names[k + 1 :])
        groups[lo] = groups[lo] + groups.pop(hi)
        out.append((lo, hi, np.sqrt(2 * max(cost, 0.0))))
    return out


def cut(points, mergers, share=0.5, min_size=3):
    root = {i: i for i in points}
    top = max((h for _, _, h in mergers), default=0.0)
    for lo, hi, h in mergers:
        if h <= share * top or len(points) < min_size:
            root = {i: lo if r == hi else r for i, r in root.items()}
    return root


@pytest.mark.parametrize("block", [9, 1000])
def test_tree_and_cut_equal_brute_force(spark, block):
    rng = np.random.default_rng(5)
    sizes = {"a": 30, "b": 17, "c": 2, "d": 1, "e": 3}
    rows, at = [], 0
    for name, n in sizes.items():
        for _ in range(n):
            rows.append((at, name, (rng.normal(0, 1, 3) + 4 * (at % 3)).tolist(), "x"))
            at += 1
    df = spark.createDataFrame(rows, "id long, cluster string, features array<double>, subcluster string")
    got = {}
    for r in ward_mergers(df, block).collect():
        got.setdefault(r["cluster"], {})[r["lo"], r["hi"]] = r["height"]
    labels = {r["id"]: r["subcluster"] for r in ward_subclusters(df, block_rows=block).collect()}
    for name in sizes:
        points = {i: v for i, c, v, _ in rows if c == name}
        want = brute(points)
        assert got.get(name, {}) == pytest.approx({(a, b): h for a, b, h in want})
        assert {i: labels[i] for i in points} == cut(points, want)


def test_hot_cluster_repeats_nulls_and_empty(spark):
    rows = [(i, 0, [float(i % 4 * 10), 1.0]) for i in range(120)] + [(200, 1, [0.0, 0.0]), (201, None, [0.0, 0.0]), (202, 0, None), (203, 0, [float("nan"), 1.0]), (None, 0, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, cluster int, features array<double>")
    for block in (16, 1000):
        got = {r["id"]: r["subcluster"] for r in ward_subclusters(df, 0.1, block_rows=block).collect()}
        assert got == {**{i: i % 4 for i in range(120)}, 200: 200, 201: None, 202: None, 203: None}
    assert ward_subclusters(df.limit(0)).count() == 0


def test_named_clusterers(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.1, (30, 2)) for c in (0, 5)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    want = {frozenset(range(30)), frozenset(range(30, 60))}
    for name, options in {"kmeans": {"k_max": 5}, "silhouette": {"ks": [2, 3]}, "ward": {}, "density": {"eps": 1.0}, "density_hierarchy": {}, "communities": {"k": 20}}.items():
        found = {}
        for r in cluster.CLUSTERERS[name](df, **options).collect():
            found.setdefault(r["cluster"], set()).add(r["id"])
        groups = [frozenset(g) for c, g in found.items() if c is not None]
        assert groups and all(any(g <= w for w in want) for g in groups), name
        if name in ("silhouette", "ward", "density"):  # the others may part a group further
            assert set(groups) == want, name


def test_nearest_groups_of_a_tile_beside_brute_force():
    """Within one block, and from block to block, with equal and repeated points; work is by matrix product."""
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 1, (40, 3)), rng.integers(0, 3, (40, 3)).astype(float)])
    n = rng.integers(1, 9, 80)
    for blocks in (np.zeros(80, np.int32), rng.integers(0, 2, 80).astype(np.int32)):
        t = pa.table({"cluster": pa.array([1] * 80), "id": pa.array(range(80)), "n": pa.array(n), "centroid": pa.array(x.tolist()), "__b": pa.array(blocks)})
        got = {r["id"]: (r["height"], r["hi"] + r["lo"] - r["id"]) for r in ward._nearest(t).to_pylist()}
        for i in range(80):
            h = [(float(np.sqrt(2.0 * n[j] * n[i] / (n[j] + n[i]) * ((x[j] - x[i]) ** 2).sum())), j) for j in range(80) if j != i and (blocks.max() == 0 or blocks[j] != blocks[i])]
            assert got[i][1] == min(h)[1] and got[i][0] == pytest.approx(min(h)[0])
