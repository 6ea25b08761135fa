"""Graph communities beside brute force."""

from collections import deque

import numpy as np
import pyarrow as pa
import pytest

from screenforge.operators import cluster, communities


def graph_of(spark, n=240, k=6, seed=3):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 1.0, (n // 6, 4)) for c in rng.normal(0, 2.2, (6, 4))])
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>"), k


def quality(edges, labels, resolution=1.0):
    total = sum(w for _, _, w in edges)
    inside, degree = {}, {}
    for a, b, w in edges:
        for x in (a, b):
            degree[labels[x]] = degree.get(labels[x], 0.0) + w
        if labels[a] == labels[b]:
            inside[labels[a]] = inside.get(labels[a], 0.0) + w
    return sum(inside.get(c, 0.0) / total - resolution * (d / (2 * total)) ** 2 for c, d in degree.items())


def test_no_single_move_helps_on_a_neighbour_graph(spark, block=40, resolution=1.3):
    points, k = graph_of(spark, 150)
    graph = cluster.stored(cluster.knn_graph(points, k))
    edges = [(r["src"], r["dst"], r["weight"]) for r in graph.collect()]
    before, trace = communities.BLOCK, []
    try:
        communities.BLOCK = block
        found = communities.modularity_communities(graph, resolution, trace)
        labels = {r["id"]: r["community"] for r in found.collect()}
    finally:
        communities.BLOCK = before
    value = quality(edges, labels, resolution)
    assert set(labels) == {x for e in edges for x in e[:2]} and all(min(i for i, c in labels.items() if c == n) == n for n in set(labels.values()))
    near = {}
    for a, b, _ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for i, c in labels.items():
        for to in {labels[j] for j in near[i]} - {c}:
            assert quality(edges, labels | {i: to}, resolution) <= value + 1e-6
    for c in set(labels.values()):  # connected
        own, seen, stack = {i for i, x in labels.items() if x == c}, {c}, [c]
        while stack:
            for j in near[stack.pop()] & own - seen:
                seen.add(j)
                stack.append(j)
        assert seen == own
    levels = [i for i in range(1, len(trace)) if trace[i] < trace[i - 1] - 1e-9]  # a new graph begins at its nodes
    assert value == pytest.approx(max(trace), abs=1e-6) or value > max(trace)
    assert len(levels) <= 4 and 3 <= len(set(labels.values())) <= 60
    assert cluster.modularity(graph, found, resolution).first()["modularity"] == pytest.approx(value)


def test_planted_groups_nulls_and_repeats(spark):
    rows = [(a, b, 1.0) for g in range(4) for a in range(10 * g, 10 * g + 8) for b in range(a + 1, 10 * g + 8)]
    rows += [(3, 13, 0.5), (13, 3, 0.5), (25, 33, 1.0), (1, 1, 9.0), (2, 60, None), (2, 61, -1.0), (2, 62, 0.0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "src int, dst int, weight double, id string")
    got = {r["id"]: r["community"] for r in cluster.communities(df).collect()}
    assert got == {i: 10 * (i // 10) for g in range(4) for i in range(10 * g, 10 * g + 8)}
    assert cluster.communities(df.limit(0)).count() == 0
    assert "communities" in cluster.CLUSTERERS


def test_a_block_looks_again_only_beside_moves(monkeypatch):
    """400 nodes in 40 rings of neighbours: no move is left, after fewer looks than four sweeps."""
    looks = []

    class Queue(deque):
        def popleft(self):
            looks.append(1)
            return super().popleft()

    monkeypatch.setattr(communities, "deque", Queue)
    n = 400
    near = {i: [10 * (i // 10) + (i + d) % 10 for d in (1, 2, 8, 9)] for i in range(n)}
    total = 2.0 * n
    row = lambda i: {"id": i, "degree": 4.0, "community": i, "k": 4.0, "near": [{"other": j, "w": 1.0, "c": j, "k": 4.0} for j in near[i]]}
    table = pa.Table.from_pylist([row(i) for i in reversed(range(n))])
    out = communities._block_moves(table, 1 / (2 * total), total).to_pylist()
    label = {i: i for i in range(n)} | {r["id"]: r["to"] for r in out}
    edges = [(i, j, 1.0) for i in range(n) for j in near[i] if i < j]
    value = quality(edges, label)
    for i in range(n):
        for to in {label[j] for j in near[i]} - {label[i]}:
            assert quality(edges, label | {i: to}) <= value + 1e-9
    assert value - quality(edges, {i: i for i in range(n)}) == pytest.approx(sum(r["gain"] for r in out))
    assert n <= len(looks) < 4 * n
