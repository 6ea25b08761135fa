"""Agglomerative sub-clusters: Ward's tree inside every cluster, cut at a share of its height.

Pairs that are each other's nearest merge together, which gives the tree of merging one nearest pair
at a time, because a merger never brings two groups nearer to a third. A group is a row (number of
points, centroid), named by its smallest id; the cost of a merger follows from two such rows. All
clusters advance in the same jobs; a cluster whose groups fit in one block is finished in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from screenforge.operators import pairs as PR
from screenforge.operators.graph import connected_components
from screenforge.session import discard, stored

#: Rows of a tile compared at once, pairs whose exact heights are taken at once, blocks of one side of a tile.
PART_ROWS, STEP, TILE = 512, 1 << 18, 8


def _heights(x: np.ndarray, n: np.ndarray, i: int) -> np.ndarray:
    """Height at which group i merges with each group: the Euclidean distance for single points."""
    return np.sqrt(2.0 * n * n[i] / (n + n[i]) * ((x - x[i]) ** 2).sum(1))


def _finished(t: pa.Table) -> pa.Table:
    """All mergers (cluster, lo, hi, height) of one cluster's groups."""
    t = t.sort_by("id")
    x, n = PR.matrix(t, "centroid").copy(), t.column("n").to_numpy().astype(float)
    h = np.array([_heights(x, n, i) for i in range(len(x))]).reshape(len(x), len(x))
    np.fill_diagonal(h, np.inf)
    lo, hi, height = [], [], []
    for _ in range(len(x) - 1):
        i, j = divmod(int(np.argmin(h)), len(x))  # of equal heights the pair of the smallest ids
        lo.append(i)
        hi.append(j)
        height.append(float(h[i, j]))
        x[i] = (n[i] * x[i] + n[j] * x[j]) / (n[i] + n[j])
        n[i] += n[j]
        gone = np.isinf(h[i])
        gone[j] = True
        h[i] = np.where(gone, np.inf, _heights(x, n, i))
        h[:, i], h[j], h[:, j] = h[i], np.inf, np.inf
    ids = t.column("id").combine_chunks()
    return pa.table({
        "cluster": t.column("cluster").combine_chunks().take(pa.array(lo, pa.int64())), "lo": ids.take(pa.array(lo, pa.int64())),
        "hi": ids.take(pa.array(hi, pa.int64())), "height": pa.array(height, pa.float64()),
    })


def _lowest(x: np.ndarray, n: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, height): the first column of least height of each row, itself left out; ``cols`` ascend.

    A matrix product leaves the columns that rounding may make the lowest; their heights are exact.
    """
    y, m = x[cols], n[cols]
    c = y.mean(axis=0)
    far, most = ((y - c) ** 2).sum(1).max(), m.max()
    for i in range(0, len(rows), PART_ROWS):
        at = rows[i : i + PART_ROWS]
        k = n[at, None]
        h2 = PR.squared_distances(x[at], y) * (2.0 * k * m / (k + m))
        h2[at[:, None] == cols] = np.inf
        slack = 1e-12 * (((x[at] - c) ** 2).sum(1) + far) * (2.0 * n[at] * most / (n[at] + most))
        r, q = np.nonzero((h2 <= (h2.min(1) + 2 * slack)[:, None]) & (h2 < np.inf))
        u, v = at[r], cols[q]
        exact = np.concatenate([np.zeros(0), *[np.sqrt(2.0 * n[w] * n[z] / (n[w] + n[z]) * ((x[w] - x[z]) ** 2).sum(1)) for w, z in ((v[j : j + STEP], u[j : j + STEP]) for j in range(0, len(u), STEP))]])
        order = np.lexsort((v, exact, u))
        first = order[np.flatnonzero(np.diff(u[order], prepend=-1))]
        yield u[first], v[first], exact[first]


def _nearest(t: pa.Table) -> pa.Table:
    """The nearest other group of each group in a tile of one cluster; of two blocks, in the other block."""
    t = t.sort_by("id")
    x, n, block = PR.matrix(t, "centroid"), t.column("n").to_numpy().astype(float), t.column("__b").to_numpy()
    other, height = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    sides = [np.flatnonzero(block == b) for b in np.unique(block)]
    for rows, cols in zip(sides, sides[::-1], strict=True):
        for u, v, h in _lowest(x, n, rows, cols):
            other[u], height[u] = v, h
    keep = np.isfinite(height)
    at = np.arange(len(x))[keep]
    ids = t.column("id").combine_chunks()
    take = lambda v: ids.take(pa.array(v, pa.int64()))
    return pa.table({
        "cluster": t.column("cluster").combine_chunks().take(pa.array(at, pa.int64())), "id": take(at), "height": pa.array(height[keep]),
        "lo": take(np.minimum(at, other[keep])), "hi": take(np.maximum(at, other[keep])),
    })


def _spread(rows: DataFrame, *keys: str) -> GroupedData:
    """Groups in as many tasks as the session shuffles into: few bytes, much work, which AQE would merge."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).groupBy(*keys)


def _round(groups: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Mergers of mutual nearest groups in clusters of more than one block, and the groups after them."""
    kinds = {c: groups.schema[c].dataType.simpleString() for c in ("cluster", "id")}
    blocks = F.ceil(F.col("size") / (TILE * block_rows)).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    dealt = groups.withColumn("__b", own).withColumn("__o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tiles = dealt.select("cluster", "id", "n", "centroid", "__b", F.least("__b", "__o").alias("__l"), F.greatest("__b", "__o").alias("__r"))
    near = _spread(tiles, "cluster", "__l", "__r").applyInArrow(
        lambda t: _nearest(t), f"cluster {kinds['cluster']}, id {kinds['id']}, height double, lo {kinds['id']}, hi {kinds['id']}"
    )
    best = near.groupBy("cluster", "id").agg(F.min(F.struct("height", "lo", "hi")).alias("e")).select("cluster", "e.*")
    mutual = stored(best.groupBy("cluster", "lo", "hi").agg(F.count(F.lit(1)).alias("__n"), F.min("height").alias("height")).where("__n = 2").select("cluster", "lo", "hi", "height"))
    first = groups.select("cluster", F.col("id").alias("lo"), F.col("n").alias("l"), "centroid")
    second = PR.own_columns(groups).select("cluster", F.col("id").alias("hi"), F.col("n").alias("m"), F.col("centroid").alias("other"))
    total = F.col("l") + F.col("m")
    mean = F.zip_with("centroid", "other", lambda a, b: (F.col("l") * a + F.col("m") * b) / total)
    merged = mutual.join(first, ["cluster", "lo"]).join(second, ["cluster", "hi"]).select("cluster", F.col("lo").alias("id"), total.alias("n"), mean.alias("centroid"))
    ends = mutual.select("cluster", F.explode(F.array("lo", "hi")).alias("id"))
    rest = groups.join(ends, ["cluster", "id"], "left_anti").select("cluster", "id", "n", "centroid")
    return mutual, rest.unionByName(merged)


def ward_mergers(points: DataFrame, block_rows: int = PR.BLOCK_ROWS) -> DataFrame:
    """(cluster, lo, hi, height): Ward's tree of each cluster of (cluster, id, features).

    A merger joins the groups whose smallest ids are lo < hi. A cluster of n points gives n - 1 rows.
    """
    kinds = {c: points.schema[c].dataType.simpleString() for c in ("cluster", "id")}
    shape = f"cluster {kinds['cluster']}, lo {kinds['id']}, hi {kinds['id']}, height double"
    sized = lambda g: g.join(PR.own_columns(g).groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), "cluster")
    groups = stored(sized(points.select("cluster", "id", F.lit(1).cast("long").alias("n"), F.col("features").alias("centroid"))))
    found = []
    while True:
        small = groups.where(F.col("size") <= block_rows)
        found.append(stored(_spread(small, "cluster").applyInArrow(lambda t: _finished(t), shape)))
        large = groups.where(F.col("size") > block_rows)
        if large.isEmpty():
            break
        mutual, after = _round(large, block_rows)
        found.append(mutual)
        after = stored(sized(after))
        discard(groups)
        groups = after
    discard(groups)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def ward_subclusters(labelled: DataFrame, share: float = 0.5, min_size: int = 3, block_rows: int = PR.BLOCK_ROWS) -> DataFrame:
    """(id, cluster, subcluster): groups of Ward's tree of each cluster, cut at ``share`` of its largest height.

    The sub-cluster is its smallest id. Clusters of fewer than ``min_size`` points are one
    sub-cluster. Ids are unique; rows without id are left out, and those without cluster or
    features, or with a null or non-finite feature, have a null sub-cluster. Of equal heights the
    pair with the smallest ids merges first. Other columns are not read.
    """
    rows = labelled.where(F.col("id").isNotNull()).select("id", "cluster", F.col("features").cast("array<double>").alias("features"))
    usable = F.forall("features", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    points = stored(rows.where(F.col("cluster").isNotNull() & usable & (F.size("features") > 0)))
    mergers = stored(ward_mergers(points, block_rows))
    cut = mergers.groupBy("cluster").agg(F.max("height").alias("top"), F.count(F.lit(1)).alias("joins"))
    within = (F.col("height") <= share * F.col("top")) | (F.col("joins") + 1 < min_size)
    edges = PR.own_columns(mergers).join(cut, "cluster").where(within).select("lo", "hi")
    roots = stored(connected_components(edges, "lo", "hi").select(F.col("node").alias("id"), F.col("component").alias("root")))
    named = points.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("subcluster"))
    discard(mergers)
    return rows.select("id", "cluster").join(named, "id", "left").select("id", "cluster", "subcluster")
