"""Density hierarchy: clusters that persist over distances, without a distance to choose.

Two points are as far apart as the largest of their distance and their two core distances (to the
``min_samples``-th neighbour). Joining the nearest first gives a hierarchy; a component counts as
a cluster from ``min_cluster_size`` points on, and the clusters that persist longest are chosen.

All edges have one total order (weight, smaller id, larger id), so the hierarchy is unique:

1. The spanning tree of all: components take their lightest edge in rounds, most of them from the
   neighbours that give the core distances; few points are compared with all others again.
2. A point's *entry* is the edge that brings its component to ``min_cluster_size`` points. It is
   the last edge of a search from the point over its lightest edges, which stops at that many
   points, so it is found from bounded neighbourhoods that neighbours pass on.
3. Edges up to the entry of an end contract to one *core region* per cluster without parts; the
   others, between regions, are the mergers of clusters. There are at most
   rows / min_cluster_size regions, and only their tree is put together in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenforge.operators import pairs as PR
from screenforge.operators.graph import connected_components
from screenforge.session import discard, stored

#: Parts in which the mergers of regions are reduced to a forest before the last task.
FOREST_PARTS = 32
#: Distances below this count as this one, so that equal points have a finite density.
LEAST = 1e-10


def core_distances(points: DataFrame, min_samples: int, block_rows: int = PR.BLOCK_ROWS) -> DataFrame:
    """(id, core): distance to the ``min_samples``-th other point, or to the last if there are fewer."""
    near = PR.nearest(points, points, min_samples, block_rows=block_rows)
    far = near.groupBy("id").agg(F.max("distance").alias("core"))
    return points.select("id").join(far, "id", "left").select("id", F.coalesce("core", F.lit(0.0)).alias("core"))


def tile_trees(points: DataFrame, block_rows: int = PR.BLOCK_ROWS) -> DataFrame:
    """(src, dst, w), src < dst: the spanning tree of each pair of blocks of (id, features, core).

    An edge that is the heaviest of a cycle in a tile is so in the whole, so the union of the trees
    holds the spanning tree of all. A tile emits fewer edges than it has points.
    """
    blocks = max(1, -(-points.count() // block_rows))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = points.withColumn("__b", own).withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = dealt.select("id", "features", "core", F.least("__b", "__o").alias("__l"), F.greatest("__b", "__o").alias("__r"))
    kind = points.schema["id"].dataType.simpleString()

    def tree(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        x, core = PR.matrix(t), t.column("core").to_numpy()
        n = len(x)
        best, source = np.full(n, np.inf), np.zeros(n, np.int64)
        code = np.full(n, np.iinfo(np.int64).max)
        out, at, position = np.zeros(n, bool), 0, np.arange(n)
        src, dst, w = [], [], []
        for _ in range(n - 1):
            out[at] = True
            d = np.maximum(np.maximum(np.sqrt(((x - x[at]) ** 2).sum(1)), core), core[at])
            name = np.minimum(position, at) * n + np.maximum(position, at)
            nearer = ~out & ((d < best) | ((d == best) & (name < code)))
            best[nearer], code[nearer], source[nearer] = d[nearer], name[nearer], at
            best[at] = np.inf
            least = np.flatnonzero((best == best.min()) & ~out)
            at = int(least[np.argmin(code[least])])
            src.append(min(at, int(source[at])))
            dst.append(max(at, int(source[at])))
            w.append(float(best[at]))
        ids = t.column("id").combine_chunks()
        return pa.table({"src": ids.take(pa.array(src, pa.int64())), "dst": ids.take(pa.array(dst, pa.int64())), "w": pa.array(w, pa.float64())})

    parts = min(blocks * (blocks + 1) // 2, PR.MAX_PARTITIONS)
    found = tiles.repartition(parts, "__l", "__r").groupBy("__l", "__r").applyInArrow(tree, f"src {kind}, dst {kind}, w double")
    return found.distinct()


def _lightest(a: pa.Table, b: pa.Table) -> pa.Table:
    """(id, other, w): the lightest edge of each row of ``a`` to a row of ``b`` of another component, ties by the other id."""
    if not (a.num_rows and b.num_rows):
        return pa.table({"id": a.column("id").slice(0, 0), "other": b.column("id").slice(0, 0), "w": pa.array([], pa.float64())})
    x, y = PR.matrix(a), PR.matrix(b)
    own, far = a.column("core").to_numpy(), b.column("core").to_numpy()
    names = pa.chunked_array([*a.column("comp").chunks, *b.column("comp").chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
    d2 = np.maximum(np.maximum(PR.squared_distances(x, y), (own**2)[:, None]), far**2)
    d2[names[: len(x), None] == names[len(x):]] = np.inf
    c = y.mean(axis=0)
    slack = 1e-12 * (((x - c) ** 2).sum(1) + ((y - c) ** 2).sum(1).max())
    # all that rounding may make the lightest, then by exact distances
    rows, cols = np.nonzero((d2 <= (d2.min(1) + slack)[:, None]) & (d2 < np.inf))
    step = 1 << 18
    exact = np.concatenate([np.zeros(0), *[np.sqrt(((y[cols[i:i + step]] - x[rows[i:i + step]]) ** 2).sum(1)) for i in range(0, len(rows), step)]])
    w = np.maximum(np.maximum(exact, own[rows]), far[cols])
    rank = np.empty(len(y), np.int64)
    rank[pc.sort_indices(b.column("id")).to_numpy()] = np.arange(len(y))
    order = np.lexsort((rank[cols], w, rows))
    first = order[np.flatnonzero(np.diff(rows[order], prepend=-1))]
    take = lambda t, at: t.column("id").take(pa.array(at, pa.int64()))
    return pa.table({"id": take(a, rows[first]), "other": take(b, cols[first]), "w": pa.array(w[first])})


def _first_edges(t: pa.Table) -> pa.Table:
    t = t.sort_by([("id", "ascending"), ("w", "ascending"), ("other", "ascending")])
    code = t.column("id").combine_chunks().dictionary_encode().indices.to_numpy()
    return t.take(pa.array(np.flatnonzero(np.diff(code, prepend=-1))))


def _roots(pointers: DataFrame) -> DataFrame:
    """(comp, root) of (comp, to): where the pointers lead; of two that point at each other the smaller is the root."""
    back = PR.own_columns(pointers).select(F.col("comp").alias("to"), F.col("to").alias("__back"))
    now = stored(pointers.join(back, "to", "left").where("__back IS NULL OR __back <> comp OR to < comp").select("comp", "to"))
    while True:
        ahead = PR.own_columns(now).select(F.col("comp").alias("to"), F.col("to").alias("__next"))
        after = stored(now.join(ahead, "to", "left").select("comp", F.coalesce("__next", "to").alias("to"), F.col("__next").isNotNull().alias("moved")))
        discard(now)
        now = after.select("comp", "to")
        if after.where("moved").isEmpty():
            return now.select("comp", F.col("to").alias("root"))


def spanning_tree(points: DataFrame, near: DataFrame, block_rows: int = PR.BLOCK_ROWS) -> DataFrame:
    """(src, dst, w), src < dst: the spanning tree of (id, features, core, beyond).

    ``near`` (id, ref_id, distance) holds neighbours of each point, all others are at ``beyond`` or
    farther. In a round every component but the largest takes its lightest edge to another one. The
    edges to neighbours give one; only points with ``beyond`` at most its weight can have a lighter
    one, and these are compared with all points in tiles.
    """
    n = points.count()
    of = lambda end, table: PR.own_columns(table).select(F.col("id").alias(end), F.col("core").alias(f"__{end}"))
    listed = near.select(F.least("id", "ref_id").alias("src"), F.greatest("id", "ref_id").alias("dst"), "distance").distinct()
    listed = listed.join(of("src", points), "src").join(of("dst", points), "dst")
    links = stored(listed.select("src", "dst", F.greatest("distance", "__src", "__dst").alias("w"), F.col("src").alias("a"), F.col("dst").alias("b")))
    member, found = stored(points.select("id", F.col("id").alias("comp"))), []
    while True:
        sizes = member.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
        top = sizes.orderBy(F.desc("n"), "comp").first()
        if top is None or top["n"] == n:
            break
        edge = F.struct("w", "src", "dst").alias("e")
        sides = links.select(F.col("a").alias("comp"), F.col("b").alias("to"), edge).unionByName(links.select(F.col("b").alias("comp"), F.col("a").alias("to"), edge))
        known = stored(sides.where(F.col("comp") != F.lit(top["comp"])).groupBy("comp").agg(F.min(F.struct("e", "to")).alias("m")).select("comp", "m.e", "m.to"))
        placed = stored(points.join(member, "id"))
        asked = placed.where(F.col("comp") != F.lit(top["comp"])).join(known.select("comp", F.col("e.w").alias("least")), "comp", "left")
        asked = stored(asked.where("least IS NULL OR beyond <= least").select("id", "features", "core", "comp"))
        kind = points.schema["id"].dataType.simpleString()
        seen = PR.tile_reduce(asked, placed.select("id", "features", "core", "comp"), _lightest, f"id {kind}, other {kind}, w double", _first_edges, block_rows, right_rows=n)
        ends = seen.join(PR.own_columns(member), "id").join(PR.own_columns(member).select(F.col("id").alias("other"), F.col("comp").alias("to")), "other")
        seen = ends.select("comp", F.struct("w", F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst")).alias("e"), "to")
        picked = stored(known.unionByName(seen).groupBy("comp").agg(F.min(F.struct("e", "to")).alias("m")).select("comp", "m.e", "m.to"))
        found.append(picked)
        root = _roots(picked.select("comp", "to"))
        new = lambda end: PR.own_columns(root).select(F.col("comp").alias(end), F.col("root").alias(f"__{end}"))
        after = stored(member.join(new("comp"), "comp", "left").select("id", F.coalesce("__comp", "comp").alias("comp")))
        named = lambda c: F.coalesce(f"__{c}", c)
        rest = stored(links.join(new("a"), "a", "left").join(new("b"), "b", "left").where(named("a") != named("b")).select("src", "dst", "w", named("a").alias("a"), named("b").alias("b")))
        discard(links, member, known, placed, asked)
        member, links = after, rest
    if not found:
        return links.select("src", "dst", "w").limit(0)
    tree = found[0].select("e.src", "e.dst", "e.w")
    for more in found[1:]:
        tree = tree.unionByName(more.select("e.src", "e.dst", "e.w"))
    return tree.distinct()


def _reached(start: int, edges: list[tuple], size: int) -> list[int]:
    """Positions in ``edges`` (src, dst, lightest first) by which a search over the lightest from ``start`` reaches ``size`` points, in order."""
    near: dict = {}
    for k, (x, y) in enumerate(edges):
        near.setdefault(x, []).append(k)
        near.setdefault(y, []).append(k)
    inside, heap, taken = {start}, list(near.get(start, [])), []
    while heap and len(inside) < size:
        k = heapq.heappop(heap)
        x, y = edges[k]
        new = y if x in inside else x
        if new in inside:
            continue
        inside.add(new)
        taken.append(k)
        for other in near[new]:
            if edges[other][0] not in inside or edges[other][1] not in inside:
                heapq.heappush(heap, other)
    return taken


def _trees(points: pa.Array, old: pa.Array, lists: pa.Array, size: int) -> tuple[pa.Array, pa.Array]:
    """(tree, changed) of each point: the search over the edges of its list."""
    flat = lists.flatten()
    names = pa.concat_arrays([points, *[x.flatten().field(c) for x in (lists, old) for c in ("src", "dst")]]).dictionary_encode()
    rank = np.empty(len(names.dictionary), np.int64)
    rank[pc.sort_indices(names.dictionary).to_numpy()] = np.arange(len(rank))
    code = rank[names.indices.to_numpy()]
    n, m = len(points), len(flat)
    start, src, dst, before = code[:n], code[n : n + m], code[n + m : n + 2 * m], code[n + 2 * m :].reshape(2, -1)
    lengths = lambda x: pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(n), lengths(lists))
    order = np.lexsort((dst, src, flat.field("w").to_numpy(zero_copy_only=False), owner))
    order = order[np.concatenate([[True], np.any(np.diff(np.stack([owner, src, dst])[:, order], axis=1) != 0, axis=0)])] if m else order
    cuts = np.searchsorted(owner[order], np.arange(n + 1))
    pairs = list(zip(src[order].tolist(), dst[order].tolist(), strict=True))
    found = [[i + k for k in _reached(p, pairs[i:j], size)] for p, i, j in zip(start.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])])
    at = order[np.array([k for x in found for k in x], np.int64)]
    was = np.concatenate([[0], np.cumsum(lengths(old))])
    now = np.stack([src[at], dst[at]])
    changed = [not np.array_equal(now[:, offsets[i] : offsets[i + 1]], before[:, was[i] : was[i + 1]]) for i in range(n)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.take(pa.array(at))), pa.array(changed, pa.bool_())


def entries(edges: DataFrame, size: int) -> DataFrame:
    """(id, entry struct<w, src, dst>): the edge at which each point's component has ``size`` points; null if none does.

    Each point keeps a tree of at most ``size`` - 1 edges. In a round it searches the trees of the
    points it reaches and its own lightest edges; the trees are exact when none changes.
    """
    kind = edges.schema["src"].dataType.simpleString()
    key = F.struct("w", "src", "dst").alias("e")
    ends = edges.select(F.col("src").alias("id"), key).unionByName(edges.select(F.col("dst").alias("id"), key))
    lightest = ends.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy("e"))).where(F.col("__n") < size)
    own = stored(lightest.groupBy("id").agg(F.sort_array(F.collect_list("e")).alias("tree")))
    shape = f"array<struct<w:double,src:{kind},dst:{kind}>>"
    schema = f"id {kind}, tree {shape}, changed boolean"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tree, changed = _trees(b.column("id"), b.column("old"), b.column("edges"), size)
            yield pa.RecordBatch.from_arrays([b.column("id"), tree.cast(b.schema.field("old").type), changed], names=["id", "tree", "changed"])

    now = own
    while True:
        reached = now.select("id", F.explode(F.array_distinct(F.flatten(F.transform("tree", lambda e: F.array(e["src"], e["dst"]))))).alias("other"))
        passed = PR.own_columns(now).select(F.col("id").alias("other"), "tree")
        offers = reached.join(passed, "other").select("id", "tree").unionByName(own.select("id", "tree"))
        seen = offers.groupBy("id").agg(F.flatten(F.collect_list("tree")).alias("edges"))
        after = stored(now.select("id", F.col("tree").alias("old")).join(seen, "id").select("id", "old", "edges").mapInArrow(search, schema))
        if now is not own:
            discard(now)
        now = after
        if now.where("changed").isEmpty():
            break
    # the heaviest, not the last: a search passes light edges behind a heavy one
    return now.select("id", F.when(F.size("tree") >= size - 1, F.array_max("tree")).alias("entry"))


def _forest(rows: pa.Table) -> pa.Table:
    """The lightest edges between regions (a, b, e) that join what all of them join."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    order = sorted(range(rows.num_rows), key=[tuple(e.values()) for e in rows.column("e").to_pylist()].__getitem__)
    a, b = rows.column("a").to_pylist(), rows.column("b").to_pylist()
    keep = []
    for i in order:
        x, y = find(a[i]), find(b[i])
        if x != y:
            root[x] = y
            keep.append(i)
    return rows.take(pa.array(keep, pa.int64()))


def merger_tree(regions: DataFrame, mergers: DataFrame) -> DataFrame:
    """(node, region, parent, e): the clusters. Regions are leaves; e is the edge that formed a cluster of two (null for leaves).

    ``mergers`` (a, b, e) are reduced to forests in parts first; the last task holds at most
    ``FOREST_PARTS`` rows per region, and there are at most rows / min_cluster_size regions.
    """
    kind = regions.schema["region"].dataType.simpleString()
    edge = f"struct<w:double,src:{kind},dst:{kind}>"
    flat = f"a {kind}, b {kind}, e {edge}"
    part = F.pmod(F.xxhash64("a", "b"), F.lit(FOREST_PARTS))
    reduced = mergers.groupBy(part.alias("__p")).applyInArrow(lambda t: _forest(t.select(["a", "b", "e"])), flat)
    schema = f"node long, region {kind}, parent long, e {edge}"

    def build(names: pa.Table, t: pa.Table) -> pa.Table:
        found = sorted(names.column("region").to_pylist())
        top = {r: i for i, r in enumerate(found)}
        over, formed = {}, {}
        up = list(range(len(found)))  # union by index of the region

        def find(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        cluster = list(range(len(found)))
        rows = sorted(_forest(t).select(["a", "b", "e"]).to_pylist(), key=lambda r: tuple(r["e"].values()))
        for k, r in enumerate(rows, len(found)):
            x, y = find(top[r["a"]]), find(top[r["b"]])
            over[cluster[x]] = over[cluster[y]] = k
            formed[k] = r["e"]
            up[x] = y
            cluster[y] = k
        nodes = range(len(found) + len(rows))
        kinds = names.schema.field("region").type
        return pa.table({
            "node": pa.array(nodes, pa.int64()), "region": pa.array([found[i] if i < len(found) else None for i in nodes], kinds),
            "parent": pa.array([over.get(i) for i in nodes], pa.int64()),
            "e": pa.array([formed.get(i) for i in nodes], pa.struct([("w", pa.float64()), ("src", kinds), ("dst", kinds)])),
        })

    one = F.lit(0).alias("__t")
    return regions.select("region", one).groupBy("__t").cogroup(reduced.select("a", "b", "e", one).groupBy("__t")).applyInArrow(
        lambda a, b: build(a.select(["region"]), b.select(["a", "b", "e"])), schema
    )


def chosen_clusters(clusters: DataFrame) -> DataFrame:
    """(node, chosen): the cluster that each node of (node, parent, w, n, density) belongs to, null for none.

    ``w`` is the distance that formed the node, ``n`` and ``density`` the number and the sum of
    1 / distance of the points that enter there. A cluster is chosen over its parts when its points
    stay in it for at least as much density; the cluster of all is never chosen.
    """
    def choose(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["node"])  # parts come before the whole
        level = {r["node"]: 1 / max(r["w"], LEAST) for r in rows if r["w"] is not None}
        size, stays, parts, chosen = {}, {}, {}, {}
        for r in rows:
            i, parent = r["node"], r["parent"]
            own = parts.get(i, [])
            born = 0.0 if parent is None else level[parent]
            size[i] = r["n"] + sum(size[p] for p in own)
            stability = r["density"] - r["n"] * born + sum(size[p] * (level[i] - born) for p in own)
            below = sum(stays[p] for p in own)
            chosen[i] = parent is not None and (not own or stability >= below)
            stays[i] = stability if chosen[i] else below
            if parent is not None:
                parts.setdefault(parent, []).append(i)
        label: dict = {}
        for r in reversed(rows):
            above = label.get(r["parent"])
            label[r["node"]] = above if above is not None else (r["node"] if chosen[r["node"]] else None)
        return pa.table({"node": pa.array(list(label), pa.int64()), "chosen": pa.array(list(label.values()), pa.int64())})

    return clusters.withColumn("__t", F.lit(0)).groupBy("__t").applyInArrow(lambda t: choose(t.drop(["__t"])), "node long, chosen long")


def density_hierarchy(profiles: DataFrame, min_cluster_size: int = 25, min_samples: int = 25, block_rows: int = PR.BLOCK_ROWS) -> DataFrame:
    """(id, cluster): the clusters of the density hierarchy that persist longest; noise is null.

    The cluster is the smallest id in it. Ids are unique. Rows without id are left out; those
    without features, or with a null or non-finite one, are noise. Fewer than ``min_cluster_size``
    rows, or rows that form one cluster only, are all noise. Other columns are not read.
    """
    if min_cluster_size < 2 or min_samples < 1:
        raise ValueError("min_cluster_size is at least 2, min_samples at least 1")
    ids = profiles.where(F.col("id").isNotNull()).select("id")
    usable = F.forall("features", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    points = profiles.where(F.col("id").isNotNull() & usable & (F.size("features") > 0)).select("id", F.col("features").cast("array<double>").alias("features"))
    points = stored(points)
    near = stored(PR.nearest(points, points, min_samples + 1, block_rows=block_rows))
    core = F.coalesce(F.max(F.when(F.col("rank") <= min_samples, F.col("distance"))), F.lit(0.0)).alias("core")
    # a row without a neighbour behind the core distance has all points in its list
    beyond = F.coalesce(F.max(F.when(F.col("rank") > min_samples, F.col("distance"))), F.lit(float("inf"))).alias("beyond")
    reach = stored(points.join(near.groupBy("id").agg(core, beyond), "id"))
    edges = stored(spanning_tree(reach, near, block_rows))
    entry = stored(entries(edges, min_cluster_size).where("entry IS NOT NULL"))
    if entry.isEmpty():
        return ids.select("id", F.lit(None).cast(ids.schema["id"].dataType).alias("cluster"))

    at = lambda end: PR.own_columns(entry).select(F.col("id").alias(end), F.col("entry").alias(f"__{end}"))
    known = edges.join(at("src"), "src").join(at("dst"), "dst").withColumn("e", F.struct("w", "src", "dst"))
    inner = F.col("e") <= F.greatest("__src", "__dst")
    known = stored(known.select("src", "dst", "e", inner.alias("inner")))
    region = stored(connected_components(known.where("inner").select("src", "dst")).select(F.col("node").alias("id"), F.col("component").alias("region")))
    side = lambda end, name: PR.own_columns(region).select(F.col("id").alias(end), F.col("region").alias(name))
    between = known.where(~F.col("inner")).join(side("src", "__a"), "src").join(side("dst", "__b"), "dst")
    mergers = between.groupBy(F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b")).agg(F.min("e").alias("e"))
    tree = stored(merger_tree(region.select("region").distinct(), mergers))

    # a point enters the highest cluster over its region that was formed before the point's entry
    jump = tree.select("node", F.col("parent").alias("to")).join(PR.own_columns(tree).select(F.col("node").alias("to"), F.col("e").alias("formed")), "to").select("node", "to", "formed")
    jumps, used = [], [points, near, reach, edges]
    while True:
        jump = stored(jump)
        used.append(jump)
        if jump.isEmpty():
            break
        jumps.append(jump)
        ahead = PR.own_columns(jump).select(F.col("node").alias("to"), F.col("to").alias("__to"), F.col("formed").alias("__formed"))
        jump = jump.select("node", "to").join(ahead, "to").select("node", F.col("__to").alias("to"), F.col("__formed").alias("formed"))
    leaves = tree.where("region IS NOT NULL").select("region", "node")
    placed = entry.join(region, "id").join(leaves, "region").select("id", "entry", "node")
    for jump in reversed(jumps):
        step = F.when(F.col("formed") < F.col("entry"), F.col("to")).otherwise(F.col("node")).alias("node")
        placed = placed.join(jump, "node", "left").select("id", "entry", step)
    placed = stored(placed)
    per_node = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum(1 / F.greatest(F.col("entry.w"), F.lit(LEAST))).alias("density"))
    clusters = tree.select("node", "parent", F.col("e.w").alias("w")).join(per_node, "node", "left")
    chosen = chosen_clusters(clusters.select("node", "parent", "w", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("density", F.lit(0.0)).alias("density")))
    member = stored(placed.join(chosen.where("chosen IS NOT NULL"), "node").select("id", "chosen"))
    names = member.groupBy("chosen").agg(F.min("id").alias("cluster"))
    discard(*used, entry, known, region, tree, placed)
    return ids.join(member.join(names, "chosen").select("id", "cluster"), "id", "left")
