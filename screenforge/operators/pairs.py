"""All-against-all work on vectors in bounded tiles.

Rows of both sides are hashed by id into blocks; a tile is one block of queries against one block
of references, so its size does not depend on labels, groups or hot keys. There are about ``TILES``
blocks of queries whatever their number, and a block of references holds up to ``RIGHT_ROWS``, so
what is shuffled grows in proportion to the rows. A tile is worked off in parts of at most
``block_rows``: distances of a part are one matrix product, the reductions of its parts (k nearest, sums
per group, counts between thresholds) are combined, and only they leave it — never the pairs. Tiles
are ordinary shuffle groups: Spark places, retries and spills them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 1024
MAX_PARTITIONS = 20_000
#: Blocks of queries, least and most queries of a block, most references of a block.
TILES, LEAST_ROWS, LEFT_ROWS, RIGHT_ROWS = 48, 128, 1 << 15, 1 << 18
#: Most queries and references of a part.
PART_LEFT, PART_RIGHT = 1024, 4096
#: Rows of parts that are held before they are combined.
HELD_ROWS = 1 << 20


def own_columns(df: DataFrame) -> DataFrame:
    """The same rows under new column identities, so a table can be grouped with itself."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def tile_reduce(
    left: DataFrame, right: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str, combine: Callable[[pa.Table], pa.Table],
    block_rows: int = BLOCK_ROWS, left_id: str = "id", right_id: str = "id", left_rows: int | None = None, right_rows: int | None = None,
) -> DataFrame:
    """Apply ``fn`` to the parts of every (left block, right block) tile. Empty blocks produce no tile.

    ``combine`` reduces the rows of several parts as the caller does with the rows of several tiles.
    Row counts may be given where the caller knows them; they only set the number of blocks.
    """
    n_left = left.count() if left_rows is None else left_rows
    n_right = right.count() if right_rows is None else right_rows
    nl = max(1, -(-n_left // max(min(block_rows, LEAST_ROWS), min(-(-n_left // TILES), LEFT_ROWS))))
    nr = max(1, -(-n_right // max(block_rows, RIGHT_ROWS)))
    # more partitions than tiles, so that few of them hold two
    parts = min(4 * nl * nr, MAX_PARTITIONS)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    l = left.withColumns({"__l": block(left_id, nl), "__r": F.explode(F.sequence(F.lit(0), F.lit(nr - 1)))})
    r = right.withColumns({"__r": block(right_id, nr), "__l": F.explode(F.sequence(F.lit(0), F.lit(nl - 1)))})
    # tiles are few bytes but much work: keep their number of tasks instead of letting AQE merge them
    l = l.repartition(parts, "__l", "__r")
    r = own_columns(r).repartition(parts, "__l", "__r")
    names = [part.strip().split()[0] for part in schema.split(",")]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows == 0 or b.num_rows == 0:
            return fn(a.slice(0, 0), b.slice(0, 0)).select(names)
        a, b = a.combine_chunks(), b.combine_chunks()
        done, height, width = [], min(block_rows, PART_LEFT), min(4 * block_rows, PART_RIGHT)
        for i in range(0, a.num_rows, height):
            held, rows = [], 0
            for j in range(0, b.num_rows, width):
                held.append(fn(a.slice(i, height), b.slice(j, width)).select(names))
                rows += held[-1].num_rows
                if len(held) > 1 and rows > HELD_ROWS:
                    held = [combine(pa.concat_tables(held)).select(names)]
                    rows = 0
            done.append(combine(pa.concat_tables(held)).select(names) if len(held) > 1 else held[0])
        return pa.concat_tables(done)

    return l.groupBy("__l", "__r").cogroup(r.groupBy("__l", "__r")).applyInArrow(run, schema)


def summed(t: pa.Table, keys: Sequence[str], how: dict[str, str]) -> pa.Table:
    """Rows of equal keys as one, each other column reduced by its function."""
    out = t.group_by(list(keys), use_threads=False).aggregate([(c, f) for c, f in how.items()])
    return out.select([*keys, *[f"{c}_{f}" for c, f in how.items()]]).rename_columns([*keys, *how])


def _codes_of(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _equal_ids(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a, in b) of equal ids."""
    at: dict = {}
    for j, v in enumerate(b.to_pylist()):
        at.setdefault(v, []).append(j)
    both = [(i, j) for i, v in enumerate(a.to_pylist()) for j in at.get(v, ())]
    return np.array([i for i, _ in both], np.int64), np.array([j for _, j in both], np.int64)


def matrix(t: pa.Table, column: str = "features") -> np.ndarray:
    col = t.column(column).combine_chunks()
    if len(col) == 0:
        return np.zeros((0, 0))
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    return np.asarray(col.flatten(), dtype=np.float64).reshape(len(col), -1)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.size == 0 or b.size == 0:
        return np.zeros((len(a), len(b)))
    c = b.mean(axis=0)
    x, y = a - c, b - c
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :]
    d -= x @ (2.0 * y).T
    return np.maximum(d, 0.0, out=d)


def unit_rows(a: np.ndarray) -> np.ndarray:
    n = np.sqrt((a * a).sum(1, keepdims=True))
    return np.divide(a, n, out=np.zeros_like(a), where=n > 0)


def nearest(queries: DataFrame, refs: DataFrame, k: int, ref_columns: Sequence[str] = (), exclude_same_id: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, rank, ref_id, distance, ref columns): the k nearest references by Euclidean distance, ties by id.

    Each tile keeps k per query; the final choice per query is over k rows per tile.
    """
    q = queries.select("id", "features")
    r = refs.select(F.col("id").alias("ref_id"), F.col("features"))
    id_type, ref_type = q.schema["id"].dataType.simpleString(), r.schema["ref_id"].dataType.simpleString()

    def top(a: pa.Table, b: pa.Table) -> pa.Table:
        rows = cols = np.zeros(0, np.int64)
        exact = np.zeros(0)
        if a.num_rows and b.num_rows:
            x, y = matrix(a), matrix(b)
            d2 = squared_distances(x, y)
            if exclude_same_id:
                d2[_equal_ids(a.column("id"), b.column("ref_id"))] = np.inf
            # all rows that rounding may put among the k nearest, equal ones included
            kth = np.partition(d2, k - 1, axis=1)[:, k - 1] if k < len(y) else np.full(len(x), np.inf)
            c = y.mean(axis=0)
            slack = 1e-12 * (((x - c) ** 2).sum(1) + ((y - c) ** 2).sum(1).max())
            rows, cols = np.nonzero((d2 <= (kth + slack)[:, None]) & (d2 < np.inf))
            step = 1 << 18
            exact = np.concatenate([np.zeros(0), *[np.sqrt(((y[cols[i:i + step]] - x[rows[i:i + step]]) ** 2).sum(1)) for i in range(0, len(rows), step)]])
            rank = np.empty(len(y), np.int64)
            rank[pc.sort_indices(b.column("ref_id")).to_numpy()] = np.arange(len(y))
            order = np.lexsort((rank[cols], exact, rows))
            rows, cols, exact = rows[order], cols[order], exact[order]
            kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            rows, cols, exact = rows[kept], cols[kept], exact[kept]
        take = lambda t, c, at: t.column(c).take(pa.array(at, pa.int64()))
        return pa.table({"id": take(a, "id", rows), "ref_id": take(b, "ref_id", cols), "distance": pa.array(exact, pa.float64())})

    def least(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("distance", "ascending"), ("ref_id", "ascending")])
        code = _codes_of(t.column("id"))
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        place = np.arange(len(code)) - np.repeat(starts, np.diff(np.r_[starts, len(code)]))
        return t.filter(pa.array(place < k))

    per_tile = tile_reduce(q, r, top, f"id {id_type}, ref_id {ref_type}, distance double", least, block_rows, right_id="ref_id")
    best = per_tile.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "ref_id"))), 1, k).alias("n"))
    out = best.select("id", F.posexplode("n").alias("rank", "n")).select("id", (F.col("rank") + 1).alias("rank"), "n.ref_id", "n.distance")
    if not ref_columns:
        return out
    return out.join(refs.select(F.col("id").alias("ref_id"), *[F.col(c).alias(f"ref_{c}") for c in ref_columns]), "ref_id")


def group_distances(queries: DataFrame, refs: DataFrame, group: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, ref_group, n, total, largest): count, sum and maximum of distances from each query to each reference group, itself excluded."""
    q = queries.select("id", "features")
    r = refs.select(F.col("id").alias("ref_id"), F.col(group).cast("string").alias("ref_group"), "features")
    id_type = q.schema["id"].dataType.simpleString()

    def sums(a: pa.Table, b: pa.Table) -> pa.Table:
        coded = b.column("ref_group").combine_chunks().dictionary_encode(null_encoding="encode")
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        if not (a.num_rows and b.num_rows):
            n = total = big = np.zeros((0, 0))
        else:
            # references in order of their group: a group is one run of columns
            order = np.argsort(code, kind="stable")
            b, code = b.take(pa.array(order)), code[order]
            starts = np.searchsorted(code, np.arange(len(names)))
            d = squared_distances(matrix(a), matrix(b))
            np.sqrt(d, out=d)
            same = _equal_ids(a.column("id"), b.column("ref_id"))
            d[same] = 0.0
            n = np.tile(np.diff(np.r_[starts, len(code)]), (a.num_rows, 1))
            np.subtract.at(n, (same[0], code[same[1]]), 1)
            total, big = np.add.reduceat(d, starts, axis=1), np.maximum.reduceat(d, starts, axis=1)
        rows, groups = np.repeat(np.arange(len(n)), len(names)), np.tile(np.arange(len(names)), len(n))
        return pa.table({
            "id": a.column("id").take(pa.array(rows, pa.int64())), "ref_group": names.take(pa.array(groups, pa.int64())).cast(pa.string()),
            "n": pa.array(n.ravel().astype(np.int64)), "total": pa.array(total.ravel()), "largest": pa.array(big.ravel()),
        })

    per = tile_reduce(
        q, r, sums, f"id {id_type}, ref_group string, n long, total double, largest double",
        lambda t: summed(t, ["id", "ref_group"], {"n": "sum", "total": "sum", "largest": "max"}), block_rows, right_id="ref_id",
    )
    return per.groupBy("id", "ref_group").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("largest").alias("largest")).where("n > 0")


def neighbour_counts(points: DataFrame, eps: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, n): points within ``eps`` of each point, itself included."""
    q = points.select("id", "features")
    id_type = q.schema["id"].dataType.simpleString()

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        n = (squared_distances(matrix(a), matrix(b)) <= eps * eps).sum(1) if a.num_rows else np.array([], int)
        return pa.table({"id": a.column("id"), "n": pa.array(n.astype(np.int64))})

    per = tile_reduce(q, q, count, f"id {id_type}, n long", lambda t: summed(t, ["id"], {"n": "sum"}), block_rows)
    return per.groupBy("id").agg(F.sum("n").alias("n"))


def neighbour_forest(left: DataFrame, right: DataFrame, eps: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(src, dst): for each tile, edges that connect the same points as all its pairs within ``eps`` do.

    A tile emits a spanning forest, at most its number of points less one, however dense it is.
    """
    q = left.select("id", "features")
    r = right.select(F.col("id").alias("ref_id"), "features")
    id_type = q.schema["id"].dataType.simpleString()

    def forest(a: pa.Table, b: pa.Table) -> pa.Table:
        ai, bi = a.column("id").to_pylist(), b.column("ref_id").to_pylist()
        near = squared_distances(matrix(a), matrix(b)) <= eps * eps
        seen_a, seen_b = np.zeros(len(ai), bool), np.zeros(len(bi), bool)
        src, dst = [], []
        for start in range(len(ai)):
            if seen_a[start]:
                continue
            seen_a[start] = True
            stack = [("a", start)]
            while stack:
                side, i = stack.pop()
                if side == "a":
                    for j in np.flatnonzero(near[i] & ~seen_b):
                        seen_b[j] = True
                        if ai[i] != bi[j]:
                            src.append(ai[i])
                            dst.append(bi[j])
                        stack.append(("b", int(j)))
                else:
                    for j in np.flatnonzero(near[:, i] & ~seen_a):
                        seen_a[j] = True
                        if ai[j] != bi[i]:
                            src.append(ai[j])
                            dst.append(bi[i])
                        stack.append(("a", int(j)))
        t = a.schema.field("id").type
        return pa.table({"src": pa.array(src, t), "dst": pa.array(dst, t)})

    def joined(t: pa.Table) -> pa.Table:
        root: dict = {}

        def find(v):
            while root.setdefault(v, v) != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        keep = []
        for i, (u, v) in enumerate(zip(t.column("src").to_pylist(), t.column("dst").to_pylist(), strict=True)):
            u, v = find(u), find(v)
            if u != v:
                root[u] = v
                keep.append(i)
        return t.take(pa.array(keep, pa.int64()))

    return tile_reduce(q, r, forest, f"src {id_type}, dst {id_type}", joined, block_rows, right_id="ref_id").distinct()
