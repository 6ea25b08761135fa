"""Near-duplicate vectors by an exact metric range join.

Pivots partition the unit vectors of a label into cells. Since cosine >= c means a distance of at
most r = sqrt(2 - 2c), a vector must also be seen in another pivot's cell only if, by the triangle
inequality, d(x, that pivot) <= d(x, own pivot) + 2 r. Cells are then joined independently.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenforge.llm.vectors import matrix, packed, usable
from screenforge.operators.graph import connected_components
from screenforge.session import checkpointed

#: Vectors wanted per cell, most pivots of a label, rows of a tile of a cell's own vectors and of those seen in it.
CELL, PIVOTS, TILE, SEEN = 2048, 256, 2048, 8192
_SLACK = 1e-9


def _pivots(vectors: DataFrame, cell: int) -> dict:
    """label: (pivot vectors, ids) - about one per ``cell`` vectors of the label, PIVOTS at most, drawn by hash."""
    totals = {r["label"]: r["n"] for r in vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.lit(0)
    for label, n in totals.items():
        wanted = min(PIVOTS, -(-n // cell))
        rate = F.when(F.col("label") == label, F.lit(int(min(1.0, 3 * (wanted + 2) / n) * (1 << 30)))).otherwise(rate)
    drawn = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) < rate).select("label", "vec_id", "v").orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").collect()
    out: dict = {}
    for label, n in totals.items():
        own = [np.frombuffer(r["v"], "<f8") for r in drawn if r["label"] == label][: min(PIVOTS, -(-n // cell))]
        if own:
            p = np.array(own)
            out[label] = p / np.linalg.norm(p, axis=1, keepdims=True)
    return out


def cells(vectors: DataFrame, radius: float, cell: int = CELL) -> DataFrame:
    """(label, cell, own, vec_id, copies, v): a row for the vector's own cell and every smaller one in which it must be seen.

    A label without a drawn pivot is one cell.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(_pivots(vectors, cell))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            labels = np.array(b.column("label").to_pylist(), object)
            own, where, home = [], [], []
            for label in set(labels.tolist()):
                at = np.flatnonzero(labels == label)
                if label not in pivots:
                    d = np.zeros((len(at), 1))
                else:
                    x = matrix(b.column("v").take(pa.array(at)))  # of one length, which the label holds
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    d = np.sqrt(np.maximum(0.0, 2 - 2 * x @ pivots[label].T))
                near = d.argmin(1)
                seen = d <= d[np.arange(len(at)), near][:, None] + 2 * radius + _SLACK
                i, j = np.nonzero(seen & (np.arange(d.shape[1]) <= near[:, None]))
                own.append(at[i])
                where.append(j)
                home.append(j == near[i])
            rows = pa.array(np.concatenate(own))
            yield pa.RecordBatch.from_arrays([b.column("label").take(rows), pa.array(np.concatenate(where).astype(np.int32)), pa.array(np.concatenate(home)), *(b.column(c).take(rows) for c in ("vec_id", "copies", "v"))], names=["label", "cell", "own", "vec_id", "copies", "v"])

    return vectors.select("label", "vec_id", "copies", "v").mapInArrow(run, f"label {vectors.schema['label'].dataType.simpleString()}, cell int, own boolean, vec_id long, copies long, v binary")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of (a, b) that connect what all of them connect: a spanning forest, by union-find."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := root.setdefault(x, x)) != x:
            root[x] = root[p]
            x = p
        return x

    left, right = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[p] = q
            left.append(x)
            right.append(y)
    return left, right


def joined(dealt: DataFrame, least: float) -> DataFrame:
    """(kind, a, b): kind 0 - vector a has b links in a tile; kind 1 - an edge of a tile's spanning forest.

    A cell's own vectors are cut into tiles, and every two of them meet in a task of their own, as
    does each of them with each tile of the vectors seen there. What leaves a task grows with its rows.
    """
    sizes = dealt.groupBy("label", "cell").agg(F.count_if("own").alias("__n"), F.count_if(~F.col("own")).alias("__m"))
    tiles, seen = F.ceil(F.col("__n") / TILE).cast("int"), F.ceil(F.col("__m") / SEEN).cast("int")
    numbered = dealt.join(sizes, ["label", "cell"]).where("__n > 0").withColumn("tile", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.when(F.col("own"), tiles).otherwise(seen)).cast("int"))
    # first tile, second tile, whether the row is of the second; tiles of vectors seen are numbered after the cell's own
    beside = F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: F.struct(F.least("tile", t).alias("p"), F.greatest("tile", t).alias("q"), (F.col("tile") > t).alias("second")))
    beyond = F.transform(F.sequence(F.lit(0), seen - 1), lambda t: F.struct(F.col("tile").alias("p"), (tiles + t).alias("q"), F.lit(False).alias("second")))
    met = F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: F.struct(t.alias("p"), (tiles + F.col("tile")).alias("q"), F.lit(True).alias("second")))
    rows = numbered.withColumn("to", F.explode(F.when(~F.col("own"), met).when(seen > 0, F.concat(beside, beyond)).otherwise(beside)))
    rows = rows.select("label", "cell", "to.*", "vec_id", "copies", "v")

    def compare(key, table):  # noqa: ANN001, ANN202 - hints would be strings here, which Spark does not read
        p, q = key[2].as_py(), key[3].as_py()
        second = table.column("second").to_numpy()
        x = matrix(table.column("v"))
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        ids, copies = (table.column(c).to_numpy() for c in ("vec_id", "copies"))
        one = np.flatnonzero(~second)
        two = one if p == q else np.flatnonzero(second)
        links = np.zeros(len(ids), np.int64)
        edges: list[tuple[int, int]] = []
        for at in range(0, len(one), 512):
            i = one[at : at + 512]
            hit = x[i] @ x[two].T >= least
            if p == q:
                hit &= ids[i][:, None] != ids[two][None]
                links[i] += hit @ copies[two]
                hit &= ids[i][:, None] < ids[two][None]
            else:
                links[i] += hit @ copies[two]
                links[two] += hit.T @ copies[i]
            r, c = np.nonzero(hit)
            edges += zip(*_forest(ids[i[r]], ids[two[c]]), strict=True)
        e = np.array(edges, np.int64).reshape(-1, 2)
        left, right = _forest(e[:, 0], e[:, 1])
        some = links > 0
        n, m = int(some.sum()), len(left)
        return pa.table({"kind": pa.array([0] * n + [1] * m, pa.int32()), "a": pa.array(ids[some].tolist() + left, pa.int64()), "b": pa.array(links[some].tolist() + right, pa.int64())})

    return rows.groupBy("label", "cell", "p", "q").applyInArrow(compare, "kind int, a long, b long")


def near_vectors(embeddings: DataFrame, least: float = 0.98, cell: int = CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``embeddings`` (vec_id, embedding, label).

    Rows link if their labels are equal and not null and their cosine, in double precision, is at
    least ``least``. Vectors that are null, zero, empty or hold null or non-finite components link
    with nothing, as do rows with a null label or vec_id; vectors of
    different lengths do not link. n_links counts the other rows linked directly; component_id
    is the smallest vec_id reached, itself included. A row with a null vec_id has no component and is
    kept. Rows that share a vec_id are each counted as others. Only the three columns are read.

    Equal vectors of a label become one first, with a number of copies.
    """
    ids = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").alias("__label"))
    # 0.0 and -0.0 are equal; the length is part of the label, so lengths never mix
    live = ids.where(usable(F.col("embedding")) & F.col("__label").isNotNull() & F.col("vec_id").isNotNull()).select(
        "vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("e"), F.concat_ws("/", F.col("__label").cast("string"), F.size("embedding").cast("string")).alias("label")
    )
    rows = checkpointed(packed(live, "e", "vec_id", "label"))
    one = checkpointed(rows.groupBy("label", "v").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")))
    radius = math.sqrt(max(0.0, 2 - 2 * least))
    found = checkpointed(joined(cells(one, radius, cell), least))
    links = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    per_vector = one.join(links, one["vec_id"] == links["node"], "left").select("label", "v", F.col("vec_id").alias("node"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    per_row = rows.join(per_vector, ["label", "v"]).select("vec_id", "node", "n_links")
    edges = found.where("kind = 1").select("a", "b").union(per_row.where("vec_id <> node").select(F.col("node").alias("a"), F.col("vec_id").alias("b")))
    comp = connected_components(edges, "a", "b").select(F.col("node").alias("vec_id"), "component")
    linked = checkpointed(per_row.groupBy("vec_id").agg(F.max("n_links").alias("n_links")))
    out = ids.select("vec_id", (usable(F.col("embedding")) & F.col("__label").isNotNull()).alias("__able")).join(linked, "vec_id", "left").join(comp, "vec_id", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.when(F.col("__able"), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
