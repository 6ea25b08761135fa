"""Hard negatives from candidate blocks in Hilbert order, chosen by zone maps.

Candidates are written to Parquet along a Hilbert curve through a projection of their directions,
cut into blocks of one label. A block's zone map has the least and largest value of every dimension.
For an anchor, interval arithmetic over the zone map bounds every inner product in the block, so a
block is read only where the bound reaches the anchor's positives or one of its negative windows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenforge.llm.packs import pack, unpack
from screenforge.session import checkpointed, shared_folder

#: Rows of a block; anchors that travel together; zone maps of a page; rows of one range partition.
BLOCK, ANCHORS, PAGE, PART = 256, 1024, 512, 65_536
#: Candidates that a task holds before it cuts them to the first of each range.
HELD = 500_000
#: Directions of the projection that the curve runs through, and bits of each.
CURVE_DIMS, CURVE_BITS = 7, 9


def curve(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of every row of ``cells`` (integers below 2^bits per column) along the Hilbert curve.

    The row's bits are undone level by level: each level's reflection or exchange of axes is applied
    to all lower bits, then the Gray code over the axes is decoded.
    """
    x = cells.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > one:
        low = q - one
        for i in range(dims):
            flip = (x[i] & q) > 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = one << np.uint64(bits - 1)
    while q > one:
        t = np.where(x[-1] & q > 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out.astype(np.int64)


def curve_of(vectors: np.ndarray, seed: int = 5) -> np.ndarray:
    """Curve places of vectors' directions in a fixed random projection."""
    size = vectors.shape[1]
    if not size:
        return np.zeros(len(vectors), np.int64)
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, min(size, CURVE_DIMS))))
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0) @ q
    top = 1 << CURVE_BITS
    # a component of a random direction is seldom beyond three of its deviations
    return curve(np.clip((unit * np.sqrt(size) / 3 + 1) * top / 2, 0, top - 1).astype(np.int64), CURVE_BITS)


def taking_part(embeddings: DataFrame, label: Column | None = None) -> DataFrame:
    """(row, vec_id, label, size, x) of the rows that take part, x in whole numbers; equal rows once, ``row`` names them."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), "embedding")
    live = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    whole = F.transform(v, lambda x: F.floor(256 * x).cast("long"))
    named = live.select("vec_id", "label", F.size("embedding").alias("size"), whole.alias("x")).dropDuplicates(["vec_id", "label", "x"])
    return named.withColumn("row", F.xxhash64("vec_id", "label", "x"))


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    got = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return got.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(got), size)


def blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(block, size, label, n, low, high, ids, x): blocks of one label along the curve with their zone maps."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.zeros(b.num_rows, np.int64)
            sizes = b.column("size").to_numpy()
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                at[own] = curve_of(_matrix(b.column("x").take(pa.array(own)), int(size)).astype(float))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=["vec_id", "label", "size", "x", "at"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t: pa.Table) -> pa.RecordBatch:
            size = t.column("size")[0].as_py()
            x = _matrix(t.column("x"), size)
            return pa.RecordBatch.from_arrays([
                pa.array([uuid.uuid4().hex]), pa.array([size], pa.int32()), pa.array([t.column("label")[0].as_py()], pa.int64()), pa.array([len(x)], pa.int32()),
                pa.array([x.min(0).tolist()], pa.list_(pa.int64())), pa.array([x.max(0).tolist()], pa.list_(pa.int64())),
                pa.array([t.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([pack([x.ravel()])], pa.binary()),
            ], names=["block", "size", "label", "n", "low", "high", "ids", "x"])

        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
            kind = rest.column("size").to_numpy() * 31 + rest.column("label").to_numpy()
            new = np.flatnonzero(np.diff(kind, prepend=kind[:1] - 1)) if len(kind) else np.zeros(0, np.int64)
            done = 0
            for start, stop in zip(new, np.append(new[1:], len(kind)), strict=True):
                for at in range(start, stop, block):
                    if at + block <= stop or stop < len(kind):
                        yield out(rest.slice(at, min(block, stop - at)))
                        done = min(at + block, stop)
            rest = rest.slice(done)
        if rest is not None and rest.num_rows:
            yield out(rest)

    parts = max(1, -(-rows.count() // PART))
    placed = rows.select("vec_id", "label", "size", "x").mapInArrow(place, "vec_id long, label long, size int, x array<long>, at long")
    keys = ["size", "label", "at", "vec_id"]
    ordered = placed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(cut, "block string, size int, label long, n int, low array<long>, high array<long>, ids array<long>, x binary")


def stored(found: DataFrame) -> DataFrame:
    """``found`` written as Parquet in the shared folder and read back: zone maps are read without vectors."""
    spark = found.sparkSession
    path = f"{shared_folder(spark)}/blocks-{uuid.uuid4().hex}"
    found.write.parquet(path)
    return spark.read.parquet(path)


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[anchor, block] least and largest possible inner product: each term takes one end of its interval."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return product(up, low) + product(down, high), product(up, high) + product(down, low)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[row of a, row of b] exact inner products; by floating point where no sum can leave its whole numbers."""
    most = (int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])) if a.size and b.size else 0
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 1 << 53 else a @ b.T


def _packs(anchors: DataFrame) -> DataFrame:
    """(size, pack, row, vec_id, label, x, lows, highs): the anchors of a pack with their wanted score ranges."""
    cols = ["row", "vec_id", "label", "x", "lows", "highs"]
    got = anchors.groupBy("size", "pack").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("a"))
    return checkpointed(got.select("size", "pack", *[F.col(f"a.{c}").alias(c) for c in cols]))


def _nested(value: pa.ListScalar, size: int) -> np.ndarray:
    """Matrix of a list of vectors of ``size``."""
    return value.values.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(value.values), size)


def chosen(packs: DataFrame, zones: DataFrame, same_label: bool) -> DataFrame:
    """(size, pack, block, asking): the blocks that a pack's anchors must read, and the ``row`` of those that ask.

    Zone maps meet the packs in pages. A block is read by an anchor if its label is (or is not) the
    anchor's and its interval of inner products meets one of the anchor's wanted ranges.
    """
    n_pages = max(1, -(-zones.count() // PAGE))
    paged = zones.withColumn("page", F.pmod(F.xxhash64("block"), F.lit(n_pages)).cast("int"))
    pages = paged.groupBy("size", "page").agg(*[F.collect_list(c).alias(f"z_{c}") for c in ("block", "label", "low", "high")])
    asked = packs.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                at = {c: b.column(c)[k] for c in b.schema.names}
                size, row = at["size"].as_py(), at["row"].values.to_numpy()
                least, most = bounds(_nested(at["x"], size), _nested(at["z_low"], size), _nested(at["z_high"], size))
                meets = np.zeros(least.shape, bool)
                for i, (lo, hi) in enumerate(zip(at["lows"].as_py(), at["highs"].as_py(), strict=True)):
                    for u, v in zip(lo, hi, strict=True):
                        meets[i] |= (most[i] >= u) & (least[i] <= v)
                meets &= (at["label"].values.to_numpy()[:, None] == at["z_label"].values.to_numpy()[None]) == same_label
                hit = np.flatnonzero(meets.any(0))
                yield pa.RecordBatch.from_arrays([
                    pa.array([size] * len(hit), pa.int32()), pa.array([at["pack"].as_py()] * len(hit), pa.int32()), at["z_block"].values.take(pa.array(hit)),
                    pa.array([row[meets[:, j]].tolist() for j in hit], pa.list_(pa.int64())),
                ], names=["size", "pack", "block", "asking"])

    return asked.join(pages, ["size", "page"]).select(*packs.columns, "z_block", "z_label", "z_low", "z_high").mapInArrow(run, "size int, pack int, block string, asking array<long>")


_FOUND = ["row", "anchor_id", "lo", "hi", "vec_id", "score"]


def _cut(found: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` columns of ``found`` (in the order of _FOUND) for every row and range."""
    found = found[:, np.lexsort((found[4], -found[5], found[3], found[2], found[0]))]
    new = np.ones(found.shape[1], bool)
    new[1:] = (found[:, 1:] != found[:, :-1])[[0, 2, 3]].any(0)
    start = np.flatnonzero(new)
    place = np.arange(found.shape[1]) - np.repeat(start, np.diff(np.append(start, found.shape[1])))
    return found[:, place < k]


def read(asking: DataFrame, packs: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """(row, anchor_id, lo, hi, vec_id, score): the first ``k`` rows of each asking anchor's ranges in the blocks of a task.

    A range's rows are ordered by falling score, then vec_id; the anchor's own vec_id is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((6, 0), np.int64)
        parts, n = [held], 0
        for b in batches:
            for i in range(b.num_rows):
                at = {c: b.column(c)[i] for c in b.schema.names}
                size, row = at["size"].as_py(), at["row"].values.to_numpy()
                mine = np.flatnonzero(np.isin(row, at["asking"].values.to_numpy()))
                ids, own = at["ids"].values.to_numpy(), at["vec_id"].values.to_numpy()
                score = product(_nested(at["x"], size)[mine], unpack(at["c"].as_py())[0].reshape(len(ids), size))
                lows, highs = at["lows"].as_py(), at["highs"].as_py()
                for a, s in zip(mine, score, strict=True):
                    for lo, hi in zip(lows[a], highs[a], strict=True):
                        hit = np.flatnonzero((s >= lo) & (s <= hi) & (ids != own[a]))
                        hit = hit[np.lexsort((ids[hit], -s[hit]))[:k]]
                        if len(hit):
                            parts.append(np.array([np.full(len(hit), v) for v in (row[a], own[a], lo, hi)] + [ids[hit], s[hit]]))
                            n += len(hit)
                if n > HELD:
                    held = _cut(np.concatenate(parts, axis=1), k)
                    parts, n = [held], held.shape[1]
                    if n > HELD // 2:  # as many anchors: leave the rest to the final cut
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=_FOUND)
                        parts, n = [held[:, :0]], 0
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _cut(np.concatenate(parts, axis=1), k)], names=_FOUND)

    joined = asking.join(table.select("block", "ids", F.col("x").alias("c")), "block").join(packs, ["size", "pack"])
    return joined.select("size", "asking", "ids", "c", *packs.columns[2:]).mapInArrow(run, "row long, anchor_id long, lo long, hi long, vec_id long, score long")


def first(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first ``k`` rows of every key by falling score and vec_id, numbered from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def mine(
    embeddings: DataFrame, label: Column | None = None, is_anchor: str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 5, least: int = 80, block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor's positives.

    Vectors are taken in whole numbers floor(256 x). An anchor's positives are its first other rows
    of its label by falling inner product, then vec_id; for each, its negatives are the first rows
    of other labels whose score is at most the positive's and at least ``least`` per cent of it.
    ``label`` may replace the column of that name.

    Rows with a null vec_id, label or vector, or a null or non-finite component, take no part.
    Equal rows are one; other rows that share a vec_id stay rows of their own, but are no positive
    or negative of an anchor with that vec_id. Vectors of different lengths do not meet. Only
    vec_id, embedding and label are read; an empty table gives no rows. Scores must fit in 64 bits.

    Three readings: every anchor's own block gives a score that its positives must reach; the blocks
    of its label whose bound reaches that give the positives; the blocks of other labels whose
    bounds meet one of the windows give the negatives.
    """
    low, high = F.lit(-(1 << 63)), F.lit((1 << 63) - 1)
    rows = checkpointed(taking_part(embeddings, label))
    table = stored(blocks(rows, block))
    zones = table.select("block", "size", "label", "low", "high")
    asked = rows.where(is_anchor)
    n_packs = max(1, -(-asked.count() // ANCHORS))
    asked = asked.withColumn("pack", F.pmod("row", F.lit(n_packs)).cast("int"))

    home = table.select("block", "size", "label", F.explode("ids").alias("vec_id")).where(is_anchor).join(asked.select("row", "vec_id", "size", "label", "pack"), ["vec_id", "size", "label"])
    packs = _packs(asked.withColumns({"lows": F.array(low), "highs": F.array(high)}))
    begun = first(read(home.groupBy("size", "pack", "block").agg(F.collect_set("row").alias("asking")), packs, table, positives), positives, "row")
    bar = begun.groupBy("row").agg(F.when(F.count(F.lit(1)) >= positives, F.min("score")).alias("bar"))
    packs = _packs(asked.join(bar, "row", "left").withColumns({"lows": F.array(F.coalesce("bar", low)), "highs": F.array(high)}))
    near = checkpointed(first(read(chosen(packs, zones, True), packs, table, positives), positives, "row").select("row", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    window = F.struct(F.expr(f"({least} * positive_score + 99) div 100").alias("lo"), F.col("positive_score").alias("hi"))
    ranges = near.where("positive_score >= 0").groupBy("row").agg(F.collect_set(window).alias("w"))
    packs = _packs(asked.join(ranges, "row").withColumns({"lows": F.transform("w", lambda w: w["lo"]), "highs": F.transform("w", lambda w: w["hi"])}))
    far = first(read(chosen(packs, zones, False), packs, table, negatives), negatives, "row", "lo", "hi")
    wanted = far.select("row", F.col("hi").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(wanted, ["row", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
