"""Near-duplicate documents by MinHash bands, odd sketches and a full check.

The MinHash samples of a document's shingle set are folded into a bitmap by parity: each sample
flips one bit. The XOR of two bitmaps counts the samples that differ, so its population count
estimates high similarities well; candidates that share a band are compared by it before their full
sets are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenforge.llm.text import hash64, slices, splitmix, words
from screenforge.operators.graph import connected_components
from screenforge.session import checkpointed

#: MinHash samples, bands (of SAMPLES / BANDS samples), bits of the odd sketch.
#: A pair at similarity 0.8 shares no band with chance (1 - 0.8 ** 4) ** 32 < 5e-8.
SAMPLES, BANDS, BITS = 128, 32, 512
#: Members, and shingles of theirs, that a tile of a bucket has at most about.
TILE, TILE_SHINGLES = 2048, 1 << 21
_A = splitmix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)
_B = splitmix(np.arange(1, SAMPLES + 1, dtype=np.uint64) + np.uint64(1 << 32))


def shingles(found: list[bytes], size: int) -> set[bytes]:
    """Distinct shingles of ``size`` words; a shorter sequence is one shingle, no words are none."""
    if len(found) < size:
        return {b" ".join(found)} if found else set()
    return set(map(b" ".join, zip(*(found[i:] for i in range(size)), strict=False)))


def minhash(h: np.ndarray) -> np.ndarray:
    """SAMPLES minima of multiply-add hashes (upper 32 bits) over the shingle hashes ``h``."""
    out = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 1024):
            out = np.minimum(out, (h[at : at + 1024, None] * _A + _B).min(0))
    return (out >> np.uint64(32)).astype(np.uint64)


def odd_sketch(samples: np.ndarray) -> bytes:
    """Bitmap of BITS bits in which every (sample number, value) flips one bit."""
    with np.errstate(over="ignore"):
        bit = (splitmix(samples + (np.arange(len(samples), dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)).astype(np.int64)
    return np.packbits(np.bincount(bit, minlength=BITS) % 2 == 1).tobytes()


def most_differing(similarity: float) -> int:
    """XOR population count that a pair at ``similarity`` or above exceeds with a chance of about 2e-9.

    Mean plus six standard deviations: those of the MinHash sample and of the bitmap's collisions.
    """
    differing = 2 * SAMPLES * (1 - similarity)  # a sample that differs flips a bit in either bitmap
    left = math.exp(-2 * differing / BITS)
    spread = math.hypot(2 * left * math.sqrt(SAMPLES * similarity * (1 - similarity)), math.sqrt(BITS / 4 * (1 - left**2)))
    return min(BITS, math.ceil(BITS / 2 * (1 - left) + 6 * spread))


_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, bands, sketch) per row; set_id is a 128-bit digest of the whole set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = SAMPLES // BANDS
        salt = np.arange(1, BANDS + 1, dtype=np.uint64)
        for b in slices(batches):
            n, ids, bands, sketches = [], [], [], []
            for text in b.column("text").to_pylist():
                found = shingles(words(text), size)
                n.append(len(found))
                if not found:
                    ids.append(None)
                    bands.append(None)
                    sketches.append(None)
                    continue
                h = hash64(list(found))
                m = minhash(h)
                ids.append(hashlib.md5(np.sort(h).tobytes()).digest())
                key = salt
                for j in range(rows):
                    key = splitmix(key ^ splitmix(m[j::rows] + np.uint64(j + 1)))
                bands.append(key.view(np.int64))
                sketches.append(odd_sketch(m))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], schema=_SETS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_id binary, bands array<long>, sketch binary")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    Of ids repeated with other texts each version is compared.
    """
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep, last, held = [], None, set()
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                if x != last:
                    last, held = x, shingles(words(x), size)
                other = shingles(words(y), size)
                common = len(held & other)
                keep.append(common > 0 and 100 * common >= percent * (len(held) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def full_sets(texts: DataFrame, size: int) -> DataFrame:
    """(doc_id, full): sorted 64-bit hashes of the whole shingle set, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            full = [np.unique(hash64(list(shingles(words(t), size)))).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(full, pa.binary())], names=["doc_id", "full"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, full binary")


def _same(x: np.ndarray, y: np.ndarray) -> int:
    """Common values of two sorted arrays without repetition."""
    both = np.concatenate((x, y))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _search_cell(one: dict, two: dict, alone: bool, most: int, percent: int) -> list[tuple[int, int]]:
    """Links between different components of two tiles of a bucket: a forest over the components.

    Bitmaps and sizes go first; a pair that shares an earlier band is left to that band's bucket.
    Full sets decide, unless the components have met in the meantime.
    """
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := root.setdefault(x, x)) != x:
            root[x] = root[p]
            x = p
        return x

    out, step = [], 256
    for at in range(0, len(one["node"]), step):
        here = slice(at, at + step)
        hit = np.zeros((len(one["node"][here]), len(two["node"])), np.uint16)
        for w in range(one["sketch"].shape[1]):
            hit += np.bitwise_count(one["sketch"][here, None, w] ^ two["sketch"][None, :, w])
        n, m = one["n"][here, None], two["n"][None]
        near = (hit <= most) & (one["component"][here, None] != two["component"][None]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        if alone:
            near &= one["node"][here, None] < two["node"][None]
        i, j = np.nonzero(near)
        band = one["band"]
        if band:
            first = ~(one["bands"][here][i, :band] == two["bands"][j, :band]).any(1)
            i, j = i[first], j[first]
        for a, b in zip((i + at).tolist(), j.tolist(), strict=True):
            p, q = find(int(one["component"][a])), find(int(two["component"][b]))
            if p == q:
                continue
            x, y = one["full"][a], two["full"][b]
            common = _same(x, y)
            if common and 100 * common >= percent * (len(x) + len(y) - common):
                root[p] = q
                out.append((int(one["node"][a]), int(two["node"][b])))
    return out


def across(open_: DataFrame, most: int, percent: int) -> DataFrame:
    """(a, b): confirmed links between different components of a bucket.

    ``open_`` has key, band, node, component, n, bands, sketch, full and the tiles of its bucket. Every
    two tiles of a bucket meet in a task of their own; it emits at most one link per component.
    """
    tiled = open_.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cells = tiled.select("key", F.least("tile", "to").alias("p"), F.greatest("tile", "to").alias("q"), (F.col("tile") > F.col("to")).alias("second"), "band", "node", "component", "n", "bands", "sketch", "full")

    def side(rows: list[tuple]) -> dict:
        column = lambda k: [r[k] for r in rows]
        return {
            "band": rows[0][4], "node": np.array(column(5)), "component": np.array(column(6)), "n": np.array(column(7)), "bands": np.array(column(8), np.int64),
            "sketch": np.frombuffer(b"".join(column(9)), np.uint64).reshape(len(rows), -1), "full": [np.frombuffer(x, np.uint64) for x in column(10)],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> pa.RecordBatch:
            one = [r for r in rows if not r[3]]
            two = one if rows and rows[0][1] == rows[0][2] else [r for r in rows if r[3]]
            found = _search_cell(side(one), side(two), one is two, most, percent) if one and two else []
            return pa.RecordBatch.from_pydict({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})

        rows: list[tuple] = []
        for batch in slices(batches):
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[0][:3] != r[:3]:
                    yield done(rows)
                    rows = []
                rows.append(r)
        yield done(rows)

    return cells.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``.

    component_id is the smallest doc_id reached by links, itself included; two documents are linked
    if 100 * intersection >= percent * union of their sets of ``size``-word shingles. Texts that are
    null or have no word have an empty set and link with nothing. A row with a null doc_id links
    with nothing, has no component and is kept. Rows that share a doc_id are one node, linked by
    what any of them links with, and keep their own n_shingles. Only doc_id and text are read.

    Equal sets become one node first. Each bucket then links its members with its smallest one,
    which joins large groups at a cost linear in their size; buckets whose members still lie in
    different components are searched across components in tiles. No cap: a bucket of any size is
    searched whole.
    """
    rows = checkpointed(sketched(docs, size))
    sets = rows.where("set_id IS NOT NULL AND doc_id IS NOT NULL")
    node = checkpointed(sets.groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n")))
    members = node.select(F.posexplode("bands").alias("band", "key"), "node").select(F.xxhash64("band", "key").alias("key"), "band", "node")
    low = members.groupBy("key").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "low")
    shared = checkpointed(members.join(low, "key"))
    texts = checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(shared.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    most = most_differing(percent / 100)
    info = node.select("node", "n", "sketch")

    def plausible(pairs: DataFrame) -> DataFrame:
        both = pairs.join(info.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a").join(info.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
        sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
        words_ = [F.bit_count(F.conv(F.hex(F.substring("sa", 8 * i + 1 + 4 * h, 4)), 16, 10).cast("long").bitwiseXOR(F.conv(F.hex(F.substring("sb", 8 * i + 1 + 4 * h, 4)), 16, 10).cast("long"))) for i in range(BITS // 64) for h in (0, 1)]
        return both.where(sizes & (sum(words_[1:], words_[0]) <= most)).select("a", "b")

    star = checkpointed(plausible(shared.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()))
    links = checkpointed(confirmed(star, texts, size, percent))
    # a doc_id with several sets is one node of the graph: its sets meet in their smallest ids
    same = sets.join(node.select("set_id", "node"), "set_id").where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct()
    parts = _components(links, node)
    # a bucket's smallest node has met all others; what is left matters if it has several components
    mixed = shared.where("node <> low").join(parts, "node").join(info.select("node", "n"), "node").select("key", "band", "node", "component", "n")
    tiles = F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") / TILE_SHINGLES)).cast("int")
    several = mixed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), tiles.alias("tiles")).where("x <> y").select("key", "tiles")
    open_ = checkpointed(mixed.join(several, "key"))
    full = full_sets(texts.join(open_.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"), size).withColumnRenamed("doc_id", "node")
    more = across(open_.join(node.select("node", "bands", "sketch"), "node").join(full, "node"), most, percent)
    links = checkpointed(links.union(more).union(same))
    final = connected_components(links, "a", "b")
    own = rows.join(final.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return own.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _components(links: DataFrame, node: DataFrame) -> DataFrame:
    found = connected_components(links, "a", "b")
    return node.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
