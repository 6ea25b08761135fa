"""Retrieval scores of profiles: average precision by cosine rank, its null, and tables built on it.

Average precision of a query needs, for each of its positives, how many positives and negatives
rank at or above it. A group of queries meets all negatives and the rows of its labels in one task,
which scores a few queries at a time with one sort each: one row per query leaves it. There are about
``GROUPS`` groups, so what is shuffled grows in proportion to the references, which travel and are
held as single floats where these say the same. Where the references of a task exceed
``HELD_BYTES``, two reductions give the same without holding them or listing pairs:

1. positives: similarities of a query to the rows of its own label, as counts per similarity step
   (labels are cut into blocks, so a hot label is many bounded groups);
2. negatives: inside each tile, how many negatives fall between consecutive positive similarities
   of the query. Only non-zero counts leave the tile.

Similarities are compared in steps of 1e-6, the precision of single floats, so rounding noise
does not decide a rank; among equal similarities negatives rank first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenforge.functions.scalars import harmonic
from screenforge.operators.pairs import BLOCK_ROWS, MAX_PARTITIONS, matrix, own_columns, summed, tile_reduce, unit_rows
from screenforge.operators.skew import bh_adjust
from screenforge.session import checkpointed

STEPS = 1_000_000
SPAN = 4 * STEPS
#: Groups of queries that meet the references, and most bytes of references in one of them.
GROUPS, HELD_BYTES = 48, 1 << 29
#: Most similarity steps that a task holds at once, queries and references of one product, rows of a pack.
HELD_PAIRS, HELD_QUERIES, HELD_REFS, PACK = 1 << 24, 64, 1 << 11, 1 << 11
#: Most bytes of unit vectors that a task keeps; of more references some at a time are made.
HELD_UNITS = 1 << 27
#: Below every key of a similarity step; even, like those of positives.
_LAST = -(1 << 30)


def _codes(x: np.ndarray, y: np.ndarray, dims: Sequence[int] | None, variant: int) -> np.ndarray:
    """Similarity steps of all pairs as whole numbers, offset by variant."""
    a, b = (x, y) if dims is None else (x[:, dims], y[:, dims])
    return np.rint(unit_rows(a) @ unit_rows(b).T * STEPS).astype(np.int64) + STEPS + 1 + variant * SPAN


def _counted(rows: np.ndarray, codes: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, count) of the kept entries of a block, equal codes of a row combined."""
    top = int(codes.max()) + 1
    flat = (np.arange(len(rows))[:, None] * top + codes)[keep]
    key, n = np.unique(flat, return_counts=True)
    return rows[key // top], key % top, n


def _table(a: pa.Table, found: list, name: str) -> pa.Table:
    """Result rows of a tile; ids and labels are taken from the query side by position."""
    cat = lambda i: np.concatenate([f[i] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64)
    rows = pa.array(cat(0), pa.int64())
    q = a.select(["id", "label"]).take(rows)
    return q.append_column("code", pa.array(cat(1), pa.int64())).append_column(name, pa.array(cat(2), pa.int64()))


def _positive_steps(queries: DataFrame, refs: DataFrame, subsets: list, block_rows: int) -> DataFrame:
    """(id, label, code, n_pos): positives of each query per similarity step."""
    r = refs.select("id", F.explode("labels").alias("label"), "features")
    sizes = r.groupBy("label").agg(F.count(F.lit(1)).alias("__n")).withColumn("__b", F.ceil(F.col("__n") / block_rows).cast("int"))
    buckets = max(1, -(-4 * r.count() // block_rows))
    spread = F.sequence(F.lit(0), F.col("__b") - 1)
    place = F.pmod(F.xxhash64("id"), F.col("__b")).cast("int")
    bucket = F.pmod(F.xxhash64("label"), F.lit(buckets)).cast("int")
    l = queries.select("id", "label", "features").join(sizes, "label").select("id", "label", "features", bucket.alias("__g"), place.alias("__l"), F.explode(spread).alias("__r"))
    rr = r.join(sizes, "label").select("id", "label", "features", bucket.alias("__g"), place.alias("__r"), F.explode(spread).alias("__l"))
    rr = own_columns(rr)  # a self-join otherwise
    id_type, label_type = queries.schema["id"].dataType.simpleString(), queries.schema["label"].dataType.simpleString()

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and b.num_rows:
            x, y = matrix(a), matrix(b)
            qi, ri = np.asarray(a.column("id").to_pylist(), dtype=object), np.asarray(b.column("id").to_pylist(), dtype=object)
            ql, rl = np.asarray(a.column("label").to_pylist(), dtype=object), np.asarray(b.column("label").to_pylist(), dtype=object)
            for lab in set(ql.tolist()) & set(rl.tolist()):
                rows, cols = np.flatnonzero(ql == lab), np.flatnonzero(rl == lab)
                other = (qi[rows][:, None] != ri[cols][None, :]).astype(bool)
                for v, dims in enumerate(subsets):
                    found.append(_counted(rows, _codes(x[rows], y[cols], dims, v), other))
        return _table(a, found, "n_pos")

    keys = ["__g", "__l", "__r"]
    parts = min(buckets * 8, MAX_PARTITIONS)
    l, rr = l.repartition(parts, *keys), rr.repartition(parts, *keys)
    found = l.groupBy(*keys).cogroup(rr.groupBy(*keys)).applyInArrow(count, f"id {id_type}, label {label_type}, code long, n_pos long")
    return found.groupBy("id", "label", "code").agg(F.sum("n_pos").alias("n_pos"))


def _negative_steps(thresholds: DataFrame, refs: DataFrame, subsets: list, block_rows: int, n_queries: int) -> DataFrame:
    """(id, label, code, n_neg): negatives at or above a positive step and below the next one up."""
    id_type, label_type = thresholds.schema["id"].dataType.simpleString(), thresholds.schema["label"].dataType.simpleString()
    r = refs.where("negative").select(F.col("id").alias("ref_id"), "labels", "features")

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and b.num_rows:
            x, y = matrix(a), matrix(b)
            member: dict = {}
            for j, labs in enumerate(b.column("labels").to_pylist()):
                for lab in labs or ():
                    member.setdefault(lab, []).append(j)
            ql = a.column("label").to_pylist()
            steps = [np.asarray(s, dtype=np.int64) for s in a.column("steps").to_pylist()]
            for v, dims in enumerate(subsets):
                c = _codes(x, y, dims, v)
                for i in range(len(ql)):
                    lo, hi = np.searchsorted(steps[i], [v * SPAN, (v + 1) * SPAN])
                    if lo == hi:
                        continue
                    neg = np.delete(c[i], member[ql[i]]) if ql[i] in member else c[i]
                    at = np.searchsorted(steps[i][lo:hi], neg, side="right") - 1
                    times = np.bincount(at[at >= 0], minlength=1)
                    k = np.flatnonzero(times)
                    found.append((np.full(len(k), i), steps[i][lo:hi][k], times[k]))
        return _table(a, found, "n_neg")

    q = thresholds.select("id", "label", "features", "steps")
    summed_up = lambda t: summed(t, ["id", "label", "code"], {"n_neg": "sum"})
    per = tile_reduce(q, r, count, f"id {id_type}, label {label_type}, code long, n_neg long", summed_up, block_rows, right_id="ref_id", left_rows=n_queries)
    return per.groupBy("id", "label", "code").agg(F.sum("n_neg").alias("n_neg"))


def _members(labels: pa.ChunkedArray, wanted: list) -> dict:
    """Positions of the rows that carry each wanted label."""
    labels = labels.combine_chunks()
    labels = pa.concat_arrays(labels.chunks) if isinstance(labels, pa.ChunkedArray) else labels
    kept = pa.array(wanted, labels.type.value_type)
    code = pc.index_in(labels.flatten(), kept)
    code, parent = code.fill_null(-1).to_numpy(zero_copy_only=False), pc.list_parent_indices(labels).to_numpy()
    parent, code = parent[code >= 0], code[code >= 0]
    order = np.argsort(code, kind="stable")
    cuts = np.searchsorted(code[order], np.arange(len(wanted) + 1))
    return {lab: np.unique(parent[order[cuts[i]:cuts[i + 1]]]) for i, lab in enumerate(wanted)}


def _packed(t: pa.Table | pa.RecordBatch) -> tuple[bytes, bytes, int, int]:
    """(Arrow stream without the features, their numbers, numbers a row, bytes a number): single floats where they say the same."""
    flat = matrix(pa.table(t) if isinstance(t, pa.Table) else pa.Table.from_batches([t]))
    single = flat.astype(np.float32)
    flat = single if np.array_equal(single, flat) else flat
    sink = pa.BufferOutputStream()
    rest = t.drop_columns(["features"])
    with pa.ipc.new_stream(sink, rest.schema) as w:
        w.write(rest)
    return sink.getvalue().to_pybytes(), flat.tobytes(), flat.shape[1], flat.dtype.itemsize


_PACKS = "kind int, rows binary, numbers binary, width int, bytes int"


def _pack_rows(kind: int, found: list[tuple], keys: list[str] | None = None) -> pa.RecordBatch:
    cols = [pa.array([kind] * len(found), pa.int32()), *(pa.array([f[i] for f in found], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.int32(), pa.int32())))]
    names = ["kind", "rows", "numbers", "width", "bytes"]
    return pa.RecordBatch.from_arrays(cols if keys is None else [pa.array(keys, pa.string()), *cols], names=names if keys is None else ["__k", *names])


def _packs(rows: DataFrame, kind: int) -> DataFrame:
    """Rows (id, labels, negative, features) as packs of at most ``PACK`` rows; those that have a ``__k`` are packed by it."""
    keyed = "__k" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not keyed:
                for i in range(0, b.num_rows, PACK):
                    yield _pack_rows(kind, [_packed(b.slice(i, PACK))])
                continue
            t = pa.Table.from_batches([b])
            code = t.column("__k").combine_chunks().dictionary_encode()
            code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
            order = np.argsort(code.indices.to_numpy(), kind="stable")
            cuts = np.searchsorted(code.indices.to_numpy()[order], np.arange(len(code.dictionary) + 1))
            for k, i, j in zip(code.dictionary.to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                for x in range(i, j, PACK):
                    yield _pack_rows(kind, [_packed(t.drop_columns(["__k"]).take(pa.array(order[x:min(x + PACK, j)])).combine_chunks())], [k])

    cols = ["id", "labels", "negative", "features"]
    return rows.select(*(["__k"] if keyed else []), *cols).mapInArrow(run, f"__k string, {_PACKS}" if keyed else _PACKS)


def _unpacked(packs: list[dict]) -> tuple[pa.Table, np.ndarray]:
    """(id, labels, negative) of packs and their features as one matrix."""
    kind = np.float32 if all(p["bytes"] == 4 for p in packs) else np.float64
    rows = [pa.ipc.open_stream(p["rows"]).read_all() for p in packs]
    out, at = np.empty((sum(r.num_rows for r in rows), packs[0]["width"]), kind), 0
    for r, p in zip(rows, packs, strict=True):
        out[at:at + r.num_rows] = np.frombuffer(p["numbers"], f"<f{p['bytes']}").reshape(r.num_rows, -1)
        at += r.num_rows
        p["numbers"] = b""
    return pa.concat_tables(rows), out


def _unit(x: np.ndarray, dims: Sequence[int] | None) -> np.ndarray:
    return unit_rows((x if dims is None else x[:, dims]).astype(np.float64))


def _keys_of(x: np.ndarray, refs: np.ndarray, dims: Sequence[int] | None, at: np.ndarray | slice, negative: int, raw: bool) -> np.ndarray:
    """[query, reference]: twice the similarity step, and one if negative, of unit vectors ``x`` and the references at ``at``, which are unit vectors unless ``raw``."""
    n = len(refs[at]) if isinstance(at, slice) else len(at)
    out = np.empty((len(x), n), np.int32)
    start = at.start or 0 if isinstance(at, slice) else 0
    x = x * STEPS
    for i in range(0, n, HELD_REFS):
        j = min(i + HELD_REFS, n)
        y = refs[start + i:start + j] if isinstance(at, slice) else refs[at[i:j]]
        y = (_unit(y, dims) if raw else y).T
        for k in range(0, len(x), HELD_QUERIES):
            s = x[k:k + HELD_QUERIES] @ y
            np.rint(s, out=s)
            s += s
            s += negative
            out[k:k + HELD_QUERIES, i:j] = s
    return out


def _precision(keys: np.ndarray, left_out: np.ndarray) -> tuple[float, int]:
    """(average precision, positives) of a query with these ``keys``; ``left_out`` are places in them.

    One sort of all: a step's negatives have odd keys, so they rank above its positives.
    """
    keys[left_out] = _LAST
    keys.sort()
    n = len(keys)
    at = np.flatnonzero((keys & 1) == 0)
    at = at[np.searchsorted(at, len(left_out)):]  # what is left out ranks last
    if not len(at):
        return 0.0, 0
    return float((np.arange(len(at), 0, -1) / (n - at)).mean()), len(at)


def _score_group(ids: pa.Table, x: np.ndarray, refs: pa.Table, y: np.ndarray, subsets: list) -> pa.Table:
    """(id, label, v, average_precision, n_pos, n_neg) of queries (id, labels with one label) among references.

    References come with the negatives first, so a query's similarities to them are one slice; equal
    rows of one id share them.
    """
    nf = int(pc.sum(refs.column("negative")).as_py() or 0)
    a = pa.table({"id": ids.column("id"), "label": pc.list_element(ids.column("labels"), 0), "at": pa.array(np.arange(len(x)))})
    a = a.sort_by([("id", "ascending")] if nf == len(y) else [("label", "ascending"), ("id", "ascending")])
    order = a.column("at").to_numpy()
    labels = a.column("label").to_pylist()
    member = _members(refs.column("labels"), list(dict.fromkeys(labels)))
    coded = pa.chunked_array([*a.column("id").chunks, *refs.column("id").chunks]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    qid, rid = coded[:len(x)], coded[len(x):]
    by_id = np.argsort(rid, kind="stable")
    same_lo, same_hi = np.searchsorted(rid[by_id], qid, "left"), np.searchsorted(rid[by_id], qid, "right")
    same_hi = np.where(qid == qid, same_hi, same_lo)  # a null id is no other's
    x = x[order]
    new = np.ones(len(x), bool)
    new[1:] = (qid[1:] != qid[:-1]) | (x[1:] != x[:-1]).any(axis=1)
    place = np.cumsum(new)
    is_member = {lab: np.zeros(len(y), bool) for lab in member}
    for lab, m in member.items():
        is_member[lab][m] = True
    most = max([nf, *(nf + int((m >= nf).sum()) for m in member.values()), 1])
    block = max(1, HELD_PAIRS // most)
    found: list[tuple] = []
    raw = 8 * y.size > HELD_UNITS
    for v, dims in enumerate(subsets):
        units = y if raw else _unit(y, dims)
        for lo in range(0, len(labels), block):
            hi = min(lo + block, len(labels))
            unit = _unit(x[lo:hi], dims)
            flagged = _keys_of(unit[np.unique(place[lo:hi], return_index=True)[1]], units, dims, slice(0, nf), 1, raw)
            start = lo
            while start < hi:
                end = start + 1
                while end < hi and labels[end] == labels[start]:
                    end += 1
                m = member[labels[start]]
                own, rest = m[m < nf], m[m >= nf]
                # a member among the negatives counts for none of them; the rest is met here only
                far = _keys_of(unit[start - lo:end - lo], units, dims, rest, 0, raw) if len(rest) else None
                even = is_member[labels[start]][:nf].astype(np.int32)
                for i in range(start, end):
                    keys = flagged[place[i] - place[lo]] - even
                    keys = keys if far is None else np.concatenate([keys, far[i - start]])
                    # rows of the query's id are no positives of it
                    self_ = by_id[same_lo[i]:same_hi[i]]
                    self_ = self_[is_member[labels[i]][self_]]
                    here = np.concatenate([self_[self_ < nf], nf + np.searchsorted(rest, self_[self_ >= nf])])
                    score, n_pos = _precision(keys, here)
                    if n_pos:
                        found.append((i, v, score, n_pos, nf - len(own)))
                start = end
    col = lambda i, t: pa.array([f[i] for f in found], t)
    return a.select(["id", "label"]).take(col(0, pa.int64())).append_column("v", col(1, pa.int32())).append_column(
        "average_precision", col(2, pa.float64())).append_column("n_pos", col(3, pa.int64())).append_column("n_neg", col(4, pa.int64()))


def _held_precision(queries: DataFrame, refs: DataFrame, subsets: list, block_rows: int, all_negative: bool) -> DataFrame:
    """(id, label, v, average_precision, n_pos, n_neg): queries in groups by label, each with all references it needs.

    A label of more than a group's rows has groups of its own, so that its positives travel to
    those only; smaller ones share groups. Negatives go to every group. Where all references are
    negatives, queries are dealt by id, so the labels of an id meet the references together. References
    travel in packs and a task holds their numbers once.
    """
    cols = ["id", "labels", F.coalesce("negative", F.lit(False)).alias("negative"), "features"]
    asked = queries.where(F.col("label").isNotNull())
    if all_negative:
        total = asked.select(F.count(F.lit(1))).first()[0]
        every = [str(i) for i in range(-(-total // max(block_rows, -(-total // GROUPS))))] if total else []
        l = asked.withColumn("__k", F.pmod(F.xxhash64("id"), F.lit(max(1, len(every)))).cast("string"))
        other = None
    else:
        sizes = checkpointed(asked.groupBy("label").agg(F.count(F.lit(1)).alias("__n")))
        total = sizes.agg(F.sum("__n")).first()[0] or 0
        block = max(block_rows, -(-total // GROUPS))
        bins = max(1, -(-(sizes.where(F.col("__n") <= block).agg(F.sum("__n")).first()[0] or 0) // block))
        shared = F.array(F.concat(F.lit("s"), F.pmod(F.xxhash64("label"), F.lit(bins)).cast("string")))
        alone = F.transform(F.sequence(F.lit(0), F.ceil(F.col("__n") / block).cast("int") - 1), lambda i: F.concat(F.lit("l"), F.col("label").cast("string"), F.lit("|"), i.cast("string")))
        places = sizes.select("label", F.when(F.col("__n") <= block, shared).otherwise(alone).alias("__to"))
        every = [r[0] for r in places.select(F.explode("__to")).distinct().collect()]
        part = F.pmod(F.xxhash64("id"), F.size("__to")).cast("int")
        l = asked.join(places, "label").withColumn("__k", F.get("__to", part))
        other = refs.where(F.coalesce(~F.col("negative"), F.lit(True))).select("id", F.explode("labels").alias("label"), F.lit(False).alias("negative"), "features").join(places, "label")
        other = _packs(other.select("id", F.array("label").alias("labels"), "negative", "features", F.explode("__to").alias("__k")), 2)
    l = _packs(l.select("id", F.array("label").alias("labels"), F.lit(False).alias("negative"), "features", "__k"), 0)
    parts = min(max(1, 4 * len(every)), MAX_PARTITIONS)
    names = ["__k", "kind", "rows", "numbers", "width", "bytes"]
    both = l.select(*names)
    if every:
        both = both.unionByName(_packs(refs.where("negative").select(*cols), 1).withColumn("__k", F.explode(F.array(*[F.lit(k) for k in every]))).select(*names))
    both = both if other is None else both.unionByName(other.select(*names))
    id_type, label_type = queries.schema["id"].dataType.simpleString(), queries.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packs in _by_key(batches):
            mine = [[p for p in packs if (p["kind"] == 0) == own] for own in (True, False)]
            packs.clear()
            if mine[0] and mine[1]:
                ids, x = _unpacked(mine[0])
                refs_, y = _unpacked(mine[1])
                yield from _score_group(ids, x, refs_, y, subsets).to_batches()

    schema = f"id {id_type}, label {label_type}, v int, average_precision double, n_pos long, n_neg long"
    return both.repartition(parts, "__k").sortWithinPartitions("__k", "kind").mapInArrow(run, schema)


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of batches sorted by ``__k``, those of one key together."""
    now, held = None, []
    for b in batches:
        for row in b.to_pylist():
            if held and row["__k"] != now:
                yield held
                held = []
            now = row["__k"]
            held.append(row)
    if held:
        yield held


def average_precision(
    queries: DataFrame, refs: DataFrame, subsets: dict[str, Sequence[int] | None] | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(variant, id, label, average_precision, n_pos, n_neg) for each query and feature subset.

    ``queries`` holds (id, label, features); ``refs`` holds (id, labels array, negative, features).
    A positive shares the label, a negative is flagged and does not. ``subsets`` names lists of
    feature positions; all are scored in one job. Queries without a positive have no score.
    """
    named = subsets or {"all": None}
    names, dims = list(named), [None if d is None else list(d) for d in named.values()]
    n_refs, n_negative, width = refs.agg(F.count(F.lit(1)), F.count_if("negative"), F.coalesce(F.max(F.size("features")), F.lit(0))).first()
    if 8 * n_refs * width <= HELD_BYTES:
        found = _held_precision(queries, refs, dims, block_rows, n_refs == n_negative)
        variant = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("v") + 1)
        return found.select(variant.alias("variant"), "id", "label", "average_precision", "n_pos", "n_neg")
    # both reductions read the positives; writing them once keeps the first from running again
    pos = checkpointed(_positive_steps(queries, refs, dims, block_rows))
    steps = pos.groupBy("id", "label").agg(F.sort_array(F.collect_list("code")).alias("steps"))
    neg = _negative_steps(queries.select("id", "label", "features").join(steps, ["id", "label"]), refs, dims, block_rows, queries.count())
    j = pos.join(neg, ["id", "label", "code"], "left").fillna(0, ["n_neg"])
    j = j.withColumn("__v", F.floor(F.col("code") / SPAN).cast("int"))
    down = Window.partitionBy("id", "label", "__v").orderBy(F.col("code").desc())
    before = F.coalesce(F.sum("n_pos").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = F.sum("n_neg").over(down.rowsBetween(Window.unboundedPreceding, 0))
    s = j.withColumns({"__p": before, "__a": above})
    # sum of (p + i) / (p + i + a) for i = 1 .. n_pos, in closed form
    part = F.col("n_pos") - F.col("__a") * (harmonic(F.col("__p") + F.col("n_pos") + F.col("__a")) - harmonic(F.col("__p") + F.col("__a")))
    ap = s.groupBy("id", "label", "__v").agg((F.sum(part) / F.sum("n_pos")).alias("average_precision"), F.sum("n_pos").alias("n_pos"))
    flagged = refs.where("negative")
    all_neg = flagged.select(F.count(F.lit(1))).scalar()
    own = flagged.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("__own"))
    out = ap.join(own, "label", "left").withColumn("n_neg", all_neg - F.coalesce("__own", F.lit(0)))
    variant = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("__v") + 1)
    return out.select(variant.alias("variant"), "id", "label", "average_precision", "n_pos", "n_neg")


# --- the three questions ----------------------------------------------------------------------
def activity(profiles: DataFrame, control: Column, subsets=None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Do replicates of a perturbation find each other before controls?"""
    q = profiles.where(~control).select("id", F.col("perturbation").alias("label"), "features")
    r = profiles.select("id", F.array("perturbation").alias("labels"), control.alias("negative"), "features")
    return average_precision(q, r, subsets, block_rows)


def distinctiveness(profiles: DataFrame, control: Column | None = None, active: DataFrame | None = None, subsets=None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Do replicates find each other before all other perturbations (of the active ones, if given)?"""
    rows = profiles if control is None else profiles.where(~control)
    if active is not None:
        rows = rows.join(active.select("perturbation").distinct(), "perturbation", "left_semi")
    q = rows.select("id", F.col("perturbation").alias("label"), "features")
    r = rows.select("id", F.array("perturbation").alias("labels"), F.lit(True).alias("negative"), "features")
    return average_precision(q, r, subsets, block_rows)


def consistency(genes: DataFrame, sets: DataFrame, minimum: int = 2, subsets=None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Do genes of a set find each other before all other genes? A gene may be in many sets."""
    present = sets.join(genes.select(F.col("id").alias("gene")), "gene", "left_semi").select("set_id", "gene").distinct()
    kept = present.join(present.groupBy("set_id").count().where(F.col("count") >= minimum).select("set_id"), "set_id", "left_semi")
    q = kept.join(genes.select(F.col("id").alias("gene"), "features"), "gene").select(F.col("gene").alias("id"), F.col("set_id").cast("string").alias("label"), "features")
    of = kept.groupBy(F.col("gene").alias("id")).agg(F.collect_set(F.col("set_id").cast("string")).alias("labels"))
    r = genes.select("id", "features").join(of, "id", "left").select("id", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.lit(True).alias("negative"), "features")
    return average_precision(q, r, subsets, block_rows)


# --- summaries --------------------------------------------------------------------------------
def null_average_precision(n_pos: int, n_total: int, size: int, rng: np.random.Generator) -> np.ndarray:
    """``size`` random average precisions of n_pos positives among n_total ranks."""
    out = np.empty(size)
    step = max(1, 2_000_000 // max(n_total, 1))
    sparse = n_pos * n_pos * 2 < n_total
    order = np.arange(1, n_pos + 1)
    i = 0
    while i < size:
        m = min(step if not sparse else max(1, 2_000_000 // n_pos), size - i)
        if sparse:
            r = np.sort(rng.integers(1, n_total + 1, (m, n_pos)), axis=1)
            bad = (np.diff(r, axis=1) == 0).any(axis=1) if n_pos > 1 else np.zeros(m, bool)
            while bad.any():
                r[bad] = np.sort(rng.integers(1, n_total + 1, (int(bad.sum()), n_pos)), axis=1)
                bad = (np.diff(r, axis=1) == 0).any(axis=1)
        else:
            keys = rng.random((m, n_total))
            r = np.sort(np.argpartition(keys, n_pos - 1, axis=1)[:, :n_pos], axis=1) + 1
        out[i:i + m] = (order / r).mean(axis=1)
        i += m
    return out


def null_table(configs: DataFrame, size: int, seed: int = 42, chunk: int = 500) -> DataFrame:
    """(n_pos, n_total, draw, ap): one null per distinct configuration, drawn in parallel chunks."""
    starts = F.explode(F.sequence(F.lit(0), F.lit(size - 1), F.lit(chunk)))
    tasks = configs.select("n_pos", "n_total").distinct().withColumn("start", starts)
    tasks = tasks.repartition("n_pos", "n_total", "start")

    def draw(batches):
        for b in batches:
            for p, t, s in zip(b["n_pos"], b["n_total"], b["start"]):
                m = min(chunk, size - s)
                ap = null_average_precision(int(p), int(t), m, np.random.default_rng([seed, int(p), int(t), int(s)]))
                yield pd.DataFrame({"n_pos": p, "n_total": t, "draw": np.arange(s, s + m), "ap": ap})

    return tasks.mapInPandas(draw, "n_pos long, n_total long, draw long, ap double")


def mean_average_precision(ap: DataFrame) -> DataFrame:
    return ap.groupBy("variant", "label").agg(F.avg("average_precision").alias("mean_average_precision"), F.count(F.lit(1)).alias("n_queries"))


def significance(ap: DataFrame, null_size: int = 10_000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Mean average precision per label with its permutation p, BH per variant and the significance flag.

    Labels whose queries have the same mix of (positives, ranks) share one null, which is a
    sorted array of ``null_size`` values; each label counts in it row-locally.
    """
    ap = checkpointed(ap)
    m = mean_average_precision(ap)
    c = ap.withColumn("n_total", F.col("n_pos") + F.col("n_neg")).groupBy("variant", "label", "n_pos", "n_total").agg(F.count(F.lit(1)).alias("k"))
    mix = c.groupBy("variant", "label").agg(F.sort_array(F.collect_list(F.struct("n_pos", "n_total", "k"))).alias("mix"))
    mixes = mix.select("mix").distinct()
    total = F.aggregate("mix", F.lit(0).cast("long"), lambda s, e: s + e["k"])
    parts = mixes.select("mix", total.alias("t"), F.explode("mix").alias("e")).select("mix", "e.n_pos", "e.n_total", (F.col("e.k") / F.col("t")).alias("share"))
    null = null_table(parts, null_size, seed)
    drawn = parts.join(null, ["n_pos", "n_total"]).groupBy("mix", "draw").agg(F.sum(F.col("share") * F.col("ap")).alias("ap"))
    arrays = drawn.groupBy("mix").agg(F.sort_array(F.collect_list("ap")).alias("null"))
    j = m.join(mix, ["variant", "label"]).join(arrays, "mix")
    at_least = F.size(F.filter("null", lambda v: v >= F.col("mean_average_precision") - 1e-12))
    p = j.select(F.col("variant"), F.col("label").alias("perturbation"), "mean_average_precision", "n_queries", ((at_least + 1) / (null_size + 1)).alias("p_value"))
    out = bh_adjust(checkpointed(p), ["variant"], "p_value", "corrected_p_value")
    return out.withColumn("below_corrected_p", F.col("corrected_p_value") < alpha)


def significant_ratio(scores: DataFrame, keys: Sequence[str] = ("variant",)) -> DataFrame:
    return scores.groupBy(*keys).agg(
        F.avg(F.col("below_corrected_p").cast("double")).alias("ratio"), F.avg("mean_average_precision").alias("mean_map"), F.count(F.lit(1)).alias("n")
    )


def weighted_contribution(mean_ap: Column, p: Column, cap: float = 6.0) -> Column:
    """mAP weighted by its significance: clip(-log10 p, 0, cap) / cap."""
    return mean_ap * F.least(F.greatest(-F.log10(F.greatest(p, F.lit(1e-300))), F.lit(0.0)), F.lit(cap)) / cap


def auc_score(scores: DataFrame, keys: Sequence[str] = ("variant",)) -> DataFrame:
    """Mean of the contributions weighted by the corrected p value."""
    return scores.groupBy(*keys).agg(F.avg(weighted_contribution(F.col("mean_average_precision"), F.col("corrected_p_value"))).alias("auc"))


def sweep_auc(scores: DataFrame, keys: Sequence[str] = ("variant",), points: int = 101) -> DataFrame:
    """Area under the fraction of labels with mAP >= t, for t from 0 to 1, by trapezoids."""
    t = F.col("i") / float(points - 1)
    grid = scores.select(*keys, "mean_average_precision", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    frac = grid.groupBy(*keys, "i").agg(F.avg((F.col("mean_average_precision") >= t).cast("double")).alias("f"))
    weight = F.when((F.col("i") == 0) | (F.col("i") == points - 1), 0.5).otherwise(1.0) / float(points - 1)
    return frac.groupBy(*keys).agg(F.sum(F.col("f") * weight).alias("sweep_auc"))
