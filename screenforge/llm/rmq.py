"""Ranked lexical search over document intervals bounded by range-maximum queries.

Every posting list has a sparse table of range maxima over its impacts. For a query, the sum of the
lists' maxima over an interval of documents bounds the score of each document in it. Intervals are
taken best bound first: the document with the interval's largest single impact is scored, and the
two intervals beside it are bounded anew; the search ends when no bound reaches the k-th best score.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenforge.llm.packs import pack, unpack
from screenforge.llm.text import slices
from screenforge.session import checkpointed

#: Hashed slots that tell which terms a query may have: at most this many bits are broadcast.
SLOTS = 1 << 20
#: Postings of a shard of documents; documents of an interval that are scored together.
POSTINGS, LEAF = 1_000_000, 256
#: (item, term) entries of queries that are broadcast at once.
ENTRIES = 200_000
#: Words whose slot a worker remembers.
CACHE_WORDS = 400_000

_KEPT = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if c in _KEPT else 0x20 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of letters, digits and characters beyond ASCII, A-Z lower-cased, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def slot(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term) % SLOTS


class _Codes(dict):
    """word: number of the term among those met so far, -1 for words that no query has."""

    def __init__(self, wanted: np.ndarray):
        super().__init__()
        self.wanted, self.names = wanted, []

    def __missing__(self, word: bytes) -> int:
        k = slot(word)
        code = -1
        if self.wanted[k >> 3] >> (k & 7) & 1:
            code = len(self.names)
            self.names.append(word)
        self[word] = code
        return code


def _entries(queries: DataFrame) -> DataFrame:
    """(item_id, item, term, n, slot): terms of each distinct row; ``item`` tells rows of one item_id apart."""
    rows = queries.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [Counter(terms(t)) for t in b.column("text").to_pylist()]
            own = pa.array([i for i, c in enumerate(found) for _ in c], pa.int64())
            names = [t for c in found for t in c]
            item = [xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass")) >> 1 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column("item_id").take(own), pa.array(item, pa.int64()).take(own), pa.array(names, pa.binary()),
                pa.array([n for c in found for n in c.values()], pa.int64()), pa.array([slot(t) for t in names], pa.int64()),
            ], names=["item_id", "item", "term", "n", "slot"])

    return rows.mapInArrow(run, "item_id long, item long, term binary, n long, slot long")


def shards(docs: DataFrame, wanted: np.ndarray, postings: int = POSTINGS) -> DataFrame:
    """(n_docs, n_terms, named, terms, df, blob) of about ``postings`` postings of terms whose slot is wanted.

    blob packs ids and sizes of the documents, those with an id first and in order of it, the ends
    of the terms' posting lists, and document number and frequency of the postings. n_docs counts
    the documents with a term, n_terms their terms, wanted or not.
    """
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(shared.value)
        held: list[tuple[np.ndarray, ...]] = []  # (ids, has id, sizes), then (term, document, frequency)
        n_held = n_docs = 0

        def flush() -> pa.RecordBatch:
            ids, has, sizes = (np.concatenate(c) for c in zip(*(h[:3] for h in held), strict=True))
            term, doc, tf = (np.concatenate(c) for c in zip(*(h[3:] for h in held), strict=True))
            order = np.lexsort((ids, ~has))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            doc = place[doc]
            by = np.lexsort((doc, term))
            met, df = np.unique(term, return_counts=True)
            blob = pack([ids[order], sizes[order], np.cumsum(df), doc[by].astype(np.int32), tf[by].astype(np.int32)])
            out = pa.RecordBatch.from_arrays([
                pa.array([len(ids)]), pa.array([int(sizes.sum())]), pa.array([int(has.sum())]), pa.array([[codes.names[t] for t in met]], pa.list_(pa.binary())),
                pa.array([df.tolist()], pa.list_(pa.int64())), pa.array([blob], pa.binary()),
            ], names=["n_docs", "n_terms", "named", "terms", "df", "blob"])
            held.clear()
            return out

        for b in slices(batches):
            lists = [terms(t) for t in b.column("text").to_pylist()]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            some = np.flatnonzero(sizes)
            code = np.fromiter((c for x in lists for c in map(codes.__getitem__, x)), np.int64, int(sizes.sum()))
            doc = np.repeat(np.arange(len(some)), sizes[some])[code >= 0]
            pair, tf = np.unique(code[code >= 0] * len(lists) + doc, return_counts=True)
            ids = b.column("doc_id").take(pa.array(some))
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ~np.asarray(ids.is_null()), sizes[some], pair // len(lists), pair % len(lists) + n_docs, tf))
            n_held, n_docs = n_held + len(pair), n_docs + len(some)
            if n_held >= postings:
                yield flush()
                n_held = n_docs = 0
                codes = _Codes(shared.value)
            elif len(codes) > CACHE_WORDS:
                for w in [w for w, c in codes.items() if c < 0]:
                    del codes[w]
        if n_docs:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "n_docs long, n_terms long, named long, terms array<binary>, df array<long>, blob binary")


class Shard:
    """Posting lists of a shard with impacts and their sparse tables of range maxima."""

    def __init__(self, names: list[bytes], named: int, blob: bytes, weights: dict[bytes, int], n_docs: int, n_terms: int):
        self.ids, sizes, ends, doc, tf = unpack(blob)
        lists = [i for i, t in enumerate(names) if t in weights]
        self.number = {names[t]: k for k, t in enumerate(lists)}
        starts = np.concatenate([[0], ends[:-1]])
        at = _ranges(starts[lists], ends[lists])
        own = np.repeat(np.arange(len(lists)), (ends - starts)[lists])
        keep = doc[at] < named
        at, own = at[keep], own[keep]
        self.doc, tf = doc[at].astype(np.int64), tf[at].astype(np.int64)
        self.span, self.named = len(self.ids) + 1, named
        self.keys = own * self.span + self.doc
        m = 100 - 25 + (25 * sizes * n_docs) // max(1, n_terms)
        weight = np.array([weights[names[t]] for t in lists], np.int64)
        self.impact = weight[own] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[self.doc]))
        longest = int(np.bincount(own).max()) if len(own) else 1
        self.table = [np.arange(len(at), dtype=np.int32)]  # level j: place of the largest of 2^j impacts from here on
        while 1 << len(self.table) <= longest:
            last, step = self.table[-1], 1 << (len(self.table) - 1)
            a, b = last[:-step], last[step:]
            up = last.copy()
            up[:-step] = np.where(self.impact[a] >= self.impact[b], a, b)
            self.table.append(up)
        self.table = np.array(self.table)
        self.level = np.concatenate([[0], np.floor(np.log2(np.arange(1, longest + 1))).astype(np.int64)])

    def bound(self, base: np.ndarray, n: np.ndarray, lo: int, hi: int) -> tuple[int, int]:
        """(most that a document of [lo, hi) can score, posting with the largest impact)."""
        p, q = np.searchsorted(self.keys, base + lo), np.searchsorted(self.keys, base + hi)
        some = q > p
        if not some.any():
            return 0, -1
        p, q = p[some], q[some]
        level = self.level[q - p]
        a, b = self.table[level, p], self.table[level, q - (1 << level)]
        best = np.where(self.impact[a] >= self.impact[b], a, b)
        most = n[some] * self.impact[best]
        return int(most.sum()), int(best[most.argmax()])

    def scores(self, base: np.ndarray, n: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Scores of the documents [lo, hi)."""
        p, q = np.searchsorted(self.keys, base + lo), np.searchsorted(self.keys, base + hi)
        at = _ranges(p, q)
        out = np.zeros(hi - lo, np.int64)
        np.add.at(out, self.doc[at] - lo, np.repeat(n, q - p) * self.impact[at])
        return out


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of [starts, ends), range after range."""
    size = ends - starts
    return np.arange(size.sum()) + np.repeat(starts - (np.cumsum(size) - size), size)


def best_first(shard: Shard, query: list[tuple[bytes, int]], top: list[tuple[int, int]], k: int, leaf: int = LEAF) -> int:
    """Put the shard's best documents into ``top``, the sorted (-score, id) of at most ``k``; documents scored."""
    found = [(shard.number[t], n) for t, n in query if t in shard.number]
    if not found:
        return 0
    base = np.array([t for t, _ in found], np.int64) * shard.span
    n = np.array([c for _, c in found], np.int64)
    scored = 0

    def take(lo: int, values: np.ndarray) -> None:
        for i in np.flatnonzero(values > 0) if len(top) < k else np.flatnonzero(values >= max(1, -top[-1][0])):
            entry = (-int(values[i]), int(shard.ids[lo + i]))
            if len(top) < k or entry < top[-1]:
                insort(top, entry)
                del top[k:]

    def put(lo: int, hi: int) -> None:
        if lo < hi:
            most, at = shard.bound(base, n, lo, hi)
            if most > 0:
                heapq.heappush(heap, (-most, lo, hi, at))

    heap: list[tuple[int, int, int, int]] = []
    put(0, shard.named)
    while heap:
        most, lo, hi, at = heapq.heappop(heap)
        if len(top) == k and (most, int(shard.ids[lo])) > top[-1]:
            break
        if hi - lo <= leaf:
            take(lo, shard.scores(base, n, lo, hi))
            scored += hi - lo
        else:
            d = int(shard.doc[at])
            take(d, shard.scores(base, n, d, d + 1))
            scored += 1
            put(lo, d)
            put(d + 1, hi)
    return scored


def search(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item of ``queries`` (item_id, text).

    Scores are those of ``op11``'s contract, in 64-bit integers; equal scores go by ascending doc_id
    and only scores above 0 are returned. A null or empty item has no rows; equal item rows count
    once, and different texts of one item_id are items of their own. Null and empty texts hold no
    term and are not counted. Every document row is a document: repeated rows are ranked each; rows
    without doc_id count in the statistics and are not returned. Only doc_id, item_id and text are
    read. Empty tables give no rows.

    Documents stay where they are read: a task turns its texts into shards of posting lists, kept in
    the shared folder. Queries come to all shards in blocks of about ``ENTRIES`` terms.
    """
    sc = docs.sparkSession.sparkContext
    entries = checkpointed(_entries(queries))
    bits = np.zeros(SLOTS, np.uint8)
    bits[[r["slot"] for r in entries.select("slot").distinct().collect()]] = 1
    held = checkpointed(shards(docs, np.packbits(bits, bitorder="little")))
    n_docs, n_terms = held.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = held.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    asked = checkpointed(entries.join(df, "term").groupBy("item_id", "item").agg(F.array_sort(F.collect_list(F.struct("term", "n", weight.alias("w")))).alias("terms")))
    n_blocks = max(1, -(-entries.count() // ENTRIES))
    out = None
    for block in range(n_blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(n_blocks)) == block).collect()
        items = [(r["item_id"], r["item"], [(bytes(t["term"]), t["n"]) for t in r["terms"]]) for r in mine]
        shared = sc.broadcast((items, {bytes(t["term"]): t["w"] for r in mine for t in r["terms"]}))
        one = held.select("terms", "named", "blob").mapInArrow(_searcher(shared, n_docs, n_terms, k), "item_id long, item long, doc_id long, score long")
        out = one if out is None else out.unionByName(one)
    order = Window.partitionBy("item_id", "item").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _searcher(shared, n_docs: int, n_terms: int, k: int):  # noqa: ANN001, ANN202 - Spark's broadcast type has no public name
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        top: list[list[tuple[int, int]]] = [[] for _ in items]
        for b in batches:
            for names, named, blob in zip(b.column("terms"), b.column("named").to_pylist(), b.column("blob"), strict=True):
                shard = Shard(names.as_py(), named, blob.as_py(), weights, n_docs, n_terms)
                for best, (_, _, query) in zip(top, items, strict=True):
                    best_first(shard, query, best, k)
        rows = [(i, j, d, -s) for best, (i, j, _) in zip(top, items, strict=True) for s, d in best]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names=["item_id", "item", "doc_id", "score"])

    return run
