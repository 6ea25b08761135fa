"""Exchange clustering of every word of a corpus, from the whole table of its bigrams.

Words are 64-bit hashes, dealt into parts. A word moves to the class that raises the bigram
likelihood of the classes most, sum N(c, d) log N(c, d) - sum N(c) log N(c) twice, all other words
staying; for that its part needs its counts by neighbouring class. Classes of the commonest words
every task holds. Those of all other words are sent, added up, from their parts to their neighbours.
So a hot word's part has at most one count for each of the commonest words and a few for the rest.

In a turn only a share of the words, drawn by hash, may move, since moves are judged without each
other; a turn that does not raise the likelihood is undone and fewer words are tried. It ends when
the turns over all words together raise it by hardly more than nothing (``ENOUGH``), or when a turn
of the smallest share (``FEWEST``) does not raise it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenforge.llm.packs import squeeze, unsqueeze
from screenforge.llm.text import checkpointed_as_dealt, hash64, slices, splitmix, words
from screenforge.session import discard, shuffles_removed, stored

#: Tokens whose bigrams a worker counts at once, letters of a part.
TOKENS, LETTERS = 1_000_000, 6_000_000
#: Counts that are judged at once.
HELD_COUNTS = 1 << 14
#: Least share by which the turns of all words together raise the log likelihood, and most shares of words that are tried.
ENOUGH, FEWEST = 2e-3, 8
_WORD, _HELD, _RARE = 0, 1, 2
_CLASSES, _SENT, _TOP = 0, 1, 2
#: Direction of a count: the neighbour follows the word, precedes it, or is the word itself.
_AFTER, _BEFORE, _SELF = 0, 1, 2


def kinds_of(found: list[bytes]) -> np.ndarray:
    """Kinds of words: length and kind of the last byte."""
    size = np.fromiter(map(len, found), np.int64, len(found))
    last = np.fromiter((w[-1] if w else 0 for w in found), np.int64, len(found))
    which = np.where((last >= 97) & (last <= 122), 0, np.where((last >= 48) & (last <= 57), 1, np.where(last < 128, 2, 3)))
    return np.clip(size, 1, 16) - 1 + 16 * which


def _index(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of ``x`` in ``sorted_``, -1 where it is not."""
    if not len(sorted_):
        return np.full(len(x), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return np.where(sorted_[at] == x, at, -1)


def _added(rows: np.ndarray) -> np.ndarray:
    """Rows (keys ..., n) in order, those of equal keys added up."""
    if not rows.shape[1]:
        return rows
    rows = rows[:, np.lexsort(rows[-2::-1])] if len(rows) > 2 else rows[:, np.argsort(rows[0], kind="stable")]
    new = np.concatenate([[True], (rows[:-1, 1:] != rows[:-1, :-1]).any(axis=0)])
    out = rows[:, new]
    out[-1] = np.add.reduceat(rows[-1], np.flatnonzero(new))
    return out


def _dealt(kind: int, part: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(part, kind, packed rows); the rows of a part keep their order."""
    if not len(part):
        return []
    order = np.argsort(part, kind="stable")
    rows, part = rows[:, order], part[order]
    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    return [(int(part[i]), kind, squeeze(rows[:, i:j])) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


_ROWS = "key int, kind int, blob binary"


def _batch(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["key", "kind", "blob"])


def _part(x: np.ndarray, parts: int) -> np.ndarray:
    return (x.view(np.uint64) % np.uint64(parts)).astype(np.int64)


def bigrams(docs: DataFrame, held: np.ndarray, parts: int) -> DataFrame:
    """(key, kind, blob): words outside ``held`` (word, kind), counts beside held words (word, direction, held, n) and beside others (owner, target, direction, n).

    ``held`` are sorted hashes, the end token's among them; a text starts and ends with that token.
    """
    known = docs.sparkSession.sparkContext.broadcast(held)
    end = hash64([b""])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = known.value

        def out(seen: list[np.ndarray], rare: list[np.ndarray]) -> pa.RecordBatch:
            y = np.concatenate(seen)
            x = np.concatenate([end, y[:-1]])  # every text ends with the token that the next one starts with
            pairs = _added(np.stack([x.view(np.int64), y.view(np.int64), np.ones(len(x), np.int64)]))
            x, y, n = np.ascontiguousarray(pairs[0]), np.ascontiguousarray(pairs[1]), pairs[2]
            ix, iy, other = _index(top, x.view(np.uint64)), _index(top, y.view(np.uint64)), x != y
            found: list = []
            for w, v, at, way in ((x, y, iy, _AFTER), (y, x, ix, _BEFORE)):
                k = np.flatnonzero((at >= 0) & other)
                found += _dealt(_HELD, _part(w[k], parts), np.stack([w[k], np.full(len(k), way), at[k], n[k]]))
                k = np.flatnonzero((at < 0) & other)
                found += _dealt(_RARE, _part(v[k], parts), np.stack([v[k], w[k], np.full(len(k), way), n[k]]))
            k = np.flatnonzero(~other)
            found += _dealt(_HELD, _part(x[k], parts), np.stack([x[k], np.full(len(k), _SELF), np.zeros(len(k), np.int64), n[k]]))
            word = np.concatenate(rare, axis=1)
            word = np.ascontiguousarray(word[:, np.unique(word[0], return_index=True)[1]])
            return _batch(found + _dealt(_WORD, _part(word[0], parts), word))

        seen, rare, size = [], [], 0
        for b in slices(batches):
            flat = [w for t in b.column("text").to_pylist() for w in (*words(t), b"")]
            seen.append(hash64(flat))
            word, first = np.unique(seen[-1], return_index=True)
            new = np.flatnonzero(_index(top, word) < 0)
            rare.append(np.stack([word[new].view(np.int64), kinds_of([flat[i] for i in first[new].tolist()])]))
            size += len(flat)
            if size > TOKENS:
                yield out(seen, rare)
                seen, rare, size = [], [], 0
        if size:
            yield out(seen, rare)

    return docs.select("text").mapInArrow(count, _ROWS)


def _own(held: np.ndarray, key: int, parts: int) -> np.ndarray:
    return np.flatnonzero(held % np.uint64(parts) == key)


def graph(counted: DataFrame, held: np.ndarray, parts: int) -> DataFrame:
    """(key, words, near, sent): a part's words (hash, kind, place among the held or -1), its counts beside held words and those it sends."""
    known = counted.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: int, blobs: dict[int, list[bytes]]) -> pa.RecordBatch:
            got = {k: np.concatenate([unsqueeze(x) for x in blobs.get(k, [])], axis=1) if k in blobs else np.zeros((2 if k == _WORD else 4, 0), np.int64) for k in (_WORD, _HELD, _RARE)}
            blobs.clear()
            mine = _own(known.value, key, parts)
            word = np.concatenate([got[_WORD][0].view(np.uint64), known.value[mine]])
            kind, place = np.concatenate([got[_WORD][1], np.zeros(len(mine), np.int64)]), np.concatenate([np.full(got[_WORD].shape[1], -1), mine])
            word, first = np.unique(word, return_index=True)
            near, sent = got[_HELD], got[_RARE]
            near[0] = _index(word, np.ascontiguousarray(near[0]).view(np.uint64))
            sent = sent[[1, 0, 2, 3]]  # by target
            sent[1] = _index(word, np.ascontiguousarray(sent[1]).view(np.uint64))
            near, sent = _added(near), _added(sent)
            tables = [squeeze(np.stack([word.view(np.int64), kind[first], place[first]])), squeeze(near), squeeze(sent)]
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), *(pa.array([t], pa.binary()) for t in tables)], names=["key", "words", "near", "sent"])

        now, blobs = None, {}
        for b in batches:
            for row in b.to_pylist():
                if row["key"] != now and blobs:
                    yield out(now, blobs)
                    blobs = {}
                now = row["key"]
                blobs.setdefault(row["kind"], []).append(row["blob"])
        if blobs:
            yield out(now, blobs)

    # every part has a row, also one whose held words have rare neighbours only
    every = counted.sparkSession.range(parts).select(F.col("id").cast("int").alias("key"), F.lit(_WORD).alias("kind"), F.lit(squeeze(np.zeros((2, 0), np.int64))).alias("blob"))
    rows = counted.unionByName(every).repartition(parts, "key").sortWithinPartitions("key")
    with shuffles_removed(counted.sparkSession):
        return checkpointed_as_dealt(rows.mapInArrow(run, "key int, words binary, near binary, sent binary").repartition(parts, "key"))


def _sending(key: int, cls: np.ndarray, table: np.ndarray, sent: np.ndarray, parts: int) -> list[tuple[int, int, bytes]]:
    """The part's classes, those of its held words, and its words' classes for their neighbours elsewhere."""
    top = table[2] >= 0
    out = [(key, _CLASSES, squeeze(cls[None].astype(np.int64))), (key, _TOP, squeeze(np.stack([table[2][top], cls[top].astype(np.int64)])))]
    if sent.shape[1]:
        number = np.cumsum(np.diff(sent[0], prepend=sent[0][:1]) != 0)  # by target
        rows = _added(np.stack([192 * number + 64 * sent[2] + cls[sent[1]], sent[3]]))
        target = sent[0][np.searchsorted(number, rows[0] // 192)]
        out += _dealt(_SENT, _part(np.ascontiguousarray(target), parts), np.stack([target, rows[0] % 192, rows[1]]))
    return out


def _counts(table: np.ndarray, near: np.ndarray, sent: list[bytes], top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((word, 64 * direction + class, n) in order, how often each word follows itself)."""
    own = np.zeros(table.shape[1], np.int64)
    self_ = near[1] == _SELF
    own[near[0][self_]] = near[3][self_]
    rows = [np.stack([192 * near[0] + 64 * near[1] + top[near[2]], near[3]])[:, ~self_]]
    for blob in sent:
        target, code, n = unsqueeze(blob)
        rows.append(np.stack([192 * _index(table[0].view(np.uint64), target.view(np.uint64)) + code, n]))
    key, n = _added(np.concatenate(rows, axis=1))
    return np.stack([key // 192, key % 192, n]), own


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(joint: np.ndarray) -> float:
    return float(_xlogx(joint).sum() - _xlogx(joint.sum(0)).sum() - _xlogx(joint.sum(1)).sum())


def _grown(group: np.ndarray, n: np.ndarray, base: np.ndarray) -> np.ndarray:
    """[entry, class]: growth of x log x where ``n`` joins row ``group`` of ``base``; equal entries are worked out once."""
    top = int(n.max(initial=0)) + 1
    key, inverse = np.unique(group * top + n, return_inverse=True)
    at = base[key // top]
    return (_xlogx(at + (key % top)[:, None]) - _xlogx(at))[inverse]


def best_classes(cls: np.ndarray, rows: np.ndarray, own: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """Class of each word that raises the likelihood most, the others staying; ``rows`` (word, 64 * direction + class, n) in order."""
    size, n_classes = len(cls), len(joint)
    out = np.zeros((2, size, n_classes))
    way, c = rows[1] // 64, rows[1] % 64
    out[way, rows[0], c] = rows[2]
    w, every = rows[0], np.arange(size)
    total = out.sum(axis=2) + own
    gain = np.zeros((size, n_classes))
    stay = np.zeros(size)
    for k, (base, ends) in enumerate(((joint.T, joint.sum(1)), (joint, joint.sum(0)))):
        # base[c][b]: cell of class b, as row or as column, beside neighbours of class c
        m = np.flatnonzero(way == k)
        if len(m):
            heads = np.flatnonzero(np.diff(w[m], prepend=-1))
            gain[w[m[heads]]] += np.add.reduceat(_grown(c[m], rows[2][m], base), heads, axis=0)
            # the cell of the class that the word leaves has lost the word's counts from the other side
            a = cls[w[m]]
            cell, n = base[c[m], a], rows[2][m]
            stay += np.bincount(w[m], np.where(c[m] == a, 0.0, _xlogx(cell) - _xlogx(np.maximum(cell - n, 0))), size)
        other = np.flatnonzero(way == 1 - k)
        lost, back = rows[2][other].astype(float), out[k, w[other], cls[w[other]]]
        some = back > 0
        other, lost, back = other[some], lost[some], back[some]
        cell = base[cls[w[other]], c[other]]
        np.add.at(gain, (w[other], c[other]), _xlogx(np.maximum(cell - lost, 0) + back) - _xlogx(np.maximum(cell - lost, 0)) - _xlogx(cell + back) + _xlogx(cell))
        gain -= _grown(np.zeros(size, np.int64), total[k].astype(np.int64), ends[None])
        stay -= _xlogx(ends[cls]) - _xlogx(np.maximum(ends[cls] - total[k], 0))
    both = np.flatnonzero(((out[0] > 0) & (out[1] > 0)) | (own > 0)[:, None])
    i, b = both // n_classes, both % n_classes
    cell, u, v = joint[b, b], out[0, i, b], out[1, i, b]
    gain[i, b] += _xlogx(cell + u + v + own[i]) - _xlogx(cell + u) - _xlogx(cell + v) + _xlogx(cell)
    cell = joint[cls, cls]
    stay += _xlogx(cell) - _xlogx(np.maximum(cell - out[0, every, cls] - out[1, every, cls] - own, 0))
    gain[:, 0] = -np.inf
    gain[every, cls] = stay
    best = gain.argmax(axis=1)
    return np.where(gain[every, best] > stay + 1e-9, best, cls)


class Clusters:
    """Classes of all words of ``docs``; ``held`` are hashes that every task holds, in order, with the classes ``top`` at first."""

    def __init__(self, docs: DataFrame, held: np.ndarray, top: np.ndarray, kinds: np.ndarray, n_classes: int):
        self.spark, self.held, self.top, self.n_classes = docs.sparkSession, held, top.astype(np.int64), n_classes
        letters = docs.agg(F.sum(F.length("text"))).first()[0] or 0
        self.parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), letters // LETTERS)
        self.graph = graph(bigrams(docs, held, self.parts), held, self.parts)
        parts = self.parts
        first = self.spark.sparkContext.broadcast(self.top)

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for key, table, sent in zip(*(b.column(x).to_pylist() for x in ("key", "words", "sent")), strict=True):
                    table = unsqueeze(table)
                    cls = np.where(table[2] >= 0, first.value[table[2]], kinds[table[1]])
                    yield _batch(_sending(key, cls, table, unsqueeze(sent), parts))

        self.state = stored(self.graph.select("key", "words", "sent").mapInArrow(start, _ROWS))
        self.joint, self.types = self._joint(self.state, self.top)

    def _beside(self, state: DataFrame) -> DataFrame:
        blobs = state.where(F.col("kind") != _TOP).groupBy("key").agg(F.collect_list(F.struct("kind", "blob")).alias("got"))
        return self.graph.join(blobs, "key", "left")

    def _joint(self, state: DataFrame, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bigrams by class, words by class)."""
        n, classes = self.n_classes, self.spark.sparkContext.broadcast(top)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for table, near, got in zip(*(b.column(x).to_pylist() for x in ("words", "near", "got")), strict=True):
                    cls, rows, own, _ = _read(table, near, got, classes.value)
                    after = rows[:, rows[1] < 64]
                    pair = np.concatenate([n * cls[after[0]] + after[1], n * cls + cls, n * n + cls])
                    total = np.bincount(pair, np.concatenate([after[2], own, np.ones(len(cls))]), n * n + n)
                    at = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["pair", "n"])

        found = stored(self._beside(state).select("words", "near", "got").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
        got = found.toArrow()
        discard(found)
        out = np.zeros(n * n + n)
        out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
        return out[:n * n].reshape(n, n), out[n * n:]

    def _moved(self, turn: int, share: int) -> DataFrame:
        """The state after the words of a turn moved."""
        joint, parts, classes = self.joint, self.parts, self.spark.sparkContext.broadcast(self.top)
        end = hash64([b""])[0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for key, table, near, sent, got in zip(*(b.column(x).to_pylist() for x in ("key", "words", "near", "sent", "got")), strict=True):
                    cls, rows, own, table = _read(table, near, got, classes.value)
                    word = np.ascontiguousarray(table[0]).view(np.uint64)
                    may = (splitmix(word) % np.uint64(share) == np.uint64(turn % share)) & (word != end)
                    rows = rows[:, may[rows[0]]]
                    cuts = np.flatnonzero(np.diff(rows[0] if rows.shape[1] else [], prepend=-1))
                    new, i = cls.copy(), 0
                    while i < len(cuts):
                        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + HELD_COUNTS, "right")) - 1) if rows.shape[1] - cuts[i] > HELD_COUNTS else len(cuts)
                        mine = rows[:, cuts[i]:cuts[j] if j < len(cuts) else None].copy()
                        at, mine[0] = np.unique(mine[0], return_inverse=True)
                        new[at] = best_classes(cls[at], mine, own[at], joint)
                        i = j
                    yield _batch(_sending(key, new, table, unsqueeze(sent), parts))

        return stored(self._beside(self.state).mapInArrow(run, _ROWS))

    def settle(self) -> list[float]:
        """Move words until the likelihood hardly rises; the likelihoods on the way."""
        trace, share, turn, done, before = [likelihood(self.joint)], 2, 0, 0, None
        while share <= FEWEST:
            before = trace[-1] if not done else before
            state = self._moved(turn, share)
            top = self.top.copy()
            for r in state.where(F.col("kind") == _TOP).select("blob").toLocalIterator():
                place, cls = unsqueeze(r["blob"])
                top[place] = cls
            joint, types = self._joint(state, top)
            value, turn, done = likelihood(joint), turn + 1, done + 1
            if value >= trace[-1]:
                discard(self.state)
                self.state, self.top, self.joint, self.types = state, top, joint, types
                trace.append(value)
                if done == share:
                    if value - before <= ENOUGH * abs(before):
                        break
                    done = 0
            else:
                discard(state)
                share, done = 2 * share, 0
        return trace

    def discard(self) -> None:
        """Delete the stored state; ``rare`` reads it."""
        discard(self.state)

    def rare(self) -> DataFrame:
        """(h, class) of the words outside the held ones."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for table, blob in zip(*(b.column(x).to_pylist() for x in ("words", "blob")), strict=True):
                    table, cls = unsqueeze(table), unsqueeze(blob)[0]
                    k = table[2] < 0
                    yield pa.RecordBatch.from_arrays([pa.array(table[0][k]), pa.array(cls[k].astype(np.int32))], names=["h", "class"])

        state = self.state.where(F.col("kind") == _CLASSES).select("key", "blob")
        return self.graph.select("key", "words").join(state, "key").select("words", "blob").mapInArrow(run, "h long, class int")


def _read(table: bytes, near: bytes, got: list[dict] | None, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(classes, counts, self counts, words) of a part."""
    table = unsqueeze(table)
    cls = np.concatenate([unsqueeze(x["blob"])[0] for x in got if x["kind"] == _CLASSES])
    rows, own = _counts(table, unsqueeze(near), [x["blob"] for x in got if x["kind"] == _SENT], top)
    return cls, rows, own, table
