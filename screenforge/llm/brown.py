"""Language-model scores from Brown word classes: P(word | history) = P(class | previous class) P(word | class).

Exchange clustering moves words between classes while the bigram likelihood of the classes grows.
It starts with the commonest words singly and all others with their kind (length and last byte),
which fits one matrix; then every word of the corpus moves singly (``exchange``). Counts come from
all training text. A word that it lacks has the class that its kind had at the start.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenforge.llm.exchange import Clusters
from screenforge.llm.text import hash64, remainder, slices, words
from screenforge.session import checkpointed

END = b""  # no word is empty
#: Words that move singly at the start, classes, and words whose counts every worker holds.
MOVED, CLASSES, HELD = 1500, 64, 100_000
KINDS = 64
#: Distinct words that a worker counts before it hands them on.
FLUSH = 400_000
_COUNTS = pa.schema([("word", pa.binary()), ("n", pa.int64())])


def kind(word: bytes) -> int:
    """Class-independent kind of a word without an own symbol: its length and the kind of its last byte."""
    last = word[-1]
    return min(len(word), 16) - 1 + 16 * (0 if 97 <= last <= 122 else 1 if 48 <= last <= 57 else 2 if last < 128 else 3)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over whole texts, one end token (the empty word) per row; null texts are empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], schema=_COUNTS)

        for b in slices(batches):
            for text in b.column("text").to_pylist():
                seen.update(words(text))
            seen[END] += b.num_rows
            if len(seen) > FLUSH:
                yield out()
                seen.clear()
        if seen:
            yield out()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def symbol_pairs(docs: DataFrame, symbols: dict[bytes, int]) -> np.ndarray:
    """Counts [previous symbol, symbol] over all of ``docs``; a text starts and ends with the end token.

    The matrix has a fixed size (MOVED + KINDS + 1 squared); tasks emit only what they saw.
    """
    size = MOVED + KINDS + 1
    known = docs.sparkSession.sparkContext.broadcast(symbols)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, total, ids = known.value.get, np.zeros(size * size, np.int64), [0]

        def add() -> None:
            a = np.array(ids, np.int64)
            np.add(total, np.bincount(a[:-1] * size + a[1:], minlength=size * size), out=total)
            ids[:] = [0]

        for b in slices(batches):
            for text in b.column("text").to_pylist():
                for w in words(text):
                    i = get(w)
                    ids.append(1 + MOVED + kind(w) if i is None else i)
                ids.append(0)
            if len(ids) > 1_000_000:
                add()
        add()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    rows = docs.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    out = np.zeros(size * size)
    got = rows.toArrow()
    out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(size, size)


def exchange(pairs: np.ndarray, n_classes: int = CLASSES, rounds: int = 6) -> np.ndarray:
    """Class of every symbol by exchange clustering; class 0 holds the end token alone.

    Start: symbols by falling count, dealt to the classes in turn. A symbol moves to the class that
    raises sum N(c, d) log N(c, d) - sum N(c) log N(c) twice-counted most; rounds end when none moves.
    """
    n = len(pairs)
    count = pairs.sum(1)
    order = [int(i) for i in np.argsort(-count, kind="stable") if i and (count[i] or pairs[:, i].sum())]
    cls = np.ones(n, np.int64)
    cls[0] = 0
    for r, i in enumerate(order):
        cls[i] = 1 + r % (n_classes - 1)

    def xlogx(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    hot = np.zeros((n, n_classes))
    hot[np.arange(n), cls] = 1
    joint = hot.T @ pairs @ hot
    rows, cols = joint.sum(1), joint.sum(0)
    for _ in range(rounds):
        moved = 0
        for i in order:
            out, into, own = np.bincount(cls, pairs[i], n_classes), np.bincount(cls, pairs[:, i], n_classes), pairs[i, i]
            a = cls[i]
            out[a] -= own
            into[a] -= own
            n_out, n_in = out.sum() + own, into.sum() + own
            joint[a] -= out
            joint[:, a] -= into
            joint[a, a] -= own
            rows[a] -= n_out
            cols[a] -= n_in
            # gain of each class: change of its row, its column and its diagonal cell
            grown = joint + out[None, :]
            gain = (xlogx(grown) - xlogx(joint)).sum(1) + (xlogx(joint + into[:, None]) - xlogx(joint)).sum(0)
            d = np.arange(n_classes)
            diag = joint[d, d]
            gain += xlogx(diag + out[d] + into[d] + own) - xlogx(diag + out[d]) - xlogx(diag + into[d]) + xlogx(diag)
            gain -= xlogx(rows + n_out) - xlogx(rows) + xlogx(cols + n_in) - xlogx(cols)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            cls[i] = b
            joint[b] += out
            joint[:, b] += into
            joint[b, b] += own
            rows[b] += n_out
            cols[b] += n_in
        if not moved:
            break
    return cls


def hashed(table: DataFrame) -> DataFrame:
    """``table`` (word, n) with the words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("h", pa.array(hash64(b.column("word").to_pylist()).view(np.int64)))

    return table.mapInArrow(run, "word binary, n long, h long")


def commonest(table: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most ``most`` words, all that reach some count, by falling count: a histogram of counts finds that count."""
    level = F.floor(F.log2("n") * 64)
    least, held = None, 0
    for r in table.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect():
        held += r["words"]
        if held > most:
            break
        least = r["level"]
    rows = [] if least is None else table.where(level >= least).collect()
    return sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


def fit(docs: DataFrame) -> dict:
    """Model from training rows (text): word table with classes (a DataFrame on shared storage), classes, transitions.

    The driver receives at most HELD of the commonest words with their counts and classes, the symbol pair matrix,
    and the bigrams by class: all of fixed size. ``trace`` has the likelihood of the classes turn by turn.
    """
    table = checkpointed(word_counts(docs))
    total, distinct = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = commonest(table, HELD)
    symbols = {w: i for i, (w, _) in enumerate(((w, n) for w, n in top if w != END), 1) if i <= MOVED}
    symbols[END] = 0
    first = exchange(symbol_pairs(docs, symbols))
    kinds = np.array([first[1 + MOVED + k] for k in range(KINDS)])
    named = [END, *(w for w, _ in top if w != END)]
    hashes = hash64(named)
    order = np.unique(hashes, return_index=True)[1]
    start = np.array([first[symbols[w]] if w in symbols else kinds[kind(w)] for w in named])
    found = Clusters(docs, hashes[order], start[order], kinds, CLASSES)
    trace = found.settle()
    classes = dict(zip(hashes[order].tolist(), found.top.tolist(), strict=True))
    table = checkpointed(hashed(table).join(found.rare(), "h", "left").select("word", "n", "class"))
    joint, types = found.joint, found.types
    if not total:
        types = np.zeros(CLASSES)
    found.discard()
    step = np.log10((joint + 0.5) / (joint.sum(1, keepdims=True) + 0.5 * CLASSES))
    return {
        "table": table, "N": int(total), "V": int(distinct), "top": dict(top), "symbols": {w: classes[h] for w, h in zip(named, hashes.tolist(), strict=True)},
        "kinds": kinds, "step": step, "class_log": np.log10(joint.sum(1) + types + 1), "trace": trace,
    }


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs`` (doc_id, text, held_out).

    Words that every worker holds are scored where the text is; the rest, counted per document, are
    joined with the word table for their counts and classes, and the transitions beside them follow. Emission: (count + 1) / (class tokens + class words + 1), so a class
    leaves room for one unseen word. Repeated rows are scored each; null texts have the end token only.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({k: model[k] for k in ("N", "V", "top", "symbols", "kinds", "step", "class_log")})
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if token not in _HELD:  # word: class, log10(count + 1)
            _HELD.clear()
            kinds = m["kinds"]
            _HELD[token] = {w: (m["symbols"][w] if w in m["symbols"] else int(kinds[kind(w)]), math.log10(n + 1)) for w, n in m["top"].items()}
            _HELD[token].setdefault(END, (0, 0.0))
        held, kinds, step, class_log = _HELD[token], m["kinds"], m["step"], m["class_log"]
        end_class, end_log = held[END]
        end_known = int(END in m["top"])
        base = math.log10(m["N"] + m["V"] + 1)
        for b in slices(batches):
            n_tokens, n_held, sure, trans, tails, times, guess, lefts, rights = [], [], [], [], [], [], [], [], []
            for text in b.column("text").to_pylist():
                found, rest, ids, logs = words(text), Counter(), [end_class], []
                place: dict[bytes, int] = {}
                for w in found:
                    hit = held.get(w)
                    if hit is None:
                        ids.append(CLASSES + place.setdefault(w, len(place)))
                        rest[w] += 1
                    else:
                        ids.append(hit[0])
                        logs.append(hit[1])
                ids.append(end_class)
                c = np.array(ids)
                known = c < CLASSES
                both = known[:-1] & known[1:]
                n_tokens.append(len(found) + 1)
                n_held.append(len(logs) + end_known)
                sure.append(math.fsum(logs) + end_log)
                trans.append(float(step[c[:-1][both], c[1:][both]].sum() - class_log[c[1:][known[1:]]].sum()))
                tails.append(list(rest))
                times.append(list(rest.values()))
                guess.append([int(kinds[kind(w)]) for w in rest])
                lefts.append(c[:-1][~both].astype(np.int32).tobytes())
                rights.append(c[1:][~both].astype(np.int32).tobytes())
            n = np.array(n_tokens)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(n_held, pa.int64()), pa.array(np.array(sure) - n * base), pa.array(np.array(trans) + np.array(sure)), pa.array(tails, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32())), pa.array(guess, pa.list_(pa.int32())), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary())],
                names=["doc_id", "held_out", "n_tokens", "n_held", "base_held", "held_score", "words", "times", "guess", "lefts", "rights"],
            )

    parts = docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_held long, base_held double, held_score double, words array<binary>, times array<int>, guess array<int>, lefts binary, rights binary"
    )
    # the row number is fixed once the rows are on shared storage
    parts = checkpointed(parts.withColumn("row", F.monotonically_increasing_id()))
    rest = parts.select("row", F.posexplode(F.arrays_zip("words", "times")).alias("at", "x")).select("row", "at", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    # no word of the rest is frequent, so neither side has a hot word
    known = rest.join(model["table"], "word").groupBy("row").agg(
        F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"), F.collect_list(F.struct("at", "class")).alias("found")
    )

    def beside_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, class_log = shared.value["step"], shared.value["class_log"]
        for b in slices(batches, 4096):
            out = []
            for guess, times, left, right, found in zip(*(b.column(c).to_pylist() for c in ("guess", "times", "lefts", "rights", "found")), strict=True):
                cls = np.concatenate([np.arange(CLASSES), np.array(guess, np.int64)])
                for x in found or []:
                    if x["class"] is not None:
                        cls[CLASSES + x["at"]] = x["class"]
                x, y = cls[np.frombuffer(left, np.int32)], cls[np.frombuffer(right, np.int32)]
                out.append(float(step[x, y].sum() - (class_log[cls[CLASSES:]] * np.array(times, np.int64)).sum()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.float64())], names=[*names, "beside"])

    names = ["doc_id", "held_out", "n_tokens", "n_held", "base_held", "held_score", "known", "logs"]
    done = parts.drop("words").join(known, "row", "left").select(*names, "guess", "times", "lefts", "rights", "found").mapInArrow(
        beside_rare, "doc_id long, held_out boolean, n_tokens long, n_held long, base_held double, held_score double, known long, logs double, beside double"
    )
    logs = F.coalesce("logs", F.lit(0.0))
    return done.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_held") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(model["N"]).cast("long").alias("train_tokens"),
        (F.col("base_held") + logs).alias("base_score"), (F.col("held_score") + F.col("beside") + logs).alias("score"),
    )


_HELD: dict[str, dict[bytes, tuple[int, float]]] = {}


def scored(docs: DataFrame, modulus: int = 7, fold: int = 2) -> DataFrame:
    """Scores of all documents by a model of those outside the held-out fold of their id's checksum."""
    fold_of = remainder(F.col("doc_id"), modulus)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (fold_of == fold).alias("held_out"))
    return score(rows, fit(rows.where(~F.col("held_out"))))
