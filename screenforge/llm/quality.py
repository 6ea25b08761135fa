"""Ordinal quality grades: a cumulative-link model with shared hashed-text weights and ordered thresholds.

P(grade <= k) = sigmoid(threshold_k - w . x): one weight vector for all grades, K - 1 increasing
thresholds. x holds hashed words of the whole text (present or not) and a few hashed shape marks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenforge.llm.text import sampled, slices, words

BITS = 18
#: Rated documents that the model is fitted on at most (expected number; chosen by hash).
FIT_DOCS = 20_000


def grade(quality: Column, toxic: Column) -> Column:
    """Graded rating of a label row: 0 toxic, 1 poor, 2 good; null when the ratings that decide are null."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


def shape_marks(text: str, found: list[bytes], distinct: int) -> list[bytes]:
    """Shape of a text as marks: repetition, symbols at word ends, word length, line repetition."""
    n = max(1, len(found))
    lines = text.split("\n")
    letters = sum(map(str.isalpha, text)) / max(1, len(text))
    return [
        b"#distinct%d" % int(10 * distinct / n), b"#letters%d" % int(20 * letters), b"#length%d" % min(15, int(len(text) / n)),
        b"#lines%d" % int(5 * len(set(lines)) / len(lines)), b"#size%d" % min(12, n.bit_length()),
    ]


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct hashed features; for null or blank text only the mark ``#empty``."""
    found = words(text)
    if not found:
        marks = [b"#empty"]
    else:
        bag = set(found)
        marks = [*shape_marks(text, found, len(bag)), *bag]
    return np.unique(np.fromiter(map(zlib.crc32, marks), np.uint32, len(marks)) >> np.uint32(32 - bits))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, bits: int = BITS, rounds: int = 150, step: float = 0.05, ridge: float = 3e-4, least: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the regularised mean log-likelihood.

    Features in fewer than ``least`` rows keep weight 0. Thresholds are the first one plus
    exponentials, so they stay ordered; every grade counts alike on the whole (class weights).
    """
    # all of the sample's features at once: 8 bytes each stay, 4 for the feature and 4 for its row
    flat = np.concatenate(rows).astype(np.int32)
    live = (np.bincount(flat, minlength=1 << bits) >= least)[flat]
    flat_live = flat[live]
    del flat
    owner_live = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])[live]
    del live
    size = np.bincount(grades, minlength=n_grades)
    weight = (len(grades) / (np.count_nonzero(size) * np.maximum(size, 1)))[grades] ** 0.5 / len(grades)
    w, t = np.zeros(1 << bits), np.concatenate([[-0.5 * (n_grades - 2)], np.zeros(n_grades - 2)])
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    for r in range(1, rounds + 1):
        cuts = np.concatenate([[-np.inf], t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))]), [np.inf]])
        s = np.bincount(owner_live, w[flat_live], len(rows))
        with np.errstate(over="ignore"):
            hi, lo = 1 / (1 + np.exp(s - cuts[grades + 1])), 1 / (1 + np.exp(s - cuts[grades]))
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = weight * hi * (1 - hi) / p, weight * lo * (1 - lo) / p
        g_s = d_hi - d_lo  # of -log p by s
        g_cut = np.bincount(grades + 1, -d_hi, n_grades + 1) + np.bincount(grades, d_lo, n_grades + 1)
        tail = np.cumsum(g_cut[1:-1][::-1])[::-1]
        g_t = np.concatenate([[tail[0]], tail[1:] * np.exp(t[1:])])
        g_w = np.bincount(flat_live, g_s[owner_live], 1 << bits) + ridge * w
        for x, g, m, v in ((w, g_w, state[0], state[1]), (t, g_t, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= step * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return w, t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))])


def fit(docs: DataFrame, rated: DataFrame, n_grades: int = 3, fit_docs: int = FIT_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Model from documents (doc_id, text) and ratings (doc_id, grade; null grades are unrated).

    At most about ``fit_docs`` rated ids, chosen by hash, are joined with the documents; only their
    hashed features reach the driver. Without any rating all weights are 0.
    """
    rated = rated.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = sampled(rated, F.col("doc_id"), rated.count(), fit_docs)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = [features(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.array(x, pa.binary())], names=["doc_id", "grade", "x"])

    # the chosen ids are at most about fit_docs rows of 12 bytes, so this broadcast is bounded
    got = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", F.col("grade").cast("int"))), "doc_id").mapInArrow(hashed, "doc_id long, grade int, x binary").orderBy("doc_id", "x").collect()
    if not got:
        return np.zeros(1 << BITS), np.linspace(-1, 1, n_grades - 1)
    return fit_ordinal([np.frombuffer(r["x"], np.uint32) for r in got], np.array([r["grade"] for r in got]), n_grades)


def score(docs: DataFrame, weights: np.ndarray, cuts: np.ndarray) -> DataFrame:
    """(doc_id, expected_grade, tail_probability): tail is P(grade above 0), the probability of not being in the lowest grade.

    Null and empty texts are scored by their ``#empty`` mark; repeated rows are scored each; a null
    doc_id is kept. Only doc_id and text are read.
    """
    model = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, cuts = model.value
        for b in slices(batches):
            s = np.array([w[features(t)].sum(dtype=np.float64) for t in b.column("text").to_pylist()])
            with np.errstate(over="ignore"):
                above = 1 / (1 + np.exp(cuts[None, :] - s[:, None]))  # P(grade > k)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(above[:, -1])], names=["doc_id", "expected_grade", "tail_probability", "top_probability"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, top_probability double")


def graded(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """Every document with expected grade, tail probability and ``kept``: P(grade above 0) at least ``least``."""
    rated = labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade"))
    return score(docs, *fit(docs, rated)).withColumn("kept", F.col("tail_probability") >= least)
