"""Language identification by unigram pieces, summed over every segmentation of a word.

A word's probability in a language is the sum, over all ways to cut it into pieces of a fixed
public vocabulary, of the product of the language's piece probabilities. The forward recursion
computes the sum; expectation maximisation fits the probabilities.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenforge.llm.text import slices

#: Positions after which the forward sums of a word are rescaled, so that words of any length fit a double.
RESCALE = 16
#: Cells (positions times piece lengths) of the words scored together.
CELLS = 1 << 18
#: Labelled documents per language that the model is fitted on (expected number; chosen by hash).
FIT_DOCS = 600
#: Words whose scores a worker remembers.
CACHE_WORDS = 150_000


def public_pieces(tokenizer_json: str) -> dict[str, int]:
    """All letter pieces of a byte-level vocabulary, lower-cased, numbered from 1; 0 stands for an unknown character."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer_json)
    vocab = sorted(json.loads(tokenizer_json)["model"]["vocab"].values())
    texts = {t.decode([i], skip_special_tokens=False).strip().lower() for i in vocab}
    return {p: i for i, p in enumerate(sorted(p for p in texts if p.isalpha()), 1)}


def letter_words(text: str | None) -> list[str]:
    """Lower-case words without their non-letters; words without any letter are left out."""
    if not text:
        return []
    out = []
    for w in text.lower().split():
        if not w.isalpha():
            w = "".join(filter(str.isalpha, w))
            if not w:
                continue
        out.append(w)
    return out


def piece_sizes(pieces: dict[str, int]) -> list[int]:
    """Lengths that pieces have, and 1, the length of an unknown character."""
    return sorted({1, *map(len, pieces)})


def lattice(found: list[str], pieces: dict[str, int], sizes: list[int]) -> np.ndarray:
    """[word, start, size index]: piece number, 0 for an unknown single character, -1 where no piece fits."""
    width = max(map(len, found))
    out = np.full((len(found), width, sum(k <= width for k in sizes)), -1, np.int32)
    get = pieces.get
    for i, w in enumerate(found):
        n = len(w)
        for s in range(n):
            out[i, s, 0] = get(w[s], 0)
        for at, k in enumerate(sizes[1:], 1):
            if k > n:
                break
            out[i, : n - k + 1, at] = [get(w[s : s + k], -1) for s in range(n - k + 1)]
    return out


def forward(grid: np.ndarray, lengths: np.ndarray, prob: np.ndarray, sizes: list[int], each: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """alpha[word, position, language] and the log of each word's sum; prob's last row (index -1) is zero.

    Sums are rescaled every ``RESCALE`` positions, which leaves the log sums exact. ``each`` [word,
    language] is a factor per character instead; then alpha keeps one scale at all positions.
    """
    n, width, count = grid.shape
    alpha = np.zeros((n, width + 1, prob.shape[1]))
    alpha[:, 0] = 1.0
    logs, out = np.zeros((n, prob.shape[1])), np.zeros((n, prob.shape[1]))
    last = sizes[count - 1]
    for end in range(1, width + 1):
        for at in range(count):
            k = sizes[at]
            if k > end:
                break
            term = alpha[:, end - k] * prob[grid[:, end - k, at]]
            alpha[:, end] += term if each is None else term * each**k
        done = lengths == end
        if done.any():
            out[done] = np.log(alpha[done, end]) + logs[done]
        if each is None and end % RESCALE == 0 and end < width:
            live = lengths > end
            by = np.where(live[:, None], alpha[:, end], 1.0)
            alpha[:, max(0, end - last + 1) : end + 1] /= by[:, None]
            logs += np.log(by)
    return alpha, out


def parts_by_length(found: list[str], sizes: list[int], most: int = 1024) -> Iterator[np.ndarray]:
    """Indices of words of similar length, in parts of at most ``most`` words and about ``CELLS`` cells."""
    order = sorted(range(len(found)), key=lambda i: len(found[i]))
    part: list[int] = []
    for i in order:
        n = len(found[i])
        if part and (len(part) >= most or (len(part) + 1) * n * sum(k <= n for k in sizes) > CELLS):
            yield np.array(part)
            part = []
        part.append(i)
    if part:
        yield np.array(part)


def log_scores(found: list[str], pieces: dict[str, int], prob: np.ndarray) -> np.ndarray:
    """[word, language] log probabilities of whole words over all their segmentations."""
    lengths, sizes = np.fromiter(map(len, found), np.int64, len(found)), piece_sizes(pieces)
    out = np.empty((len(found), prob.shape[1]))
    for part in parts_by_length(found, sizes):
        out[part] = forward(lattice([found[i] for i in part], pieces, sizes), lengths[part], prob, sizes)[1]
    return out


def fit_pieces(counts: list[tuple[str, str, int]], langs: list[str], pieces: dict[str, int], rounds: int = 4, smooth: float = 0.02) -> np.ndarray:
    """Piece probabilities [piece, language] by EM on (lang, word, count) of the bounded sample; last row zero."""
    column = {lang: i for i, lang in enumerate(langs)}
    spans: dict[str, np.ndarray] = {}
    for lang, word, n in counts:
        spans.setdefault(word, np.zeros(len(langs)))[column[lang]] += n
    size = len(pieces) + 1
    prob = np.full((size + 1, len(langs)), 1.0 / size)
    prob[-1] = 0.0
    found, sizes = sorted(spans), piece_sizes(pieces)
    parts = [[found[i] for i in part] for part in parts_by_length(found, sizes, 4096)]
    for _ in range(rounds):
        expected = np.full((size + 1, len(langs)), smooth)
        for part in parts:
            lengths = np.fromiter(map(len, part), np.int64, len(part))
            grid, weight = lattice(part, pieces, sizes), np.array([spans[s] for s in part])
            n, width, count = grid.shape
            each = np.ones((n, len(langs)))
            if width > RESCALE:  # a factor per character that brings each word's sum to 1
                each = np.exp(-forward(grid, lengths, prob, sizes)[1] / lengths[:, None])
            alpha = forward(grid, lengths, prob, sizes, each)[0]
            beta = np.zeros_like(alpha)
            beta[np.arange(n), lengths] = 1.0
            for start in range(width - 1, -1, -1):
                for at, k in enumerate(sizes[:count]):
                    if k > width - start:
                        break
                    beta[:, start] += prob[grid[:, start, at]] * each**k * beta[:, start + k]
            scale = weight / np.maximum(alpha[np.arange(n), lengths], 1e-300)
            for start in range(width):
                for at, k in enumerate(sizes[:count]):
                    if k > width - start:
                        break
                    ids = grid[:, start, at]
                    ok = ids >= 0
                    if not ok.any():
                        continue
                    share = alpha[ok, start] * prob[ids[ok]] * each[ok] ** k * beta[ok, start + k] * scale[ok]
                    for c in range(len(langs)):
                        expected[:, c] += np.bincount(ids[ok], share[:, c], size + 1)
        expected[-1] = 0.0
        prob = expected / expected.sum(0)
    return prob


def fit(docs: DataFrame, pieces: dict[str, int], fit_docs: int = FIT_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities from rows (doc_id, text, lang) with a language.

    Rows per language are counted first; then about ``fit_docs`` whole texts of each are chosen by
    a hash of the id, their words counted in Spark, and the counts (bounded by the sample) fitted.
    """
    known = docs.where(F.col("lang").isNotNull())
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return [], np.zeros((len(pieces) + 2, 0))
    bound = F.lit(0)
    for lang, n in totals.items():
        bound = F.when(F.col("lang") == lang, F.lit(int(min(1.0, fit_docs / n) * (1 << 30)))).otherwise(bound)
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < bound)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        seen: dict[str, Counter] = {}
        for b in slices(batches):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(letter_words(text))
        for lang, c in seen.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(c), "word": list(c), "n": list(c.values())}, _COUNTS)

    rows = chosen.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).orderBy("lang", "word").collect()
    langs = sorted(totals)
    return langs, fit_pieces([(r["lang"], r["word"], r["n"]) for r in rows], langs, pieces)


_COUNTS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
_CACHE: dict[str, tuple[dict[str, int], np.ndarray]] = {}  # word: row of the scores


def predict(docs: DataFrame, langs: list[str], prob: np.ndarray, pieces: dict[str, int]) -> DataFrame:
    """(doc_id, lang_pred, score, n_words): the likeliest language of the whole text under equal priors.

    score is its posterior probability. A text that is null or has no letter, and any text when no
    language was learned, gets ``und`` with score 0. Ties go to the first language by name. Repeated
    rows are scored each; an unknown character has its own learned probability.
    """
    model = docs.sparkSession.sparkContext.broadcast((langs, prob, pieces))
    token = uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prob, pieces = model.value
        if token not in _CACHE:
            _CACHE.clear()
            _CACHE[token] = {}, np.zeros((CACHE_WORDS + 65_536, len(langs)))
        known, scores = _CACHE[token]
        for b in slices(batches, 128):
            bags = [letter_words(t) for t in b.column("text").to_pylist()]
            new = {w for bag in bags for w in bag}.difference(known)
            names: list[str] = []
            if new and langs:
                if len(known) + len(new) > len(scores):  # very long texts
                    scores = np.concatenate([scores[: len(known)], np.zeros((2 * len(new), len(langs)))])
                    _CACHE[token] = known, scores
                names = list(new)
                scores[len(known) : len(known) + len(names)] = log_scores(names, pieces, prob)
                known.update(zip(names, range(len(known), len(known) + len(names)), strict=True))
            best, share = [], []
            for bag in bags:
                if not bag or not langs:
                    best.append("und")
                    share.append(0.0)
                    continue
                total = scores[list(map(known.__getitem__, bag))].sum(0)
                e = np.exp(total - total.max())
                k = int(np.argmax(total))
                best.append(langs[k])
                share.append(float(e[k] / e.sum()))
            if len(known) > CACHE_WORDS:  # the words that came first are the common ones
                for w in names:
                    del known[w]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(best, pa.string()), pa.array(share, pa.float64()), pa.array([len(x) for x in bags], pa.int64())], names=["doc_id", "lang_pred", "score", "n_words"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, lang_pred string, score double, n_words long")
