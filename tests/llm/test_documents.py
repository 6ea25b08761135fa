"""Text operators beside brute force, held-out accuracy or round trips."""

import hashlib
import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenforge.llm import bpe, brown, chains, langid, mixing, oddsketch, quality, queries, text

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string"


def frame(spark, rows):
    """Documents with an extra column whose name the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), "w") for i, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def local(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def edges(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(1, None, "en"), (2, "", "en"), (3, "  \n\t ", None), (4, "one", "de"), (5, "one two", "de"), (6, "ONE two", "fr"), (None, "one two", "en"), (7, long, "en"), (8, long, "en"), (8, long, "en"), (9, "\x1c \x85   é 12 !?", "es"), (5, "other text here", "de")]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# --- helpers
def test_words_and_fold():
    assert text.words("A\x0bB\x1cc\x85 É\n") == [b"a", "b\x1cc\x85".encode(), "É".encode()]
    assert text.words(None) == text.words("") == []


# --- 1 quality
def test_quality_catches_toxic(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.graded(docs, labels).collect()}
    toxic = [got[r["doc_id"]] for r in labels.where("toxic = 1").collect()]
    good = [got[r["doc_id"]] for r in labels.where("toxic = 0 and quality = 1").collect()]
    poor = [got[r["doc_id"]] for r in labels.where("toxic = 0 and quality = 0").collect()]
    assert np.mean([r["kept"] for r in toxic]) < 0.05 and np.mean([r["kept"] for r in good]) > 0.98
    assert np.mean([r["expected_grade"] for r in toxic]) < np.mean([r["expected_grade"] for r in poor]) < np.mean([r["expected_grade"] for r in good])
    for r in got.values():
        assert 0 <= r["top_probability"] <= r["tail_probability"] <= 1
        assert math.isclose(r["expected_grade"], r["top_probability"] + r["tail_probability"], rel_tol=1e-9)


def test_quality_edges(spark, edges, empty):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, None), (6, None, 1), (None, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.graded(edges, labels).count() == edges.count()
    assert quality.graded(empty, labels).count() == 0
    assert quality.graded(edges, labels.limit(0)).count() == edges.count()


def test_ordinal_model_orders_grades():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 600)
    rows = [np.unique(np.append(rng.integers(100, 200, 5), 10 + g)).astype(np.uint32) for g in grades]
    w, cuts = quality.fit_ordinal(rows, grades, 3)
    assert cuts[0] < cuts[1] and w[10] < w[11] < w[12]


# --- 2 language
def test_forward_sums_all_segmentations():
    pieces = {"a": 1, "ab": 2, "b": 3}
    prob = np.array([[0.01], [0.2], [0.3], [0.4], [0.0]])
    got = np.exp(langid.log_scores(["abb", "xa", "b"], pieces, prob)).ravel()
    assert np.allclose(got, [0.2 * 0.4 * 0.4 + 0.3 * 0.4, 0.01 * 0.2, 0.4])


def test_long_words_are_summed_whole(spark):
    """Pieces of any length, and words far longer than a double's range allows unscaled."""
    rng = np.random.default_rng(4)
    pieces = {"a": 1, "b": 2, "ab": 3, "abababab": 4, "b" * 30: 5}
    prob = np.vstack([rng.dirichlet(np.ones(6), 2).T, np.zeros(2)])
    words_ = ["".join(rng.choice(list("abx"), n)) for n in (1, 5, 40, 41, 700)] + ["ab" * 1500, "b" * 90]

    def plain(word, column):
        logs = [0.0]
        for end in range(1, len(word) + 1):
            terms = [logs[end - k] + math.log(prob[pieces.get(word[end - k : end], 0), column]) for k in range(1, min(30, end) + 1) if k == 1 or word[end - k : end] in pieces]
            logs.append(max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms)))
        return logs[-1]

    got = langid.log_scores(words_, pieces, prob)
    assert np.allclose(got, [[plain(w, c) for c in range(2)] for w in words_], rtol=1e-9)
    fitted = langid.fit_pieces([("x", w, 3) for w in words_] + [("y", "ba", 1)], ["x", "y"], pieces)
    assert np.isfinite(fitted).all() and np.allclose(fitted.sum(0), 1)
    assert len(langid.public_pieces(queries.tokenizer_json())) > 30_000


def test_language_held_out_accuracy(spark):
    got = queries.QUERIES["op2_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100 and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.98
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark, edges, empty):
    pieces = langid.public_pieces(queries.tokenizer_json())
    langs, prob = langid.fit(edges.where("lang is not null"), pieces)
    got = langid.predict(edges, langs, prob, pieces).collect()
    assert len(got) == edges.count()
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {1, 2, 3}
    assert langid.predict(empty, langs, prob, pieces).count() == 0
    none, p0 = langid.fit(empty, pieces)
    assert {r["lang_pred"] for r in langid.predict(edges, none, p0, pieces).collect()} == {"und"}


# --- 3 mixing
def test_mixing_meets_targets(spark, docs):
    labels = queries.domains(spark.read.parquet(f"{SF}/labels.parquet"))
    found, names = mixing.mixed(docs, labels, queries.TARGETS)
    rows = found.collect()
    n, r = np.array([x["n_tokens"] for x in rows]), np.array([x["rate"] for x in rows])
    p = np.array([[x[f"p_{i}"] for i in range(len(names))] for x in rows])
    assert names == ["good", "poor", "toxic"] and (r >= 0).all() and np.allclose(p.sum(1), 1)
    assert np.allclose((n * r) @ p / n.sum(), [queries.TARGETS[d] for d in names], atol=1e-3)
    assert {x["doc_id"]: x["n_tokens"] for x in rows} == {x["doc_id"]: len(text.words(x["text"])) for x in docs.collect()}


def test_rates_beside_a_plain_solver(spark):
    """The same projected gradient steps in numpy, on soft memberships that need the bound at 0."""
    rng = np.random.default_rng(1)
    p, n = rng.dirichlet([0.6, 0.6, 0.6], 200), rng.integers(1, 500, 200)
    rows = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(200)], "doc_id long, n_tokens long, p_0 double, p_1 double, p_2 double")
    got = {x["doc_id"]: x["rate"] for x in mixing.fit_rates(rows, ["a", "b", "c"], {"a": 0.7, "b": 0.29, "c": 0.01}, rounds=200, close=1e-6).collect()}
    r, have, goal = np.ones(200), n @ p, np.array([0.7, 0.29, 0.01]) * n.sum()
    for _ in range(200):
        if np.abs((n * r) @ p - goal).max() <= 1e-6 * goal.sum():
            break
        r = np.maximum(0, r - p @ (((n * r) @ p - goal) / have))
    assert np.allclose([got[i] for i in range(200)], r, atol=1e-6)
    assert min(r) == 0


def test_mixing_total_by_a_domain_and_out_of_reach(spark, docs):
    labels = queries.domains(spark.read.parquet(f"{SF}/labels.parquet"))
    rows = mixing.mixed(docs, labels, queries.TARGETS, total="good")[0].collect()
    got = np.array([x["n_tokens"] * x["rate"] for x in rows]) @ np.array([[x[f"p_{i}"] for i in range(3)] for x in rows])
    good = sum(x["n_tokens"] * x["p_0"] for x in rows)
    want = np.array([queries.TARGETS[d] for d in ("good", "poor", "toxic")])
    want = want / want.sum()
    assert np.allclose(got / (good / want[0]), want, atol=2e-4) and rows[0]["residual"] <= 1e-4
    same = spark.createDataFrame([(i, 10, 0.5, 0.5) for i in range(20)], "doc_id long, n_tokens long, p_0 double, p_1 double")
    assert {round(x["residual"], 6) for x in mixing.fit_rates(same, ["a", "b"], {"a": 0.9, "b": 0.1}).collect()} == {0.4}


def test_mixing_edges(spark, edges, empty):
    labels = spark.createDataFrame([(4, "a"), (5, "b"), (6, None), (None, "a"), (8, "b"), (8, "a")], "doc_id long, domain string")
    found, names = mixing.mixed(edges, labels, {"a": 1, "b": 1})
    rows = found.collect()
    assert names == ["a", "b"] and len(rows) == edges.count() and all(r["n_tokens"] is not None for r in rows)
    assert mixing.mixed(empty, labels, {"a": 1})[0].count() == 0
    assert mixing.domain_posteriors(edges, labels.limit(0))[0].count() == edges.count()
    with pytest.raises(ValueError):
        mixing.mixed(edges, labels, {"z": 1})


# --- 4 Brown classes
def test_brown_counts_and_base(spark, docs, local):
    got = {r["doc_id"]: r for r in brown.scored(docs).collect()}
    count, seen = Counter(), {i: text.words(t) for i, t in local.items()}
    for i, w in seen.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*w, b""])
    total, distinct = sum(count.values()), len(count)
    for i, w in seen.items():
        r, tokens = got[i], [*w, b""]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(count[x] > 0 for x in tokens), total)
        assert math.isclose(r["base_score"], sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in tokens), rel_tol=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_brown_is_a_distribution(spark):
    """Probabilities of all known words and one unseen word of each class add to 1 after any word."""
    rows = frame(spark, [(i, t, None) for i, t in enumerate(["a b a c", "b a b", "c c a d9 ee", "a"])])
    model = brown.fit(rows)
    words_ = [bytes(r["word"]) for r in model["table"].collect()]
    n = {bytes(r["word"]): r["n"] for r in model["table"].collect()}
    cls = {w: model["symbols"].get(w, int(model["kinds"][brown.kind(w)]) if w else 0) for w in words_}
    for c in range(brown.CLASSES):
        inside = [w for w in words_ if cls[w] == c]
        mass = sum(10 ** (math.log10(n[w] + 1) - model["class_log"][c]) for w in inside) + 10 ** -model["class_log"][c]
        assert math.isclose(mass, 1.0, rel_tol=1e-9)
    assert np.allclose((10 ** model["step"]).sum(1), 1)


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(2)
    kinds = rng.integers(0, 3, 60)
    pairs = np.zeros((61, 61))
    for i in range(60):
        for j in range(60):
            pairs[i + 1, j + 1] = rng.poisson(6 if (kinds[i] + 1) % 3 == kinds[j] else 0.3)
    cls = brown.exchange(pairs, n_classes=4, rounds=20)
    groups = [Counter(kinds[cls[1:] == c]) for c in set(cls[1:].tolist())]
    assert all(max(g.values()) == sum(g.values()) for g in groups) and cls[0] == 0


def test_brown_edges(spark, edges, empty):
    got = brown.scored(edges).collect()
    assert len(got) == edges.count() and all(r["score"] is not None and r["score"] < 0 for r in got)
    assert brown.scored(empty).count() == 0
    assert Counter(r["doc_id"] for r in got)[8] == 2
    held = frame(spark, [(i, "x y", None) for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2])
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in brown.scored(held).collect())


# --- 5 chains
def test_passages_planted(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 6))
    fresh = lambda n: [word() for _ in range(n)]
    passage = fresh(80)
    edited = [w if i % 17 else word() for i, w in enumerate(passage)]
    shifted = passage[:40] + fresh(3) + passage[40:]
    rows = [(1, [*fresh(100), *passage, *fresh(60)]), (2, [*fresh(30), *passage, *fresh(10)]), (3, edited), (4, [*fresh(5), *shifted, *fresh(200)]), (5, fresh(300)), (6, [*fresh(20), *passage[:30], *fresh(50)]), (7, fresh(20))]
    docs = frame(spark, [(i, " ".join(w), None) for i, w in rows])
    got = {r["doc_id"]: r for r in chains.passages(docs).collect()}
    assert set(got) == {2, 3, 4} and {r["ref_doc_id"] for r in got.values()} == {1}
    assert (got[2]["start"], got[2]["end"], got[2]["ref_start"], got[2]["ref_end"], got[2]["n_equal"]) == (30, 110, 100, 180, 80)
    assert got[3]["end"] - got[3]["start"] >= 78 and 0.9 < got[3]["similarity"] < 1
    assert (got[4]["start"], got[4]["end"]) == (5, 88) and got[4]["n_equal"] == 80
    kept = {r["doc_id"]: r["text"].split() for r in chains.without_repeats(docs, chains.passages(docs)).collect()}
    assert kept[1] == rows[0][1] and kept[2] == rows[1][1][:30] + rows[1][1][110:] and kept[5] == rows[4][1] and kept[6] == rows[5][1]
    assert len(kept.get(3, [])) <= 2


def test_passages_without_one_first_place(spark):
    """Text that repeats itself, and passages whose parts stood in other documents before and between."""
    rng = np.random.default_rng(8)
    fresh = lambda n: ["".join(chr(97 + x) for x in rng.integers(0, 26, 6)) for _ in range(n)]
    line, passage, long_ = fresh(12), fresh(120), fresh(40)
    parts = [passage[i : i + 30] for i in range(0, 120, 30)]
    rows = [(10 + i, [*fresh(9), *p, *fresh(9)]) for i, p in enumerate(parts)]
    rows += [(20, [*fresh(15), *passage, *fresh(15)])]
    rows += [(30 + i, [*fresh(9), *p, *fresh(9)]) for i, p in enumerate(parts)]
    rows += [(40, [*fresh(25), *passage, *fresh(5)])]
    rows += [(1, [*fresh(10), *line * 8, *fresh(10)]), (2, [*fresh(3), *line[5:], *line * 7, *fresh(10)])]
    rows += [(3, [*fresh(10), *long_ * 40]), (4, [*long_[20:], *long_ * 35, *fresh(30)])]
    got = chains.passages(frame(spark, [(i, " ".join(w), None) for i, w in rows])).collect()
    covered = {}
    for r in got:
        covered.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    assert set(covered) == {2, 4, 40}
    assert covered[40] == set(range(25, 145)) and {r["ref_doc_id"] for r in got if r["doc_id"] == 40} == {20}
    assert covered[2] == set(range(3, 94)) and covered[4] == set(range(20 + 35 * 40))


def test_passages_whose_seeds_are_all_common(spark):
    """Halves that stand alone and joined, 75 times over: each joined text after the first repeats 60 words."""
    rng = np.random.default_rng(17)
    fresh = lambda n: ["".join(chr(97 + x) for x in rng.integers(0, 26, 6)) for _ in range(n)]
    one, two = fresh(30), fresh(30)
    rows = []
    for _ in range(75):
        rows += [[*fresh(5), *one, *fresh(5)], [*fresh(5), *two, *fresh(5)], [*fresh(5), *one, *two, *fresh(5)]]
    got = chains.passages(frame(spark, [(i, " ".join(w), None) for i, w in enumerate(rows)])).collect()
    assert {r["doc_id"] for r in got} == set(range(5, 225, 3))
    assert all((r["start"], r["end"], r["ref_doc_id"], r["similarity"]) == (5, 65, 2, 1.0) for r in got)


def test_exact_repeats_beside_brute_force(spark):
    """Texts of one small stock of phrases: every 50 words that stand in an earlier document are covered."""
    rng = np.random.default_rng(29)
    stock = [["".join(chr(97 + x) for x in rng.integers(0, 26, 5)) for _ in range(rng.integers(6, 25))] for _ in range(12)]
    rows = [sum((stock[x] for x in rng.integers(0, 12, rng.integers(3, 30))), []) for _ in range(150)]
    covered, seen = {}, set()
    for r in chains.passages(frame(spark, [(i, " ".join(w), None) for i, w in enumerate(rows)])).collect():
        covered.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    exact = 0
    for i, w in enumerate(rows):
        grams = {tuple(w[j : j + 50]): None for j in range(len(w) - 49)}
        want = {x for j in range(len(w) - 49) if tuple(w[j : j + 50]) in seen for x in range(j, j + 50)}
        exact += len(want)
        assert want <= covered.get(i, set()), i
        seen.update(grams)
    assert exact > 5000


def best_local(a, b, sim=0.8):
    """(words of a, words of b, equal words) of the best local alignment, by the quadratic recursion."""
    best, prev = (0.0, 0, 0, 0), [(0.0, 0, 0, 0)] * (len(b) + 1)
    for x in a:
        row = [(0.0, 0, 0, 0)]
        for j, y in enumerate(b, 1):
            d, u, v = prev[j - 1], prev[j], row[j - 1]
            row.append(max((0.0, 0, 0, 0), (d[0] + ((1 - sim) if x == y else -sim), d[1] + (x == y), d[2] + 1, d[3] + 1), (u[0] - sim / 2, u[1], u[2] + 1, u[3]), (v[0] - sim / 2, v[1], v[2], v[3] + 1)))
        best, prev = max(best, *row), row
    return best[2], best[3], best[1]


def test_fuzzy_passages_beside_quadratic_alignment(spark):
    rng = np.random.default_rng(21)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 6))
    fresh = lambda n: [word() for _ in range(n)]
    rows, of, want = [], {}, {}
    for sim in (0.8, 0.85, 0.9):
        for n in (55, 63, 80):
            for _ in range(100 if sim == 0.8 else 25):
                passage, i = fresh(n), len(rows)
                edited = list(passage)
                for x in rng.choice(n, int((1 - sim) * n + 1e-9), replace=False):
                    edited[x] = word()
                a, b = [*fresh(15), *passage, *fresh(15)], [*fresh(15), *edited, *fresh(15)]
                rows += [(i, " ".join(a), None), (i + 1, " ".join(b), None)]
                of[i + 1] = sim
                u, v, equal = best_local(a, b)
                if min(u, v) >= 50 and equal / max(u, v) >= 0.8:
                    want.setdefault(sim, set()).add(i + 1)
    got = {r["doc_id"] for r in chains.passages(frame(spark, rows)).collect()}
    recall = {sim: len(ids & got) / len(ids) for sim, ids in want.items()}
    print("recall", {k: (len(v), recall[k]) for k, v in want.items()})
    assert got <= set(of) and min(map(len, want.values())) >= 15
    assert recall[0.8] >= 0.9 and recall[0.85] >= 0.97 and recall[0.9] >= 0.97


def best_chain(anchors, cost, gap):
    """Score of the best chain by the quadratic recursion."""
    scores = []
    for i, (s, e, r) in enumerate(sorted(anchors)):
        best = 0.0
        for (ps, pe, pr), v in zip(sorted(anchors)[:i], scores, strict=True):
            if pe <= s and pr + pe - ps <= r:
                best = max(best, v - cost * (s - pe + r - (pr + pe - ps)))
        scores.append(e - s + best)
    return max(scores)


def test_fenwick_chains_beside_quadratic():
    rng = np.random.default_rng(4)
    for _ in range(60):
        anchors = []
        for _ in range(rng.integers(1, 25)):
            s, r, n = rng.integers(0, 120), rng.integers(0, 120), rng.integers(5, 12)
            anchors.append((int(s), int(s + n), int(r)))
        anchors = sorted(set(anchors))
        got = chains.chain(anchors, 0.25, 10**6)
        first = got[0]
        score = sum(e - s for s, e, _ in first) - 0.25 * sum(b[0] - a[1] + b[2] - (a[2] + a[1] - a[0]) for a, b in zip(first, first[1:], strict=False))
        assert math.isclose(score, best_chain(anchors, 0.25, 10**6))
        assert sorted(a for c in got for a in c) == anchors


def test_chain_edges(spark, edges, empty):
    rows = chains.passages(edges).collect()
    assert {(r["doc_id"], r["ref_doc_id"]) for r in rows} == {(8, 7)}
    assert chains.passages(empty).count() == 0
    kept = chains.without_repeats(edges, chains.passages(edges))
    assert kept.columns == edges.columns and kept.count() == edges.count() - 2
    assert chains.remove("a b  c d\n", [(1, 3), (2, 9)]) == "a " and chains.remove(" a b", []) == " a b"


# --- 6 odd sketches
def brute_components(local, size):
    sets = {i: oddsketch.shingles(text.words(t), size) for i, t in local.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    has = {}
    for i, s in sets.items():
        for x in s:
            has.setdefault(x, []).append(i)
    shared = Counter()
    for i, s in sets.items():
        common = Counter(j for x in s for j in has[x] if j < i)
        for j, c in common.items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
                shared[i] += 1
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_beside_brute_force(docs, local, size):
    small = {i: t for i, t in local.items() if len(t) < 6000}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in oddsketch.near_duplicates(docs.where(F.length("text") < 6000), size=size).collect()}
    want = brute_components(small, size)
    assert got == want and sum(i != c for i, (_, c) in want.items()) > 20


def test_chained_copies_in_one_bucket(spark):
    """A chain of texts, each near its neighbours only, and a mixed bucket beyond one tile."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(12):
        base = [f"n{k}x{i}" if i in range(k * 9, k * 9 + 9) else w for i, w in enumerate(base)]
        rows.append((100 + k, " ".join(base), None))
    rows += [(k, " ".join(f"w{i}" if i % 40 else f"z{k}" for i in range(120)), None) for k in range(60)]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r["component_id"] for r in oddsketch.near_duplicates(docs, size=2).collect()}
    want = {i: c for i, (_, c) in brute_components({i: t for i, t, _ in rows}, 2).items()}
    assert got == want
    whole = oddsketch.TILE
    try:
        oddsketch.TILE = 7
        assert {r["doc_id"]: r["component_id"] for r in oddsketch.near_duplicates(docs, size=2).collect()} == want
    finally:
        oddsketch.TILE = whole


def test_odd_sketch_estimate():
    rng = np.random.default_rng(5)
    common = rng.integers(0, 2**63, 900, dtype=np.uint64)
    for keep, most in ((0.9, True), (0.3, False)):
        a = np.concatenate([common, rng.integers(0, 2**63, 5, dtype=np.uint64)])
        b = np.concatenate([common[: int(keep * 900)], rng.integers(0, 2**63, 5 if most else 900, dtype=np.uint64)])
        x, y = (np.frombuffer(oddsketch.odd_sketch(oddsketch.minhash(h)), np.uint64) for h in (a, b))
        assert (np.bitwise_count(x ^ y).sum() <= oddsketch.most_differing(0.8)) == most


def test_near_duplicate_edges(edges, empty):
    rows = oddsketch.near_duplicates(edges, size=2).collect()
    assert len(rows) == edges.count()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"], r["kept"]))
    assert got[1] == {(0, 1, True)} and got[2] == {(0, 2, True)} and got[None] == {(1, None, True)}
    assert got[5] == {(1, 5, True), (2, 5, True)} and got[6] == {(1, 5, False)}
    assert {c for _, c, _ in got[7] | got[8]} == {7}
    assert oddsketch.near_duplicates(empty).count() == 0


# --- 8 BPE
def reference(texts):
    t = bpe.load(queries.tokenizer_json())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts], t


def test_bpe_beside_library(spark, docs, local):
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_bpe"](spark, SF).collect()}
    ids, t = reference(local.values())
    for i, want in zip(local, ids, strict=True):
        assert got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.decode(want, skip_special_tokens=False).encode()).hexdigest()


def odd_texts():
    rng = np.random.default_rng(6)
    alphabets = ["ab", "aé漢 \n", "a'sdt ", "  \n\t", "x1 2!?", "<|endoftext|> ", "\x1c\x1d a 　", "👩‍👧 é́", "ñ¿ß"]
    yield from ("", " ", "<|endoftext|>", "a" * 700, " " * 300 + "x", "it's they'll 'tis" * 30, "👍" * 200)
    for a in alphabets:
        for n in (3, 40, 400):
            yield "".join(rng.choice(list(a), n))
    for _ in range(40):
        yield "".join(rng.choice(["hello", "<|endoftext|>", " ", "  ", "\n\n", "don't", "漢字", "x" * 30, "99", "!!", "é", "\x1c", "\xa0"], 60))


@pytest.mark.parametrize("leaf", [1, 3, 7, 50])
def test_tree_concatenation_beside_library(leaf):
    texts = list(odd_texts())
    want, t = reference(texts)
    table = bpe.token_bytes(queries.tokenizer_json())
    cache: dict = {}
    for text_, ids in zip(texts, want, strict=True):
        parts = [t.encode(p, add_special_tokens=False).ids for p in bpe.halves(text_, leaf)]
        assert bpe.concatenate(t, table, parts) == ids, text_[:80]
        assert np.frombuffer(bpe.encode_short(t, text_, cache), "<u4").tolist() == ids, text_[:80]


def test_bpe_spark_tree_and_edges(spark, edges, empty):
    spec = queries.tokenizer_json()
    rows = edges.select("doc_id", "text").collect() + [(20 + i, x) for i, x in enumerate(odd_texts())]
    docs = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string")
    got = Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in bpe.decode(bpe.encode(docs, spec, leaf=64), spec).collect())
    ids, _ = reference([r[1] for r in rows])
    assert got == Counter((r[0], np.array(x, "<u4").tobytes(), r[1] or "") for r, x in zip(rows, ids, strict=True))
    assert bpe.encode(empty, spec).count() == 0


# --- 4 Brown classes, every word
def test_every_word_moves_singly(spark, monkeypatch):
    """The likelihood rises beyond the start, words of a kind part, and the counts by class are those of the texts."""
    rng = np.random.default_rng(9)
    name = lambda i: "".join(chr(97 + int(x)) for x in rng.integers(0, 26, 2 + i % 9)) + str(i) * (i % 2)
    first, second = [name(i) for i in range(60)], [name(i) for i in range(60)]
    texts = [" ".join(x for _ in range(12) for x in ("the", str(rng.choice(first)), "of", str(rng.choice(second)))) for _ in range(120)]
    rows = frame(spark, [(i, t, None) for i, t in enumerate(texts)])
    monkeypatch.setattr(brown, "HELD", 4)
    monkeypatch.setattr(brown, "MOVED", 2)
    model = brown.fit(rows)
    assert model["trace"][-1] > model["trace"][0] and all(b >= a for a, b in zip(model["trace"], model["trace"][1:]))
    cls = {bytes(r["word"]): model["symbols"].get(bytes(r["word"]), r["class"]) for r in model["table"].collect()}
    assert None not in cls.values() and set(cls) == {w.encode() for t in texts for w in t.split()} | {b""}
    of: dict = {}
    for w, c in cls.items():
        if w not in model["symbols"]:
            of.setdefault(brown.kind(w), set()).add(c)
    assert max(map(len, of.values())) > 1
    joint = np.zeros((brown.CLASSES, brown.CLASSES))
    for t in texts:
        c = [0, *(cls[w.encode()] for w in t.split()), 0]
        np.add.at(joint, (c[:-1], c[1:]), 1)
    assert np.allclose(model["step"], np.log10((joint + 0.5) / (joint.sum(1, keepdims=True) + 0.5 * brown.CLASSES)))
    count = {w: n for w, n in ((bytes(r["word"]), r["n"]) for r in model["table"].collect())}
    held = frame(spark, [(0, texts[0], None), (1, "the unseen of", None), (2, None, None)]).selectExpr("doc_id", "text", "true AS held_out")
    got = {r["doc_id"]: r["score"] for r in brown.score(held, model).collect()}
    for i, t in ((0, texts[0]), (1, "the unseen of"), (2, "")):
        w = [x.encode() for x in t.split()]
        c = [0, *(cls.get(x, int(model["kinds"][brown.kind(x)])) for x in w), 0]
        want = sum(model["step"][a, b] for a, b in zip(c[:-1], c[1:])) + sum(math.log10(count.get(x, 0) + 1) - model["class_log"][k] for x, k in zip([*w, b""], c[1:]))
        assert math.isclose(got[i], want, rel_tol=1e-9)
