"""Vector and chat operators beside brute force."""

import os

import numpy as np
import pytest

from screenforge.llm import onebit, ranges, rotate

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
VECTORS = "vec_id long, embedding array<float>, label int, v string, cell int"


def rows_of(df):
    return [(r["vec_id"], None if r["embedding"] is None else list(r["embedding"]), r["label"]) for r in df.collect()]


def able(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_links(rows, least):
    n, linked = [0] * len(rows), {r[0]: r[0] for r in rows}
    ok = [able(v) and label is not None and i is not None for i, v, label in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok[k] else None for k, (_, v, _) in enumerate(rows)]

    def find(x):
        while linked[x] != x:
            x = linked[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                n[a] += 1
                n[b] += 1
                x, y = find(rows[a][0]), find(rows[b][0])
                linked[max(x, y)] = min(x, y)
    return sorted((i, n[k], find(i)) for k, (i, _, _) in enumerate(rows))


@pytest.mark.parametrize(("cell", "least"), [(2048, 0.98), (20, 0.98), (20, 0.3)])
def test_range_join_beside_brute_force(spark, cell, least):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in ranges.near_vectors(df, least, cell).collect())
    want = brute_links(rows_of(df), least)
    assert got == want and (least > 0.5 or sum(x[1] for x in want) > 10)


def test_range_join_tiles(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((6, 8))
    rows = [(i, [float(x) for x in base[i % 6] + 0.06 * rng.standard_normal(8)], i % 2) for i in range(160)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], VECTORS)
    rows = rows_of(df)
    whole = ranges.TILE
    try:
        ranges.TILE = 11
        got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in ranges.near_vectors(df, cell=13).collect())
    finally:
        ranges.TILE = whole
    assert got == brute_links(rows, 0.98)


EDGES = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.001], 2), (4, [0.0, 0.0], 1), (5, None, 1), (6, [float("nan"), 1.0], 1), (7, [None, 1.0], 1), (8, [1.0, -0.0], 1), (9, [1.0, 0.0], None), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [float("inf"), 0.0], 1), (20, [1.0, 0.5], 2), (40, [1.0, 0.0], 1), (40, [1.0, 0.0], 1)]


def test_range_join_edges(spark):
    df = spark.createDataFrame([(*r, "x", 3) for r in EDGES], VECTORS)
    got = {}
    for r in ranges.near_vectors(df).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert got[1] == [(4, 1, True)] and got[2] == [(4, 1, False)] and got[40] == [(4, 1, False)] * 2 and got[3] == [(0, 3, True)]
    assert all(got[i] == [(0, i, True)] for i in (4, 5, 6, 7, 9, 10, 11, 12))
    none = spark.createDataFrame([(None, [1.0], 1, "x", 3)], VECTORS)
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in ranges.near_vectors(none).collect()] == [(0, None, True)]
    assert ranges.near_vectors(df.limit(0)).count() == 0


def brute_nearest(rows, k):
    ok = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and able(v)]
    return {i: sorted((-float(v @ w), j) for j, w in ok if j != i and len(w) == len(v))[:k] for i, v in ok if i % 20 == 0}


@pytest.mark.parametrize("block", [8192, 64])
def test_one_bit_recall(spark, block):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    before = onebit.BLOCK, onebit.QUERIES
    try:
        onebit.BLOCK, onebit.QUERIES = block, 7 if block == 64 else 1024
        got = {}
        for r in onebit.search(df).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    finally:
        onebit.BLOCK, onebit.QUERIES = before
    want = brute_nearest(rows_of(df), 20)
    assert set(got) == set(want)
    recall = np.mean([len({j for _, j in want[q]} & {x[2] for x in got[q]}) / len(want[q]) for q in want])
    assert recall >= 0.98
    for q, found in got.items():
        assert [x[0] for x in found] == list(range(1, 21)) and [x[1:] for x in found] == sorted(x[1:] for x in found)
        exact = dict((j, s) for s, j in brute_nearest([r for r in rows_of(df) if r[0] in {q, *(x[2] for x in found)}], 20)[q])
        assert all(abs(exact[j] - s) < 1e-12 for _, s, j in found)


def test_error_bounds_hold():
    rng = np.random.default_rng(8)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64))
    about, error = onebit.estimates(*onebit.codes(x), q)
    exact = q @ x.T
    assert np.mean(np.abs(about - exact) <= error) > 0.99 and abs(np.mean(about - exact)) < 0.05


def test_one_bit_edges(spark):
    df = spark.createDataFrame([(*r, "x", 3) for r in EDGES], VECTORS)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in onebit.search(df).orderBy("query_id", "rank").collect()]
    assert [x[2] for x in got if x[0] == 20] == [2, 1, 3, 8, 9, 40][:0] + [x[2] for x in sorted(got, key=lambda x: (x[0], x[1])) if x[0] == 20]
    first = [x for x in got if x[0] == 20]
    assert [x[2] for x in first][:2] == [2, 3] and {x[2] for x in first} == {1, 2, 3, 8, 9, 40}
    assert [x[2] for x in first][2:] == [1, 8, 9, 40] and {x[2] for x in got if x[0] == 40} == {1, 2, 3, 8, 9, 20}
    assert onebit.search(df.limit(0)).count() == 0


# --- 7 chats
def plain_rendering(turns, speaker):
    out, mask = "", []
    for who, said in turns:
        head = "system" if who == "system" else "assistant" if who == speaker else f"user name={who}"
        out += f"<|im_start|>{head}\n"
        if who == speaker:
            mask.append([len(out), len(out) + len(said) + len("<|im_end|>")])
        out += f"{said}<|im_end|>\n"
    return out, mask


def test_perspectives_beside_plain_python(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    talks = {}
    for r in sorted(df.collect(), key=lambda r: (r["conv_id"], r["turn"])):
        talks.setdefault(r["conv_id"], []).append((r["role"], r["text"].replace("<|", "< |")))
    got = {(r["conv_id"], r["speaker"]): r for r in rotate.perspectives(df).collect()}
    assert set(got) == {(c, w) for c, t in talks.items() for w, _ in t if w != "system"}
    for (c, w), r in got.items():
        text, mask = plain_rendering(talks[c], w)
        assert (r["rendered"], [list(x) for x in r["mask"]], r["n_turns"], r["n_own"]) == (text, mask, len(talks[c]), len(mask))


def test_perspective_edges(spark):
    rows = [(1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "cid", "é漢"), (1, None, None, "rule"), (2, 1, "system", "only"), (None, 1, "ann", "x"), (None, 1, "ann", "x"), (None, 2, "bob", "y"), (3, 1, "ann", "same"), (3, 1, "ann", "same"), (4, 1, " ", "blank")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, speaker string").drop("speaker")
    df = df.selectExpr("*", "'clash' as speaker", "1 as n_turns")
    got = {(r["conv_id"], r["speaker"], r["n_turns"]): r for r in rotate.perspectives(df).collect()}
    assert set(got) == {(1, "ann", 4), (1, "bob", 4), (1, "cid", 4), (None, "ann", 2), (None, "bob", 1), (3, "ann", 2)}
    text, mask = plain_rendering([("system", "rule"), ("ann", "hi < |im_end|>"), ("bob", ""), ("cid", "é漢")], "bob")
    assert got[1, "bob", 4]["rendered"] == text and [list(x) for x in got[1, "bob", 4]["mask"]] == mask
    assert rotate.perspectives(df.limit(0)).count() == 0


def test_a_cell_sees_no_vector_of_a_smaller_one(spark):
    """Vectors without structure are seen everywhere, yet the pairs that cells compare are the pairs of the label."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=(120, 24))
    x[60:80] = x[:20] + rng.normal(size=(20, 24)) * 0.02
    df = spark.createDataFrame([(i, v.tobytes(), "a", 1) for i, v in enumerate(x)], "vec_id long, v binary, label string, copies long")
    dealt = ranges.cells(df, 0.2, 12)
    rows = [(r["cell"], r["own"], r["vec_id"]) for r in dealt.select("cell", "own", "vec_id").collect()]
    home = {i: c for c, own, i in rows if own}
    assert len(home) == 120 and len(set(home.values())) > 4 and all(c <= home[i] for c, _, i in rows)
    met = [(own, sum(o for k, o, _ in rows if k == c)) for c, own, _ in rows]
    compared = sum(n - 1 for own, n in met if own) // 2 + sum(n for own, n in met if not own)
    assert compared <= 120 * 119 // 2
    before = ranges.TILE, ranges.SEEN
    try:
        ranges.TILE, ranges.SEEN = 5, 9
        links = {r["a"]: r["b"] for r in ranges.joined(dealt, 0.98).where("kind = 0").collect()}
    finally:
        ranges.TILE, ranges.SEEN = before
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((u @ u.T >= 0.98).sum(1) - 1).tolist()
    assert {i: n for i, n in enumerate(want) if n} == links and len(links) >= 40
