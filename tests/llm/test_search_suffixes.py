"""Lexical search, suffix sorting and hard negatives beside brute force."""

import os
import random

import numpy as np
import pytest

from screenforge.llm import hilbert, rmq, suffixes

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
DOCS = "doc_id long, text string, lang string, term int, row string, block int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 3, "r", 7) for i, t in rows], DOCS)


# --- suffixes ---------------------------------------------------------------------------------
def brute_repeats(rows, length):
    """Whole texts: a byte goes if a string over it starts earlier by (doc_id, place)."""
    first = {}
    for i, t in rows:
        data, key = (t or "").encode(), (i is None, i or 0)
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            first[s] = min(first.get(s, (key, p)), (key, p))
    out = []
    for i, t in rows:
        data, key = (t or "").encode(), (i is None, i or 0)
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] != (key, p):
                gone[p : p + length] = b"\1" * length
        spans, p = [], 0
        while p < len(data):
            q = p
            while q < len(data) and gone[q] == gone[p]:
                q += 1
            if gone[p]:
                spans.append((p, q))
            p = q
        out.append((i, len(data), bytes(x for x, g in zip(data, gone, strict=True) if not g), spans))
    return sorted(out, key=str)


def found_repeats(docs, length):
    return sorted(((r["doc_id"], r["n_bytes"], bytes(r["kept"]), [(s["start"], s["end"]) for s in r["spans"]]) for r in suffixes.repeats(docs, length).collect()), key=str)


def planted(n, seed=3):
    """Texts with shared passages of many lengths, copies, near copies, periodic text and a line that most texts have."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(6)]
    line = " ".join(word() for _ in range(25))
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(1, 40)))]
        parts += [rng.choice(passages) for _ in range(rng.randint(0, 2))]
        if i % 3:
            parts.append(line)
        if i % 7 == 0:
            parts.append("ab" * rng.randint(20, 90))
        rng.shuffle(parts)
        rows.append((i, " ".join(parts)))
    rows += [(n + i, rows[i][1]) for i in range(0, n, 9)]
    rows += [(2 * n + i, rows[i][1].replace("a", "b", 3)) for i in range(0, n, 5)]
    return rows


EDGES = [(None, None), (None, "n" * 130), (None, "n" * 130), (1, None), (2, ""), (3, "x" * 99), (4, "x" * 100), (5, "x" * 101), (6, "é" * 80), (7, "short"), (8, "q" * 150 + "z"), (8, "q" * 150 + "z"), (8, "q" * 120)]


def test_suffixes_beside_brute_force(spark):
    rows = planted(60) + EDGES
    rows = [(None if i is None else i + (1000 if k >= len(rows) - len(EDGES) else 0), t) for k, (i, t) in enumerate(rows)]
    random.Random(1).shuffle(rows)
    want = brute_repeats(rows, 100)
    assert found_repeats(docs_of(spark, rows).repartition(5), 100) == want
    assert sum(len(x[3]) for x in want) > 40 and found_repeats(docs_of(spark, rows), 61) == brute_repeats(rows, 61)


def test_suffixes_with_hot_buckets_and_small_blocks(spark):
    rows = planted(50, 8)
    before = suffixes.HOT, suffixes.BLOCK, suffixes.BUCKET
    try:
        suffixes.HOT, suffixes.BLOCK, suffixes.BUCKET = 2, 900, 3000
        assert found_repeats(docs_of(spark, rows).repartition(4), 100) == brute_repeats(rows, 100)
    finally:
        suffixes.HOT, suffixes.BLOCK, suffixes.BUCKET = before


def test_suffixes_empty_table(spark):
    assert suffixes.repeats(docs_of(spark, []), 100).count() == 0
    with pytest.raises(ValueError, match="length"):
        suffixes.repeats(docs_of(spark, []), 30)


def test_cover_has_every_difference():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))
    for a in range(suffixes.PERIOD):
        for b in range(suffixes.PERIOD):
            d = int(suffixes.DISTANCE[a, b])
            assert 0 <= d and (a + d) % suffixes.PERIOD in suffixes.COVER and (b + d) % suffixes.PERIOD in suffixes.COVER


def test_long_ties_are_told_apart_by_ranks():
    rng = np.random.default_rng(4)
    texts = [b"p" * 30 + bytes(rng.integers(97, 99, 40).astype(np.uint8)) + b"s" * 30 for _ in range(300)]
    texts += [texts[i] for i in rng.integers(0, 300, 200)]
    ids = np.arange(len(texts))
    hit = suffixes.Bucket(ids, np.zeros(len(texts), np.int64), np.ones(len(texts), np.int64), [t + b"-" * (i % 31) for i, t in enumerate(texts)], 100)
    hit.at = np.cumsum([0] + [100 + i % 31 for i in range(len(texts) - 1)])  # every remainder of the period
    seen, want = set(), []
    for t in texts:
        want.append(t in seen)
        seen.add(t)
    # the buffer was built for pieces of 100 bytes, so build it anew from the padded texts
    buffer = np.frombuffer(b"".join(t + b"-" * (i % 31) for i, t in enumerate(texts)) + bytes(140), np.uint8)
    hit.eight = np.array([int.from_bytes(buffer[i : i + 8].tobytes(), "big") for i in range(len(buffer) - 7)], np.uint64)
    assert hit.repeated().tolist() == want


# --- lexical search ---------------------------------------------------------------------------
def brute_search(docs, items, k=20):
    import math
    from collections import Counter

    lists = [(i, Counter(rmq.terms(t))) for i, t in docs]
    lists = [(i, c) for i, c in lists if c]
    n, total = len(lists), sum(sum(c.values()) for _, c in lists)
    df = Counter(t for _, c in lists for t in c)
    out = []
    for item, text in items:
        q = rmq.terms(text)
        scores = []
        for i, c in lists:
            m = 75 + (25 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in q if t in c)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def found_search(docs, items, **options):
    return sorted(map(tuple, rmq.search(docs, items, **options).collect()))


ITEMS = "item_id long, text string, doc_id int, rank string"


def test_search_beside_brute_force(spark):
    rng = random.Random(5)
    names = [f"w{i}" for i in range(60)] + ["ÉTÉ", "été", "日本"]
    docs = [(i % 190, " ".join(rng.choices(names, weights=[1 / (j + 1) for j in range(len(names))], k=rng.randint(0, 60)))) for i in range(200)]
    docs += [(900, None), (901, ""), (902, "-- !"), (None, "w1 w2 w3"), (903, "W1,w1;W2"), (903, "W1,w1;W2")]
    items = [(i, " ".join(rng.choices(names, k=rng.randint(1, 12)))) for i in range(25)] + [(30, None), (31, "..."), (32, "w1 w1 w1 zzz"), (None, "w5")]
    before = rmq.POSTINGS, rmq.ENTRIES, rmq.CACHE_WORDS, rmq.best_first.__defaults__
    try:
        rmq.POSTINGS, rmq.ENTRIES, rmq.CACHE_WORDS, rmq.best_first.__defaults__ = 300, 20, 10, (2,)
        df = docs_of(spark, docs).repartition(3)
        got = rmq.search(df, spark.createDataFrame([(i, t, 1, "x") for i, t in [*items, items[0]]], ITEMS))
        got = sorted(map(tuple, got.collect()), key=str)
    finally:
        rmq.POSTINGS, rmq.ENTRIES, rmq.CACHE_WORDS, rmq.best_first.__defaults__ = before
    want = sorted([x for x in brute_search(docs, [(i, t) for i, t in items if i is not None])] + [(None, *x[1:]) for x in brute_search(docs, [(0, "w5")])], key=str)
    assert got == want


def test_search_prunes_and_stays_exact():
    """A list with one large impact: most intervals are never scored."""
    rng = np.random.default_rng(2)
    n = 5000
    tf = np.ones(n, np.int32)
    tf[rng.integers(0, n, 30)] = 50
    blob = rmq.pack([np.arange(n), np.full(n, 60), np.array([n]), np.arange(n, dtype=np.int32), tf])
    shard = rmq.Shard([b"a"], n, blob, {b"a": 700}, n, 60 * n)
    top: list = []
    scored = rmq.best_first(shard, [(b"a", 2)], top, 20, leaf=16)
    every = sorted((-int(2 * s), i) for i, s in enumerate(shard.impact))[:20]
    assert top == every and scored < n // 5


def test_search_empty_tables(spark):
    none, items = docs_of(spark, []), spark.createDataFrame([(1, "a b", 1, "x")], ITEMS)
    assert rmq.search(none, items).count() == 0 and rmq.search(docs_of(spark, [(1, "a")]), items.limit(0)).count() == 0
    assert rmq.search(docs_of(spark, [(1, None), (2, "")]), items).count() == 0


# --- hard negatives ---------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>, label int, row string, block int, x int"


def brute_mine(rows, anchors=100, least=80):
    live = [(i, label, tuple(int(np.floor(256 * np.float64(np.float32(x)))) for x in v)) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    live = list(dict.fromkeys(live))
    out = []
    for a, label, x in live:
        if a % anchors:
            continue
        other = [(-sum(p * q for p, q in zip(x, y, strict=True)), i, k) for i, k, y in live if i != a and len(x) == len(y)]
        positives = sorted((s, i) for s, i, k in other if k == label)[:5]
        for s, p in positives:
            negatives = sorted((t, i) for t, i, k in other if k != label and 80 * -s <= 100 * -t <= 100 * -s)[:5]
            out += [(a, p, r, i, -s, -t) for r, (t, i) in enumerate(negatives, 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(map(tuple, hilbert.mine(df, **options).collect()))


def test_hard_negatives_beside_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((5, 9))
    rows = [(i, [float(x) for x in base[i % 5] * (1 + i % 3) + 0.3 * rng.standard_normal(9)], int(rng.integers(0, 3))) for i in range(700)]
    rows += [(1000 + i, rows[3][1], i % 2) for i in range(80)] + [rows[0], rows[100]]
    rows += [(2000, [1.0, -2.0], 1), (2001, [1.0, -2.0], 1), (2002, [1.0, -1.9], 2), (2100, [0.0, 0.0], 1), (2101, [0.5, 0.0], 2), (2200, [], 1), (2201, [], 1), (2202, [], 2)]
    rows += [(2300, None, 1), (2301, [1.0, None], 1), (2302, [float("nan"), 1.0], 1), (2303, [float("inf"), 1.0], 1), (2304, [1.0, 1.0], None), (None, [1.0, 1.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS)
    want = brute_mine(rows)
    assert mined(df.repartition(3), block=16) == want and len(want) > 20
    before = hilbert.ANCHORS, hilbert.PAGE, hilbert.PART, hilbert.HELD
    try:
        hilbert.ANCHORS, hilbert.PAGE, hilbert.PART, hilbert.HELD = 3, 5, 100, 20
        assert mined(df, block=16) == want
    finally:
        hilbert.ANCHORS, hilbert.PAGE, hilbert.PART, hilbert.HELD = before
    assert mined(df.limit(0)) == []


def test_zone_maps_leave_blocks_out(spark):
    """Two far groups: a pack's anchors read the blocks of their own group only."""
    rows = [(i, [1.0 + i % 7 / 100, 0.0] if i % 2 else [0.0, 1.0 + i % 7 / 100], i % 3) for i in range(1200)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS)
    table = hilbert.stored(hilbert.blocks(hilbert.taking_part(df), 32))
    zones = table.select("block", "size", "label", "low", "high")
    anchors = hilbert.taking_part(df).where("vec_id = 101")
    from pyspark.sql import functions as F

    packs = hilbert._packs(anchors.withColumns({"pack": F.lit(0), "lows": F.array(F.lit(1000).cast("long")), "highs": F.array(F.lit(1 << 40))}))
    n = zones.count()
    assert 0 < hilbert.chosen(packs, zones, False).count() < 0.5 * n and mined(df, block=32) == brute_mine(rows)


def test_interval_bounds_hold():
    rng = np.random.default_rng(9)
    a, x = rng.integers(-300, 300, (20, 12)), rng.integers(-300, 300, (8, 40, 12))
    low, high = hilbert.bounds(a, x.min(1), x.max(1))
    exact = np.einsum("ad,bnd->abn", a, x)
    assert (low <= exact.min(2)).all() and (high >= exact.max(2)).all()
    big = np.full((1, 2), 1 << 30)
    assert hilbert.product(big, big)[0, 0] == 2 << 60


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    at = hilbert.curve(cells, bits)
    assert sorted(at.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(at)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
