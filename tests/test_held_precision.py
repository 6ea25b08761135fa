"""Average precision leaves a task as one row per query, never as counts per pair of rows."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from screenforge.operators import retrieval as Q
from tests.test_skew import brute_ap


@pytest.fixture(scope="module")
def genes(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50, 3)).round(1)  # equal similarities are common
    sets = [(i, s) for i in range(50) for s in ("a", "b", "c") if (i * 7 + ord(s)) % 4 < 2] + [(3, "lone")]
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(50)], "id long, features array<double>")
    return x, sets, df, spark.createDataFrame(sets, "gene long, set_id string")


@pytest.mark.parametrize("block", [4, 1000])
def test_no_counts_per_pair_leave_a_task(genes, block, monkeypatch):
    x, sets, df, table = genes
    monkeypatch.setattr(Q, "_positive_steps", lambda *_: pytest.fail("positives of every query were listed"))
    got = {(r["id"], r["label"]): r for r in Q.consistency(df, table, block_rows=block).collect()}
    of = {s: {g for g, t in sets if t == s} for s in "abc"}
    assert set(got) == {(g, s) for s in "abc" for g in of[s]}
    for (g, s), r in got.items():
        pos, neg = sorted(of[s] - {g}), [j for j in range(50) if j not in of[s]]
        assert (r["n_pos"], r["n_neg"]) == (len(pos), len(neg))
        assert math.isclose(r["average_precision"], brute_ap(x, g, pos, neg), abs_tol=1e-9)


def test_both_ways_agree(genes, monkeypatch):
    x, _, df, table = genes
    labelled = df.withColumn("perturbation", F.when(F.col("id") % 11 == 0, None).otherwise((F.col("id") % 4).cast("string")))
    subsets = {"all": None, "two": [0, 2]}

    def scores():
        frames = (Q.consistency(df, table, block_rows=6), Q.activity(labelled, F.col("perturbation") == "0", subsets, 6), Q.distinctiveness(labelled, subsets=subsets, block_rows=6))
        return [sorted((r["variant"], r["id"], r["label"], round(r["average_precision"], 9), r["n_pos"], r["n_neg"]) for r in f.collect()) for f in frames]

    held = scores()
    monkeypatch.setattr(Q, "HELD_BYTES", 0)
    assert held == scores() and all(held)
    nothing = Q.activity(labelled.limit(0), F.col("perturbation") == "0")
    assert nothing.collect() == []


@pytest.mark.parametrize("kept", [0, 1 << 27])
def test_rows_of_an_id_meet_the_references_once(monkeypatch, kept):
    monkeypatch.setattr(Q, "HELD_UNITS", kept)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 4)).round(1).astype(np.float32)
    ids = pa.table({"id": pa.array([i for i in range(40) for _ in "ab"] + [7]), "labels": pa.array([[s] for _ in range(40) for s in "ab"] + [["a"]])})
    vectors = np.concatenate([np.repeat(x, 2, axis=0), -x[7:8]])  # an id may come with two vectors
    member = {"a": set(range(0, 40, 2)) | {7}, "b": set(range(0, 40, 3)) | {7}}
    refs = pa.table({"id": pa.array(range(40)), "labels": pa.array([[s for s in "ab" if i in member[s]] for i in range(40)], pa.list_(pa.string())), "negative": pa.array([True] * 40)})
    met, keys_of = [], Q._keys_of
    monkeypatch.setattr(Q, "_keys_of", lambda q, *rest: (met.append(len(q)), keys_of(q, *rest))[1])
    got = Q._score_group(ids, vectors, refs, x, [None]).to_pylist()
    assert sum(met) <= 42 and len(got) == 81  # the two vectors of one id may alternate
    seen = 0
    for r in got:
        i, s = r["id"], r["label"]
        want = [brute_ap(np.concatenate([x, v[None]]).astype(float), 40, sorted(member[s] - {i}), [j for j in range(40) if j not in member[s]]) for v in ((x[i], -x[i]) if i == 7 else (x[i],))]
        assert any(math.isclose(r["average_precision"], w, abs_tol=1e-9) for w in want)
        seen += r["n_pos"] == len(member[s] - {i}) and r["n_neg"] == 40 - len(member[s])
    assert seen == 81


def test_references_travel_and_are_held_as_single_floats_where_these_say_the_same():
    for values, held in (([0.5, -2.0, 3.0, 0.25], np.float32), ([0.1, 0.2, 0.3, 0.4], np.float64)):
        t = pa.table({"id": [1, 2], "labels": [["a"], []], "negative": [True, False], "features": [values[:2], values[2:]]})
        rows, numbers, width, size = Q._packed(t)
        table, got = Q._unpacked([{"rows": rows, "numbers": numbers, "width": width, "bytes": size}])
        assert got.dtype == held and got.astype(float).ravel().tolist() == values and table.column("labels").to_pylist() == [["a"], []]


def test_null_and_repeated_ids_stay_apart(spark):
    x = np.random.default_rng(6).normal(size=(9, 3))
    df = spark.createDataFrame([(None if i in (2, 5) else i % 7, "g" if i % 2 else "h", x[i].tolist()) for i in range(9)], "id long, perturbation string, features array<double>")
    got = sorted((r["label"], r["n_pos"], r["n_neg"], round(r["average_precision"], 9)) for r in Q.distinctiveness(df).collect())
    ids = [None if i in (2, 5) else i % 7 for i in range(9)]
    want = []
    for i in range(9):
        same = [j for j in range(9) if j % 2 == i % 2]
        pos = [j for j in same if ids[j] is None and j != i and ids[i] is None or ids[j] != ids[i] or (ids[j] is None and j == i)]
        want.append(("g" if i % 2 else "h", len(pos), 9 - len(same)))
    assert [g[:3] for g in got] == sorted(want)
