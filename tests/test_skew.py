"""Hot-group ways against plain ones, and tiles of any size against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenforge.operators import pairs as PR
from screenforge.operators import retrieval as Q
from screenforge.operators import skew as K
from screenforge.operators.graph import connected_components
from screenforge.operators.levels import seven_stats, seven_stats_long
from screenforge.operators.longform import to_long
from screenforge.operators.records import duplicate_keys, require_unique, spatial_batches
from screenforge.session import GROUP_LIMIT_KEY


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [("hot", float(rng.choice([rng.gauss(0, 1), rng.randint(-3, 3)]))) for _ in range(3000)]
    data += [(f"g{i % 20}", float(rng.randint(0, 9))) for i in range(200)] + [("one", 4.0), ("hot", None)]
    return spark.createDataFrame(data, "k string, v double").cache()


def collect(df, *order):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*order).collect())


def test_quantiles_of_a_hot_group_are_exact(rows):
    probs = [0.0, 0.05, 0.25, 0.5, 0.77, 1.0]
    flat = lambda limit: {r["k"]: list(r["q"]) for r in K.quantiles(rows, ["k"], "v", probs, "q", limit).collect()}
    a, b = flat(10**9), flat(50)
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-12)
    hot = np.array([r["v"] for r in rows.where("k = 'hot' and v is not null").collect()])
    assert b["hot"] == pytest.approx(list(np.quantile(hot, probs)), abs=1e-12)


def test_ranks_and_bh_of_a_hot_group(rows):
    for fn in (
        lambda limit: K.value_ranks(rows, ["k"], "v", limit).select("k", "v", "n_below", "n_equal", "n_total"),
        lambda limit: K.average_rank(rows.where("v is not null"), ["k"], "v", "r", limit).select("k", "v", "r"),
    ):
        assert sorted(map(tuple, fn(10**9).collect())) == sorted(map(tuple, fn(50).collect()))
    p = rows.select("k", (F.abs("v") / 10).alias("p"))
    a, b = (collect(K.bh_adjust(p, ["k"], "p", limit=n), "k", F.coalesce("p", F.lit(1.0)).alias("p"), "p_adj") for n in (10**9, 50))
    assert a == b
    assert all(0 <= r[2] <= 1 and r[2] >= r[1] - 1e-12 for r in a)


def test_seven_statistics_with_hot_groups(spark, rows):
    df = rows.withColumn("w", F.col("v") * 2)
    plain = seven_stats(df, ["k"], ["v", "w"])
    order = plain.columns
    want = collect(plain, *order)
    spark.conf.set(GROUP_LIMIT_KEY, "100")
    try:
        assert collect(seven_stats(df, ["k"], ["v", "w"]), *order) == want
        long = seven_stats_long(to_long(df, ["k"], ["v", "w"]), ["k", "feature"])
        assert long.where("k = 'hot' and feature = 'v'").first()["count"] == 3000
    finally:
        spark.conf.unset(GROUP_LIMIT_KEY)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4)).round(3)
    x[10] = x[11]
    lab = ["0" if i % 3 == 0 else str(i % 5) for i in range(60)]  # label 0 holds a third
    return x, lab, spark.createDataFrame([(i, lab[i], x[i].tolist()) for i in range(60)], "id long, perturbation string, features array<double>")


@pytest.mark.parametrize("block", [7, 1000])
def test_nearest_and_group_distances(points, block):
    x, lab, df = points
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    got = PR.nearest(df, df, 3, block_rows=block).collect()
    for r in got:
        order = sorted((d[r["id"], j], j) for j in range(60) if j != r["id"])[:3]
        assert r["ref_id"] == order[r["rank"] - 1][1] and math.isclose(r["distance"], order[r["rank"] - 1][0], abs_tol=1e-9)
    sums = {(r["id"], r["ref_group"]): (r["n"], r["total"]) for r in PR.group_distances(df, df, "perturbation", block).collect()}
    for (i, g), (n, total) in sums.items():
        js = [j for j in range(60) if j != i and lab[j] == g]
        assert n == len(js) and math.isclose(total, d[i, js].sum(), abs_tol=1e-6)


def brute_ap(x, q, pos, neg):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.rint(u @ u[q] * 1e6)
    rank = sorted([(-s[j], 0) for j in neg] + [(-s[j], 1) for j in pos])
    hits, total = 0, 0.0
    for i, (_, is_pos) in enumerate(rank, 1):
        if is_pos:
            hits += 1
            total += hits / i
    return total / len(pos)


@pytest.mark.parametrize("block", [5, 1000])
def test_average_precision_in_tiles(points, block):
    x, lab, df = points
    got = Q.distinctiveness(df, subsets={"all": None, "front": [0, 1]}, block_rows=block).collect()
    assert len(got) == 120
    for r in got:
        q = r["id"]
        pos = [j for j in range(60) if j != q and lab[j] == lab[q]]
        neg = [j for j in range(60) if lab[j] != lab[q]]
        y = x if r["variant"] == "all" else x[:, :2]
        assert (r["n_pos"], r["n_neg"]) == (len(pos), len(neg))
        assert math.isclose(r["average_precision"], brute_ap(y, q, pos, neg), abs_tol=1e-9)
    act = Q.activity(df, F.col("perturbation") == "0", block_rows=block).collect()
    assert {r["label"] for r in act} == {"1", "2", "3", "4"}


def test_hand_ranked_list(spark):
    # similarity order + - + -: (1/1 + 2/3) / 2 = 5/6
    angle = lambda deg: [math.cos(math.radians(deg)), math.sin(math.radians(deg))]
    df = spark.createDataFrame([(0, "a", angle(0)), (1, "a", angle(10)), (2, "0", angle(20)), (3, "a", angle(30)), (4, "0", angle(40))], "id long, perturbation string, features array<double>")
    ap = {r["id"]: r["average_precision"] for r in Q.activity(df, F.col("perturbation") == "0").collect()}
    assert math.isclose(ap[0], 5 / 6, abs_tol=1e-12)


def test_null_and_significance(points):
    _, _, df = points
    s = Q.significance(Q.activity(df, F.col("perturbation") == "0"), 500).collect()
    assert all(1 / 501 <= r["p_value"] <= 1 and r["corrected_p_value"] >= r["p_value"] - 1e-12 for r in s)
    for p, t in ((1, 4), (2, 50), (30, 40)):
        a = Q.null_average_precision(p, t, 4000, np.random.default_rng(1))
        assert len(a) == 4000 and ((0 < a) & (a <= 1)).all()
    one = Q.null_average_precision(1, 4, 20000, np.random.default_rng(2)).mean()
    assert math.isclose(one, (1 + 1 / 2 + 1 / 3 + 1 / 4) / 4, abs_tol=0.01)


def test_components(spark):
    path = [(i, i + 1) for i in range(30)]
    star = [(100, 100 + i) for i in range(1, 40)]
    e = spark.createDataFrame(path + star + [(500, 500)], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[100 + i] for i in range(40)} == {100} and got[500] == 500


def test_density_clusters(spark):
    from screenforge.operators.cluster import density_clusters

    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 0.05, (40, 2)), rng.normal(3, 0.05, (30, 2)), [[10, 10]]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    for block in (9, 1000):
        got = {r["id"]: r["cluster"] for r in density_clusters(df, 0.5, 5, 25, block).collect()}
        assert {got[i] for i in range(40)} == {0} and {got[i] for i in range(40, 70)} == {40} and got[70] is None


def test_duplicate_guard_and_batches(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "well string, seg int")
    assert duplicate_keys(df, ["well", "seg"]).count() == 1
    with pytest.raises(ValueError):
        require_unique(df, ["well", "seg"])
    cells = spark.createDataFrame([(i, "w/1", float(i * 37 % 1500), float(i * 91 % 1300)) for i in range(300)], "id int, well string, x double, y double")
    b = spatial_batches(cells, "well", "x", "y", "id", 50)
    assert sorted(r["position"] for r in b.collect()) == list(range(300)) and b.select("batch_id").distinct().count() == 6
