"""Null keys and values on both ways of the order statistics; series, chains and tables of any size."""

import pytest
from pyspark.sql import functions as F

from screenforge.operators import cluster, graph, pairs, pixels, retrieval, spatial
from screenforge.operators import skew as K
from screenforge.operators.levels import seven_stats
from screenforge.session import GROUP_LIMIT_KEY
from screenforge.sources import io


def rows(df, *cols):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect()), key=key)


@pytest.fixture(scope="module")
def holes(spark):
    data = [(k, float(i % 5) if i % 4 else None) for k in ("a", None, "b") for i in range(17)]
    return spark.createDataFrame(data, "k string, v double")


@pytest.mark.parametrize("fn", [
    lambda d, n: (K.average_rank(d, ["k"], "v", "r", n), "k", "v", "r"),
    lambda d, n: (K.bh_adjust(d.select("k", (F.col("v") / 10).alias("p")), ["k"], "p", limit=n), "k", "p", "p_adj"),
    lambda d, n: (K.value_ranks(d, ["k"], "v", n), "k", "v", "n_below", "n_equal", "n_total"),
    lambda d, n: (K.quantiles(d, ["k"], "v", [0.0, 0.3, 1.0], "q", n), "k", F.col("q")[1].alias("m")),
])
def test_both_ways_agree_with_nulls(holes, fn):
    plain, hot = (rows(*fn(holes, n)) for n in (10**9, 5))
    assert plain == hot
    assert any(r[0] is None for r in plain)


def test_nulls_have_no_rank(holes):
    got = rows(K.average_rank(holes.where("k = 'a'"), ["k"], "v", "r"), "v", "r")
    assert all(r is None for v, r in got if v is None) and min(r for v, r in got if v is not None) < 3


def test_seven_stats_keep_the_null_group(spark, holes):
    wide = holes.select("k", *[(F.col("v") + i).alias(f"f{i}") for i in range(65)])
    few = [f"f{i}" for i in range(64)]
    a, b = seven_stats(wide, ["k"], few, extra=[F.count(F.lit(1)).alias("n")]), seven_stats(wide, ["k"], [*few, "f64"], extra=[F.count(F.lit(1)).alias("n")])
    assert rows(a, "k", "n", "f3_median", "f3_mean") == rows(b, "k", "n", "f3_median", "f3_mean") and a.count() == 3
    spark.conf.set(GROUP_LIMIT_KEY, "5")
    try:
        assert rows(seven_stats(wide, ["k"], ["f0"]), "k", "f0_median") == rows(a, "k", "f0_median")
    finally:
        spark.conf.unset(GROUP_LIMIT_KEY)


def test_breaks_of_long_and_short_series(spark):
    bent = [("long", float(i), 0.0 if i < 500 else float(i - 500)) for i in range(1001)]
    short = [("four", float(i), 1.0) for i in range(4)] + [(None, float(i), 1.0) for i in range(3)] + [("two", 1.0, 1.0), ("two", 2.0, 5.0)]
    s = spark.createDataFrame(bent + short, "w string, x double, y double")
    two = {r["w"]: r["break_x"] for r in spatial.two_segment_break(s, ["w"], "x", "y").collect()}
    assert abs(two["long"] - 500) <= 1 and (two["four"], two[None], two["two"]) == (1.5, 1.0, 1.5)
    three = {r["w"]: r["break_x"] for r in spatial.three_segment_break(s.where("w <> 'long' OR w IS NULL"), ["w"], "x", "y").collect()}
    assert (three["four"], three[None], three["two"]) == (1.5, 1.0, 1.5)
    second = {r["w"]: r["break_x"] for r in spatial.second_derivative_break(s, ["w"], "x", "y", frac=0.1).collect()}
    assert abs(second["long"] - 500) < 60 and second["two"] == 1.5


def test_deep_and_cyclic_hierarchies(spark):
    parents = spark.createDataFrame([(i, i - 1) for i in range(1, 61)] + [(100, 101), (101, 100)], "cluster int, parent int")
    members = spark.createDataFrame([(i, f"g{i}") for i in range(61)] + [(100, "x"), (101, "y")], "cluster int, gene string")
    got = graph.recursive_members(parents, members)
    assert got.where("cluster = 0").count() == 61
    assert rows(got.where("cluster >= 100"), "cluster", "gene") == [(100, "x"), (100, "y"), (101, "x"), (101, "y")]


def test_communities_settle(spark):
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6)]], "src int, dst int, weight double")
    got = {r["id"]: r["community"] for r in cluster.communities(edges).collect()}
    assert len({got[1], got[2], got[3]}) == 1 and len({got[4], got[5], got[6]}) == 1 and got[1] != got[4]


def test_equal_objects_stay_two(spark):
    objects = spark.createDataFrame([("i", 1.0, 1.0), ("i", 1.0, 1.0), ("i", 2.0, 2.0)], "image string, y double, x double")
    points = spark.createDataFrame([("i", 1, 3)], "image string, y int, x int")
    assert rows(pixels.nearest_distance(objects, points, "image", "y", "x", "d"), "d") == [(round(2**0.5, 9),), (2.0,), (2.0,)]


def test_null_group_is_not_the_text_none(spark):
    df = spark.createDataFrame([(1, [0.0], None), (2, [1.0], None), (3, [2.0], "None")], "id int, features array<double>, g string")
    got = rows(pairs.group_distances(df, df, "g"), "id", "ref_group", "n", "total")
    assert (1, None, 1, 1.0) in got and (1, "None", 1, 2.0) in got


def test_unreadable_files_are_reported(spark, tmp_path):
    good = f"{tmp_path}/batches"
    spark.range(4).write.parquet(good)
    (tmp_path / "batches" / "broken.parquet").write_bytes(b"PAR1 cut off")
    with pytest.raises(Exception):  # noqa: B017 - Spark's own read error
        io.read_batches(spark, good).collect()
    assert io.read_batches(spark, good, skip_unreadable=True).count() == 4
    assert [r["path"].rpartition("/")[2] for r in io.unreadable_files(spark, good).collect()] == ["broken.parquet"]


def test_auc_weighs_by_corrected_p(spark):
    s = spark.createDataFrame([("v", 1.0, 1.0, 1e-3), ("v", 0.5, 1e-9, 1.0)], "variant string, mean_average_precision double, p_value double, corrected_p_value double")
    assert retrieval.auc_score(s).first()["auc"] == pytest.approx(0.25)
