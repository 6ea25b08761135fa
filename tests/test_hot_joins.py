"""Rows of a group beyond the limit are spread over the tasks that join them with the group's statistics."""

import pytest
from pyspark.sql import functions as F

from screenforge.operators import skew as K
from screenforge.operators import spatial as D
from screenforge.operators import stats as R
from screenforge.session import GROUP_LIMIT_KEY

SETTINGS = {GROUP_LIMIT_KEY: "100", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture
def shuffled(spark):
    """Groups of 100 rows are hot, and no table is small enough to be sent to all tasks by itself."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows(spark):
    hot = [(i, "hot", float(i % 37), float(i % 3)) for i in range(2000)]
    few = [(2000 + i, f"g{i % 5}", float(i % 11), 1.0) for i in range(60)]
    none = [(3000 + i, None, float(i), 2.0) for i in range(300)]
    return spark.createDataFrame(hot + few + none, "id long, feature string, value double, y double")


def spread(df, where):
    return df.where(where).select(F.spark_partition_id().alias("p")).distinct().count()


def test_quantiles_move_no_rows_by_hot_group(shuffled):
    plan = K.quantiles(rows(shuffled), ["feature"], "value", [0.25, 0.5], "q", 100)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_statistics_of_hot_groups(shuffled):
    z = R.normalise(rows(shuffled))
    assert spread(z, "feature = 'hot'") > 4 and spread(z, "feature IS NULL") > 4
    got = {r["id"]: r["z"] for r in z.collect()}
    assert len(got) == 2360 and all(got[i] is None for i in range(3000, 3300))
    for name, ids in (("hot", range(2000)), ("g2", range(2002, 2060, 5))):
        v = {r["id"]: r["value"] for r in rows(shuffled).where(F.col("feature") == name).collect()}
        mu = sum(v.values()) / len(v)
        sd = (sum((x - mu) ** 2 for x in v.values()) / (len(v) - 1)) ** 0.5
        assert {i: got[i] for i in ids} == pytest.approx({i: (v[i] - mu) / sd for i in ids})


def test_statistics_of_controls_only(shuffled):
    z = R.normalise(rows(shuffled), F.col("id") < 50)
    got = {r["id"]: r["z"] for r in z.collect()}
    assert got[37] == pytest.approx(got[0]) and got[2000] is None and got[0] is not None


def test_hot_wells(shuffled):
    cells = rows(shuffled).withColumnRenamed("feature", "well")
    radial = D.radial_position(cells, "well", "value", "y", min_cells=12)
    assert spread(radial, "well = 'hot'") > 4
    got = {r["id"]: r["radial"] for r in radial.collect()}
    assert got[0] == pytest.approx((18.0**2 + 1) ** 0.5) and got[2000] is not None and got[3000] is None
    few = D.radial_position(cells, "well", "value", "y", min_cells=13)
    assert {r["radial"] for r in few.where("well = 'g1'").collect()} == {None}
    grid = D.well_grid(cells, "well", "value", "y", "value", 4)
    assert grid.agg(F.sum("n")).first()[0] == 2060
    bins = D.radial_bins(radial, ["well"], "radial", 5)
    assert spread(bins, "well = 'hot'") > 4 and bins.count() == 2060


def _joins(plan):
    below = [plan.children().apply(i) for i in range(plan.children().size())]
    return ([plan] if plan.nodeName() == "Join" else []) + [j for p in below for j in _joins(p)]


def test_effect_sizes_join_no_single_rows(shuffled):
    long = rows(shuffled).withColumn("gene", (F.col("id") % 6).cast("string"))
    sets = shuffled.createDataFrame([("0", 1), ("1", 1), ("2", 2)], "gene string, set_id int")
    out = R.set_effect_sizes(long, sets)
    plan = out._jdf.queryExecution().optimizedPlan()
    assert all("Aggregate" in j.children().apply(0).toString() for j in _joins(plan))
    got = {(r["set_id"], r["feature"]): r for r in out.collect()}
    assert {f for _, f in got} == {"hot", *(f"g{i}" for i in range(5))}
    inside = [float(i % 37) for i in range(2000) if i % 6 < 2]
    rest = [float(i % 37) for i in range(2000) if i % 6 >= 2]
    mean = lambda v: sum(v) / len(v)
    square = lambda v: sum((x - mean(v)) ** 2 for x in v)
    sd = ((square(inside) + square(rest)) / 1998) ** 0.5
    r = got[1, "hot"]
    assert (r["n"], r["n_rest"]) == (len(inside), len(rest))
    assert (r["mean"], r["mean_rest"], r["d"]) == pytest.approx((mean(inside), mean(rest), (mean(inside) - mean(rest)) / sd))


def test_ranks_of_common_values(shuffled):
    df = rows(shuffled).where("feature = 'hot'")
    out = K.average_ranks(df, ["feature"], {"y": "ry", "value": "rv"})
    assert out.columns == [*df.columns, "ry", "rv"]
    assert spread(out, "y = 0") > 4
    want = {0.0: (667 + 1) / 2, 1.0: 667 + (667 + 1) / 2, 2.0: 1334 + (666 + 1) / 2}
    assert {(r["y"], r["ry"]) for r in out.collect()} == set(want.items())
