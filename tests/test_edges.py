"""Small fixtures for edge rules, special functions, sources and resumable runs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenforge.functions import scalars as X
from screenforge.functions.special import hypergeom_tail_values, incomplete_beta, t_two_sided
from screenforge.operators import pixels as P
from screenforge.operators import spatial as D
from screenforge.operators import stats as R
from screenforge.sources import io as IO


def test_t_p_values(spark):
    rows = [(2.0, 10.0), (0.0, 5.0), (12.706204736, 1.0), (2.570581836, 5.0), (1.959963985, 1e12), (None, 3.0), (60.0, 200.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "t double, d double").select(t_two_sided("t", "d")).collect()]
    assert got[:5] == pytest.approx([0.07338803477, 1.0, 0.05, 0.05, 0.05], rel=1e-6)
    assert got[5] is None and 0 < got[6] < 1e-100
    assert incomplete_beta([2.0], [3.0], [0.4])[0] == pytest.approx(0.5248, rel=1e-10)


def test_hypergeometric_tail():
    def exact(k, M, n, N):
        c = math.comb
        return sum(c(n, i) * c(M - n, N - i) for i in range(k, min(n, N) + 1)) / c(M, N)

    cases = [(3, 20, 7, 12), (0, 20, 7, 12), (8, 20, 7, 12), (5, 1000, 40, 60), (20, 500, 250, 40), (1, 10, 10, 3)]
    got = hypergeom_tail_values(*[np.array(v) for v in zip(*cases)])
    assert list(got) == pytest.approx([exact(*c) for c in cases], rel=1e-9, abs=1e-15)


def test_harmonic(spark):
    h = {r["x"]: r["h"] for r in spark.range(0, 200).select(F.col("id").alias("x"), X.harmonic(F.col("id")).alias("h")).collect()}
    for x in (0, 1, 2, 17, 199):
        assert h[x] == pytest.approx(sum(1 / i for i in range(1, x + 1)), abs=1e-12)


def test_feature_names_and_boxes(spark):
    names = ["cp1_mito_tomm20_area_mean", "network_er_branch_length_std", "nuclei_count", "cell_area", "zzz_area_max", "nuclei_intensity_max_mean"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    got = {r["f"]: tuple(r["p"]) for r in df.select("f", X.parse_feature(F.col("f"), ["cp1_mito", "cp1_mito_tomm20", "er", "nuclei"]).alias("p")).collect()}
    assert got["cp1_mito_tomm20_area_mean"] == ("cp1_mito_tomm20", "area", "morphology", "mean")
    assert got["network_er_branch_length_std"] == ("er", "branch_length", "network", "std")
    assert got["nuclei_count"] == ("nuclei", "count", "morphology", None)
    assert got["cell_area"] == ("cell", "area", "cell_morphology", None)
    assert got["zzz_area_max"][0] is None and got["zzz_area_max"][2] == "unknown"
    assert got["nuclei_intensity_max_mean"] == ("nuclei", "intensity_max", "intensity", "mean")
    boxes = spark.createDataFrame([("[1 2 3 4]",), ("(1, 2, 3, 4)",), ("nan",), (None,)], "b string").select(X.parse_bbox(F.col("b")))
    assert [r[0] for r in boxes.collect()] == [[1, 2, 3, 4], [1, 2, 3, 4], None, None]


def test_ratios_and_missing_values(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 2.0), (4.0, 2.0), (float("nan"), 1.0), (float("inf"), 1.0)], "a double, b double")
    out = df.select(X.finite(F.col("a")), X.log2_ratio_floor(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in out][3:] == [None, None] and out[1][1] is None and out[2][1] == pytest.approx(1.0)


def test_control_edges(spark):
    rows = [("0", "f", 1.0), ("0", "f", 1.0), ("a", "f", 3.0), ("0", "h", 1.0), ("0", "h", 2.0), ("a", "h", 5.0), ("a", "n", None)]
    long = spark.createDataFrame(rows, "gene string, feature string, value double")
    d = R.differential_features(long, F.col("gene") == "0").collect()
    assert [r["feature"] for r in d] == ["h"]  # constant and empty controls leave
    v = R.gene_feature_volcano(long, F.col("gene") == "0", min_rows=1).collect()
    assert len(v) == 1 and 0 < v[0]["p"] < 1e-6  # one row: z-test
    none = R.differential_features(long.where("gene = 'a'"), F.col("gene") == "0").collect()
    assert none == []


def test_ring_and_diagonal(spark):
    ring = [("r", 1, y, x) for y in range(3) for x in range(3) if (y, x) != (1, 1)]
    df = spark.createDataFrame(ring + [("d", 1, 0, 0), ("d", 1, 1, 1)], "image string, label int, y int, x int")
    assert {r["image"]: r["euler_number"] for r in P.euler_number(df).collect()} == {"r": 0, "d": 1}
    assert P.boundary_pixels(df, ["image"]).count() == 10


def test_breaks_of_piecewise_lines(spark):
    two = [("two", float(i), float(i) if i < 12 else 12.0 + 5.0 * (i - 12)) for i in range(25)]
    three = [("three", float(i), 1.0 if i < 8 else (i - 7.0) * 3 if i < 17 else 100.0 + i) for i in range(25)]
    df = spark.createDataFrame(two + three, "k string, x double, y double")
    a = {r["k"]: r["break_x"] for r in D.two_segment_break(df, ["k"], "x", "y").collect()}
    assert a["two"] in (11.0, 12.0, 13.0)
    b = {r["k"]: r["break_x"] for r in D.three_segment_break(df, ["k"], "x", "y").collect()}
    assert b["three"] == 17.0
    bend = {r["k"]: r["break_x"] for r in D.second_derivative_break(df, ["k"], "x", "y").collect()}
    assert 6.0 <= bend["two"] <= 18.0
    bins = D.radial_bins(spark.createDataFrame([("w", v) for v in (0.0, 1.0, 2.0, 10.0)], "w string, r double"), ["w"], "r", 10)
    assert [r["bin"] for r in bins.orderBy("r").collect()] == [0, 0, 1, 9]


def test_sources(spark, tmp_path):
    for well in ("A_1", "B_2"):
        spark.createDataFrame([(1, 2.5), (2, 3.5)], "segmentation_id int, x double").toPandas().to_csv(tmp_path / f"{well}.csv", index=False)
    wells = IO.read_wells(spark, str(tmp_path / "*.csv"), "segmentation_id int, x double", "k1")
    assert sorted({(r["well"], r["store_key"]) for r in wells.collect()}) == [("A/1", "k1"), ("B/2", "k1")]
    assert IO.prefer_linked(wells.limit(0), wells).count() == 4
    wells.where("well = 'A/1'").write.parquet(str(tmp_path / "obj_chunks/mito/chunk_0.parquet"))
    chunks = IO.read_chunks(spark, str(tmp_path / "obj_chunks/*/*.parquet"))
    assert chunks.count() == 2
    cells = spark.createDataFrame([("c1", "a", 1.0, float("inf"), 0.5), ("c2", "b", 2.0, 3.0, 0.7)], "cell_id string, gene string, nuclei_area_mean double, cell_area double, _t double")
    IO.write_levels({"cell": cells.drop("_t")}, str(tmp_path / "levels"), {"cell": ["cell_id", "gene"]}, ["nuclei"])
    x = spark.read.parquet(str(tmp_path / "levels/cell/x"))
    back = IO.load_profiles(x, spark.read.parquet(str(tmp_path / "levels/cell/obs")), "cell_id")
    assert dict(back.dtypes)["cell_area"] == "float" and back.where("cell_area is null").count() == 1
    meta = {r["feature"]: r["unit"] for r in spark.read.parquet(str(tmp_path / "levels/feature_meta")).collect()}
    assert meta == {"nuclei_area_mean": "um^2", "cell_area": "um^2"}
    IO.write_intermediate(cells, str(tmp_path / "mid"), ["cell_id"], str(tmp_path / "time"))
    assert "_t" not in spark.read.parquet(str(tmp_path / "mid")).columns and "_t" in spark.read.parquet(str(tmp_path / "time")).columns
    IO.write_results(cells.drop("_t"), str(tmp_path / "csv"))
    assert IO.list_files(spark, str(tmp_path / "csv"), "*.csv").count() >= 1


def test_resume_reads_only_new_files(spark, tmp_path):
    from screenforge.streaming.resume import process_new_batches

    src, dst, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "cell_id int, area double"
    run = lambda: process_new_batches(spark, src, dst, ck, schema, lambda d: d.withColumn("big", F.col("area") > 1))
    spark.createDataFrame([(1, 0.5)], schema).write.mode("append").parquet(src)
    run()
    spark.createDataFrame([(2, 2.5)], schema).write.mode("append").parquet(src)
    run()
    run()
    assert sorted((r["cell_id"], r["big"]) for r in spark.read.parquet(dst).collect()) == [(1, False), (2, True)]


def test_single_control_row_gives_effects_without_p(spark):
    rows = [("0", "f", 2.0), ("a", "f", 5.0), ("a", "f", 7.0), ("0", "g", 1.0), ("0", "g", 3.0), ("a", "g", 4.0), ("0", "h", 1.0), ("a", "i", 1.0), ("0", "j", 1.0), ("0", "j", 1.0), ("a", "j", 2.0)]
    long = spark.createDataFrame(rows, "gene string, feature string, value double")
    got = {r["feature"]: r for r in R.differential_features(long, F.col("gene") == "0").collect()}
    assert set(got) == {"f", "g"}
    assert (got["f"]["control_std"], got["f"]["z"], got["f"]["t"], got["f"]["p"], got["f"]["p_adj"]) == (1.0, 4.0, None, None, 1.0)
    assert got["g"]["p"] is None and got["g"]["z"] == pytest.approx(2.0 / 2**0.5)
