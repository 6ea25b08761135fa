"""Spatial drift, pixel regions and graphs, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenforge.operators import graph as G
from screenforge.operators import joins as J
from screenforge.operators import pixels as P
from screenforge.operators import spatial as D
from screenforge.operators.longform import to_long
from screenforge.plans import tables as T
from screenforge.plans.registry import query

RADIAL = f"""{T.SPATIAL}, c AS (SELECT well, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy FROM spatial GROUP BY 1),
radial AS (SELECT s.*, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS radial FROM spatial s JOIN c USING (well))"""
DRIFT = """st AS (SELECT avg(f_value) AS m1, stddev_pop(f_value) AS s1, avg(f_k) AS m2, stddev_pop(f_k) AS s2 FROM spatial),
drift AS (SELECT cell_id, (abs((f_value - m1) / s1) + abs((f_k - m2) / s2)) / 2 AS drift FROM spatial, st), rd AS (SELECT r.*, drift FROM radial r JOIN drift USING (cell_id))"""


def radial(spark, sf, group="well"):
    return D.radial_position(T.spatial(spark, sf), group, "x", "y", min_cells=10)


def drift_rows(spark, sf):
    s = radial(spark, sf)
    d = D.drift_score(to_long(s, ["cell_id"], ["f_value", "f_k"]), ["cell_id"])
    return s.join(d, "cell_id")


@query("d1_radial_position", f"WITH {RADIAL} SELECT cell_id, well, radial FROM radial", doubles="radial")
def d1(spark, sf):
    return radial(spark, sf).select("cell_id", "well", "radial")


@query("d1_radial_position_tile", f"""WITH {RADIAL.replace("SELECT well, (min", "SELECT tile, (min").replace("USING (well)", "USING (tile)")}, n AS (SELECT tile FROM spatial GROUP BY 1 HAVING count(*) >= 10)
SELECT cell_id, tile, CASE WHEN tile IN (SELECT tile FROM n) THEN radial END AS radial FROM radial""", doubles="radial")
def d1t(spark, sf):
    return radial(spark, sf, "tile").select("cell_id", "tile", "radial")


@query("d2_drift_score", f"WITH {RADIAL}, {DRIFT} SELECT cell_id, drift FROM drift", doubles="drift")
def d2(spark, sf):
    return drift_rows(spark, sf).select("cell_id", "drift")


BINNED = """e AS (SELECT well, min(radial) AS lo, max(radial) AS hi FROM rd GROUP BY 1), b AS (SELECT well, CAST(least({n} - 1, greatest(ceil((radial - lo) / ((hi - lo) / {n})) - 1, 0)) AS INTEGER) AS bin, drift, lo, hi FROM rd JOIN e USING (well)),
g AS (SELECT well, bin, avg(drift) AS mean_drift, count(drift) AS n, any_value(lo) AS lo, any_value(hi) AS hi FROM b GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN bin = 0 THEN lo - (hi - lo) * 0.001 ELSE lo + bin * (hi - lo) / {n} END AS l, lo + (bin + 1) * (hi - lo) / {n} AS r FROM g),
prof AS (SELECT well, bin, mean_drift, n, n / (pi() * (r * r - l * l)) AS density, (l + r) / 2 AS mid, mean_drift / first_value(mean_drift) OVER (PARTITION BY well ORDER BY bin) AS normalised FROM w)"""


@query("d3_radial_bins", f"WITH {RADIAL}, {DRIFT}, {BINNED.format(n=30)} SELECT well, bin, n FROM g")
def d3(spark, sf):
    return D.radial_bins(radial(spark, sf), ["well"], "radial", 30).groupBy("well", "bin").agg(F.count(F.lit(1)).alias("n"))


@query("d4_bin_profile", f"WITH {RADIAL}, {DRIFT}, {BINNED.format(n=50)} SELECT * FROM prof", doubles="mean_drift density mid normalised")
def d4(spark, sf):
    return D.bin_profile(drift_rows(spark, sf), ["well"], "radial", "drift", 50)


@query("w10_centre_normalised_bins", f"WITH {RADIAL}, {DRIFT}, {BINNED.format(n=10)} SELECT well, bin, normalised FROM prof", doubles="normalised")
def w10(spark, sf):
    return D.bin_profile(drift_rows(spark, sf), ["well"], "radial", "drift", 10).select("well", "bin", "normalised")


SERIES = f"""{RADIAL}, {DRIFT}, {BINNED.format(n=50)}, pts AS (SELECT well, mid AS x, normalised AS y, row_number() OVER (PARTITION BY well ORDER BY mid) AS k, count(*) OVER (PARTITION BY well) AS m FROM prof)"""


def _sse(lo, hi):
    f = f"FILTER (k > {lo} AND k <= {hi})"
    return f"(regr_syy(y, x) {f} - regr_sxy(y, x) {f} * regr_sxy(y, x) {f} / regr_sxx(y, x) {f})"


def series(spark, sf):
    p = D.bin_profile(drift_rows(spark, sf), ["well"], "radial", "drift", 50)
    return p.select("well", F.col("mid").alias("x"), F.col("normalised").alias("y"))


@query("d5_two_segment_break", f"""WITH {SERIES}, cb AS (SELECT DISTINCT well, k - 1 AS i, m FROM pts WHERE k - 1 >= 2 AND k - 1 <= m - 3),
s AS (SELECT cb.well, cb.i, {_sse("0", "cb.i")} + {_sse("cb.i", "cb.m")} AS sse FROM cb JOIN pts USING (well) GROUP BY cb.well, cb.i)
SELECT s.well, p.x AS break_x, sse FROM s JOIN pts p ON p.well = s.well AND p.k = s.i + 1 QUALIFY row_number() OVER (PARTITION BY s.well ORDER BY sse, i) = 1""", doubles="break_x sse")
def d5(spark, sf):
    return D.two_segment_break(series(spark, sf), ["well"], "x", "y")


@query("d5_three_segment_break", f"""WITH {SERIES}, cb AS (SELECT a.well, a.k - 1 AS i, b.k - 1 AS j, a.m FROM pts a JOIN pts b ON a.well = b.well AND b.k >= a.k + 2 WHERE a.k - 1 >= 2 AND a.k - 1 <= a.m - 5 AND b.k - 1 <= a.m - 3),
s AS (SELECT cb.well, cb.i, cb.j, any_value(cb.m) AS m, {_sse("0", "cb.i")} + {_sse("cb.i", "cb.j")} + {_sse("cb.j", "cb.m")} AS sse FROM cb JOIN pts USING (well) GROUP BY cb.well, cb.i, cb.j),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY well ORDER BY sse, i, j) = 1), ends AS (SELECT well, (min(x) + max(x)) / 2 AS mid FROM pts GROUP BY 1)
SELECT best.well, CASE WHEN pi.x < mid THEN pj.x ELSE pi.x END AS break_x, sse FROM best JOIN ends USING (well) JOIN pts pi ON pi.well = best.well AND pi.k = best.i + 1 JOIN pts pj ON pj.well = best.well AND pj.k = best.j + 1""", doubles="break_x sse")
def d5t(spark, sf):
    return D.three_segment_break(series(spark, sf), ["well"], "x", "y")


@query("d6_second_derivative_break")
def d6(spark, sf):
    return D.second_derivative_break(series(spark, sf), ["well"], "x", "y")


@query("d7_share_beyond_break", f"""WITH {SERIES}, cb AS (SELECT DISTINCT well, k - 1 AS i, m FROM pts WHERE k - 1 >= 2 AND k - 1 <= m - 3),
s AS (SELECT cb.well, cb.i, {_sse("0", "cb.i")} + {_sse("cb.i", "cb.m")} AS sse FROM cb JOIN pts USING (well) GROUP BY cb.well, cb.i),
br AS (SELECT s.well, p.x AS break_x FROM s JOIN pts p ON p.well = s.well AND p.k = s.i + 1 QUALIFY row_number() OVER (PARTITION BY s.well ORDER BY sse, i) = 1)
SELECT well, count(*) AS n_cells, count(*) FILTER (radial > break_x) AS n_beyond, avg(CASE WHEN radial > break_x THEN 1.0 ELSE 0 END) * 100 AS pct_beyond FROM rd JOIN br USING (well) GROUP BY 1""", doubles="pct_beyond")
def d7(spark, sf):
    return D.share_beyond(radial(spark, sf), D.two_segment_break(series(spark, sf), ["well"], "x", "y"), ["well"], "radial")


@query("d8_well_grid", f"""WITH {RADIAL}, {DRIFT}, e AS (SELECT well, floor(max(x)) + 1 AS w, floor(max(y)) + 1 AS h FROM rd GROUP BY 1),
g AS (SELECT well, CAST(floor(y / (h / 30)) AS BIGINT) AS row, CAST(floor(x / (w / 30)) AS BIGINT) AS col, avg(drift) AS mean, count(*) AS n FROM rd JOIN e USING (well) GROUP BY 1, 2, 3)
SELECT *, mean / (SELECT coalesce(avg(mean), 1) FROM g WHERE row = 15 AND col = 15) AS normalised FROM g""", doubles="mean normalised")
def d8(spark, sf):
    return D.well_grid(drift_rows(spark, sf), "well", "x", "y", "drift")


@query("d9_average_tile", f"""WITH {RADIAL}, {DRIFT}, g AS (SELECT CAST(floor(y / 60) AS BIGINT) AS y_bin, CAST(floor(x / 60) AS BIGINT) AS x_bin, avg(drift) AS mean, count(*) AS n FROM rd GROUP BY 1, 2),
xs AS (SELECT x_bin, row_number() OVER (ORDER BY x_bin) - 1 AS k FROM (SELECT DISTINCT x_bin FROM g)), ys AS (SELECT y_bin, row_number() OVER (ORDER BY y_bin) - 1 AS k FROM (SELECT DISTINCT y_bin FROM g)),
m AS (SELECT mean AS c FROM g WHERE x_bin = (SELECT x_bin FROM xs WHERE k = (SELECT count(*) FROM xs) // 2) AND y_bin = (SELECT y_bin FROM ys WHERE k = (SELECT count(*) FROM ys) // 2))
SELECT *, CASE WHEN (SELECT c FROM m) > 1e-9 THEN mean / (SELECT c FROM m) ELSE mean END AS normalised FROM g""", doubles="mean normalised")
def d9(spark, sf):
    return D.average_tile(drift_rows(spark, sf), "x", "y", "drift", 60)


@query("d10_drift_summary", f"WITH {RADIAL}, {DRIFT} SELECT well, avg(drift) AS mean_drift, stddev_samp(drift) AS std_drift, count(drift) AS n FROM rd GROUP BY 1", doubles="mean_drift std_drift")
def d10(spark, sf):
    return D.drift_summary(drift_rows(spark, sf), "well")


@query("d11_drift_per_organelle", f"""WITH {T.OBJECT_LONG}, st AS (SELECT organelle, feature, avg(value) AS mu, stddev_pop(value) AS sd FROM object_long GROUP BY 1, 2),
z AS (SELECT cell_id, well, organelle, avg(abs((value - mu) / sd)) AS drift FROM object_long JOIN st USING (organelle, feature) GROUP BY 1, 2, 3)
SELECT organelle, well, avg(drift) AS mean_drift, stddev_samp(drift) AS std_drift, count(*) AS n FROM z GROUP BY 1, 2""", doubles="mean_drift std_drift")
def d11(spark, sf):
    d = D.drift_score(T.object_long(spark, sf), ["cell_id", "well"], ["organelle"])
    return d.groupBy("organelle", "well").agg(F.avg("drift").alias("mean_drift"), F.stddev_samp("drift").alias("std_drift"), F.count(F.lit(1)).alias("n"))


# --- pixels -----------------------------------------------------------------------------------
MASK = f"{T.PIXELS}, mask AS (SELECT image, 1 AS label, y, x, intensity FROM pixels WHERE intensity > 0)"


def mask(spark, sf):
    return T.pixels(spark, sf).where("intensity > 0").withColumn("label", F.lit(1))


@query("i1_region_measurements", f"""WITH {MASK} SELECT image, label, count(*) AS n_pixels, avg(y) * 0.5 AS centroid_y, avg(x) * 0.25 AS centroid_x, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1, count(*) * 0.125 AS area,
 count(*) / ((max(y) + 1 - min(y)) * (max(x) + 1 - min(x))) AS extent, sqrt(4 * count(*) * 0.125 / pi()) AS equivalent_diameter_area FROM mask GROUP BY 1, 2""", doubles="centroid_y centroid_x area extent equivalent_diameter_area")
def i1(spark, sf):
    return P.region_measurements(mask(spark, sf), spacing=(0.5, 0.25))


MOM = "mo AS (SELECT image, label, count(*) AS n_pixels, var_pop(y) AS vy, var_pop(x) AS vx, covar_pop(y, x) AS c FROM mask GROUP BY 1, 2), ei AS (SELECT *, (vy + vx) / 2 + sqrt(pow((vy - vx) / 2, 2) + c * c) AS e0, greatest((vy + vx) / 2 - sqrt(pow((vy - vx) / 2, 2) + c * c), 0) AS e1 FROM mo)"


@query("i2_shape_moments", f"""WITH {MASK}, {MOM} SELECT image, label, n_pixels, e0 AS inertia_eigval_0, e1 AS inertia_eigval_1, 4 * sqrt(e0) AS axis_major_length, 4 * sqrt(e1) AS axis_minor_length,
 sqrt(1 - e1 / e0) AS eccentricity FROM ei""", doubles="inertia_eigval_0 inertia_eigval_1 axis_major_length axis_minor_length eccentricity")
def i2(spark, sf):
    return P.shape_moments(mask(spark, sf)).drop("orientation")


def _hu_sql(w):
    names = {"20": "dy*dy", "11": "dy*dx", "02": "dx*dx", "30": "dy*dy*dy", "21": "dy*dy*dx", "12": "dy*dx*dx", "03": "dx*dx*dx"}
    eta = ", ".join(f"sum({w}*{e}) / pow(sum({w}), {2.0 if len(k) == 2 and int(k[0]) + int(k[1]) == 2 else 2.5}) AS n{k}" for k, e in names.items())
    return f"""c AS (SELECT image, label, sum({w} * y) / sum({w}) AS cy, sum({w} * x) / sum({w}) AS cx FROM mask GROUP BY 1, 2), d AS (SELECT m.*, y - cy AS dy, x - cx AS dx FROM mask m JOIN c USING (image, label)),
e AS (SELECT image, label, {eta} FROM d GROUP BY 1, 2), t AS (SELECT *, n30 + n12 AS p, n21 + n03 AS q, n30 - 3 * n12 AS u, 3 * n21 - n03 AS v, n20 - n02 AS g FROM e)
SELECT image, label, n20 + n02 AS hu_0, g * g + 4 * n11 * n11 AS hu_1, u * u + v * v AS hu_2, p * p + q * q AS hu_3, u * p * (p * p - 3 * q * q) + v * q * (3 * p * p - q * q) AS hu_4,
 g * (p * p - q * q) + 4 * n11 * p * q AS hu_5, v * p * (p * p - 3 * q * q) - u * q * (3 * p * p - q * q) AS hu_6 FROM t"""


_HU = " ".join(f"hu_{i}" for i in range(7))


@query("i3_hu_moments", f"WITH {MASK}, {_hu_sql('1.0::DOUBLE')}", doubles=_HU, digits=10)
def i3(spark, sf):
    return P.hu_moments(mask(spark, sf))


@query("i3_hu_moments_weighted", f"WITH {MASK}, {_hu_sql('intensity')}", doubles=_HU)
def i3w(spark, sf):
    return P.hu_moments(mask(spark, sf), weight="intensity")


_INT = "intensity_mean intensity_max intensity_min intensity_std intensity_integrated centroid_weighted_y centroid_weighted_x intensity_q25 intensity_median intensity_q75 intensity_mad intensity_iqr intensity_range intensity_cv"


@query("i4_intensity_statistics", f"""WITH {MASK}, s AS (SELECT image, label, avg(intensity) AS intensity_mean, max(intensity) AS intensity_max, min(intensity) AS intensity_min, stddev_pop(intensity) AS intensity_std, sum(intensity) AS intensity_integrated,
 sum(intensity * y) / sum(intensity) AS centroid_weighted_y, sum(intensity * x) / sum(intensity) AS centroid_weighted_x, quantile_cont(intensity, 0.25) AS intensity_q25, median(intensity) AS intensity_median, quantile_cont(intensity, 0.75) AS intensity_q75, mad(intensity) AS intensity_mad FROM mask GROUP BY 1, 2)
SELECT *, intensity_q75 - intensity_q25 AS intensity_iqr, intensity_max - intensity_min AS intensity_range, intensity_std / intensity_mean AS intensity_cv FROM s""", doubles=_INT)
def i4(spark, sf):
    return P.intensity_statistics(mask(spark, sf))


@query("i5_i6_cell_measurements", f"""WITH {MASK}, {MOM}, r AS (SELECT image, avg(y) AS cy, avg(x) AS cx, CAST(count(*) AS DOUBLE) AS area, count(*) / ((max(y) + 1 - min(y)) * (max(x) + 1 - min(x))) AS extent FROM mask GROUP BY 1),
q AS (SELECT r.*, e0, e1, 4 * sqrt(e0) AS a, CASE WHEN e1 = 0 THEN 0 ELSE 4 * sqrt(e1) END AS b FROM r JOIN ei USING (image)), z AS (SELECT *, pi() * (3 * (a / 2 + CASE WHEN b = 0 THEN 0.1 ELSE b END / 2) - sqrt((3 * a / 2 + CASE WHEN b = 0 THEN 0.1 ELSE b END / 2) * (a / 2 + 3 * CASE WHEN b = 0 THEN 0.1 ELSE b END / 2))) AS per FROM q)
SELECT image, cy AS cell_centroid_y, cx AS cell_centroid_x, area AS cell_area, extent AS cell_extent, a AS cell_axis_major_length, b AS cell_axis_minor_length, a / CASE WHEN b = 0 THEN 1 ELSE b END AS cell_aspect_ratio, per AS cell_perimeter_approx, 4 * pi() * area / (per * per) AS cell_circularity_approx FROM z""",
    doubles="cell_centroid_y cell_centroid_x cell_area cell_extent cell_axis_major_length cell_axis_minor_length cell_aspect_ratio cell_perimeter_approx cell_circularity_approx")
def i6(spark, sf):
    c = P.cell_measurements(mask(spark, sf))
    return c.select("image", "cell_centroid_y", "cell_centroid_x", F.col("cell_area").cast("double").alias("cell_area"), "cell_extent", "cell_axis_major_length", "cell_axis_minor_length", "cell_aspect_ratio", "cell_perimeter_approx", "cell_circularity_approx")


@query("i7_euler_number", f"""WITH {MASK}, v AS (SELECT DISTINCT image, label, y + a AS y, x + b AS x FROM mask, range(2) t(a), range(2) u(b)), h AS (SELECT DISTINCT image, label, y + a AS y, x FROM mask, range(2) t(a)), w AS (SELECT DISTINCT image, label, y, x + a AS x FROM mask, range(2) t(a)),
s AS (SELECT image, label, 1 AS k FROM v UNION ALL SELECT image, label, -1 FROM h UNION ALL SELECT image, label, -1 FROM w UNION ALL SELECT image, label, 1 FROM mask) SELECT image, label, CAST(sum(k) AS BIGINT) AS euler_number FROM s GROUP BY 1, 2""")
def i7(spark, sf):
    return P.euler_number(mask(spark, sf))


BOUND = """bound AS (SELECT m.image, m.y, m.x FROM mask m WHERE (SELECT count(*) FROM mask n WHERE n.image = m.image AND ((n.y = m.y AND abs(n.x - m.x) = 1) OR (n.x = m.x AND abs(n.y - m.y) = 1))) < 4)"""


@query("i8_boundary_pixels", f"WITH {MASK}, {BOUND} SELECT image, y, x FROM bound")
def i8(spark, sf):
    return P.boundary_pixels(mask(spark, sf), ["image"])


LOC = f"""{MASK}, nuc AS (SELECT * FROM pixels WHERE intensity > 0.1), {BOUND}, nb AS ({BOUND[len("bound AS ("):-1].replace("mask", "nuc")}),
obj AS (SELECT image, CASE WHEN intensity < -0.1 THEN 2 ELSE 3 END AS label, avg(y) AS cy, avg(x) AS cx FROM pixels WHERE intensity < 0 GROUP BY 1, 2)"""


@query("i9_localization", f"""WITH {LOC}, d AS (SELECT o.image, o.label, cy, cx, (SELECT min(sqrt(pow(b.y - cy, 2) + pow(b.x - cx, 2))) FROM bound b WHERE b.image = o.image) AS dc, (SELECT min(sqrt(pow(b.y - cy, 2) + pow(b.x - cx, 2))) FROM nb b WHERE b.image = o.image) AS dn,
 (SELECT avg(y) FROM nuc WHERE nuc.image = o.image) AS ny, (SELECT avg(x) FROM nuc WHERE nuc.image = o.image) AS nx FROM obj o)
SELECT image, label, dc AS distance_from_cell_edge, dn AS distance_from_nucleus, sqrt(pow(cy - ny, 2) + pow(cx - nx, 2)) AS distance_from_nucleus_centroid, CASE WHEN dn + dc = 0 THEN 0.5 ELSE dn / (dn + dc) END AS normalized_radial_position FROM d""",
    doubles="distance_from_cell_edge distance_from_nucleus distance_from_nucleus_centroid normalized_radial_position")
def i9(spark, sf):
    p = T.pixels(spark, sf)
    lab = F.when(F.col("intensity") < -0.1, 2).otherwise(3)
    obj = p.where("intensity < 0").groupBy("image", lab.alias("label")).agg(F.avg("y").alias("centroid_y"), F.avg("x").alias("centroid_x"))
    return P.localization(obj, mask(spark, sf), p.where("intensity > 0.1")).drop("centroid_y", "centroid_x")


@query("j12_nearest_boundary", f"""WITH {LOC} SELECT o.image, o.label, (SELECT min(sqrt(pow(b.y - cy, 2) + pow(b.x - cx, 2))) FROM bound b WHERE b.image = o.image) AS distance FROM obj o""", doubles="distance")
def j12(spark, sf):
    p = T.pixels(spark, sf)
    lab = F.when(F.col("intensity") < -0.1, 2).otherwise(3)
    obj = p.where("intensity < 0").groupBy("image", lab.alias("label")).agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    return P.nearest_distance(obj, P.boundary_pixels(mask(spark, sf), ["image"]), "image", "cy", "cx", "distance").drop("cy", "cx")


@query("i10_box_count_dimension", f"""WITH {MASK}, bx AS (SELECT image, label, min(y) AS y0, min(x) AS x0, CAST(floor(log2(least(max(y) - min(y), max(x) - min(x)) + 1)) AS INT) AS top FROM mask GROUP BY 1, 2),
n AS (SELECT image, label, k, count(DISTINCT (floor((y - y0) / pow(2, k)), floor((x - x0) / pow(2, k)))) AS n FROM mask JOIN bx USING (image, label), range(0, 10) t(k) WHERE k <= top AND top >= 2 GROUP BY 1, 2, 3)
SELECT image, label, f.d AS fractal_dimension FROM bx LEFT JOIN (SELECT image, label, -regr_slope(ln(n), k * ln(2)) AS d FROM n GROUP BY 1, 2) f USING (image, label)""", doubles="fractal_dimension")
def i10(spark, sf):
    return P.box_count_dimension(mask(spark, sf), min_power=2)


HIST = f"""{T.SPATIAL}, v AS (SELECT well, x AS value FROM spatial), en AS (SELECT well, min(value) AS lo, max(value) AS hi FROM v GROUP BY 1), hb AS (SELECT well, CAST(least(255, floor((value - lo) / ((hi - lo) / 256))) AS INT) AS bin, lo, hi FROM v JOIN en USING (well)),
hh AS (SELECT well, bin, count(*) AS n, any_value(lo) + (bin + 0.5) * (any_value(hi) - any_value(lo)) / 256 AS centre FROM hb GROUP BY 1, 2)"""


@query("i11_otsu_threshold", f"""WITH {HIST}, c AS (SELECT *, sum(n) OVER (PARTITION BY well) AS t, sum(n * centre) OVER (PARTITION BY well) AS m, sum(n) OVER (PARTITION BY well ORDER BY bin) AS n1, sum(n * centre) OVER (PARTITION BY well ORDER BY bin) AS s1 FROM hh),
va AS (SELECT well, bin, centre, coalesce((n1 / t) * ((t - n1) / t) * pow(s1 / n1 - (m - s1) / nullif(t - n1, 0), 2), 0) AS variance FROM c)
SELECT well, centre AS threshold, variance FROM va QUALIFY row_number() OVER (PARTITION BY well ORDER BY variance DESC, bin) = 1""", doubles="threshold variance")
def i11(spark, sf):
    return P.otsu_threshold(T.spatial(spark, sf), ["well"], "x")


@query("i12_triangle_threshold", f"""WITH {HIST}, f AS (SELECT e.well, b.bin, coalesce(hh.n, 0) / sum(coalesce(hh.n, 0)) OVER (PARTITION BY e.well) AS h, lo, hi FROM en e CROSS JOIN range(256) b(bin) LEFT JOIN hh ON hh.well = e.well AND hh.bin = b.bin),
p AS (SELECT well, arg_min(bin, (-h, bin)) AS peak, max(h) AS top, min(bin) FILTER (h > 0) AS low, max(bin) FILTER (h > 0) AS high, any_value(lo) AS lo, any_value(hi) AS hi FROM f GROUP BY 1), q AS (SELECT *, (peak - low) < (high - peak) AS flip FROM p),
o AS (SELECT f.well, CASE WHEN flip THEN 255 - bin ELSE bin END AS pos, h, CASE WHEN flip THEN 255 - high ELSE low END AS l, CASE WHEN flip THEN 255 - peak ELSE peak END AS pk, top, flip, q.lo, q.hi FROM f JOIN q USING (well)),
g AS (SELECT *, top * (pos - l) - (pk - l) * h AS len FROM o WHERE pos >= l AND pos < pk) SELECT well, lo + (CASE WHEN flip THEN 255 - pos ELSE pos END + 0.5) * (hi - lo) / 256 AS threshold FROM g QUALIFY row_number() OVER (PARTITION BY well ORDER BY len DESC, pos) = 1""", doubles="threshold")
def i12(spark, sf):
    return P.triangle_threshold(T.spatial(spark, sf), ["well"], "x")


@query("i13_percentile_normalise", f"""WITH {T.SPATIAL}, q AS (SELECT well, quantile_cont(x, 0.01) AS a, quantile_cont(x, 0.99) AS b FROM spatial GROUP BY 1) SELECT cell_id, well, least(greatest((x - a) / (b - a), 0), 1) AS normalised FROM spatial JOIN q USING (well)""", doubles="normalised")
def i13(spark, sf):
    return P.percentile_normalise(T.spatial(spark, sf).select("cell_id", "well", "x"), ["well"], "x").drop("x")


@query("i14_small_object_removal", f"WITH {MASK} SELECT image, y, x FROM mask WHERE image IN (SELECT image FROM mask GROUP BY 1 HAVING count(*) >= 30)")
def i14(spark, sf):
    return P.remove_small(mask(spark, sf), ["image"], 30).select("image", "y", "x")


# --- graphs -----------------------------------------------------------------------------------
@query("g1_connected_components", """WITH RECURSIVE e AS (SELECT DISTINCT 'c' || lpad(CAST(conv_id AS VARCHAR), 9, '0') AS a, 't' || md5(text) AS b FROM conversations), n AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS node, a AS root FROM e UNION SELECT b, b FROM e UNION SELECT n.y, r.root FROM r JOIN n ON n.x = r.node)
SELECT node, min(root) AS component FROM r GROUP BY 1""")
def g1(spark, sf):
    e = T.read(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.lpad(F.col("conv_id").cast("string"), 9, "0")).alias("src"), F.concat(F.lit("t"), F.md5("text")).alias("dst")
    )
    return G.connected_components(e)


TILED = f"{T.PIXELS}, tl AS (SELECT image, y, x, CASE WHEN intensity > 0 THEN y * 8 + x + 1 ELSE 0 END AS label FROM pixels)"


def tiled(spark, sf):
    lab = F.when(F.col("intensity") > 0, F.col("y") * 8 + F.col("x") + 1).otherwise(F.lit(0))
    return T.pixels(spark, sf).select("image", "y", "x", lab.alias("label"))


@query("g2_tile_edge_pairs", f"""WITH {TILED}, p AS (SELECT * FROM tl WHERE label > 0) SELECT DISTINCT a.image, a.label AS a, b.label AS b FROM p a JOIN p b ON a.image = b.image AND (
 (a.x = 4 AND b.x = 3 AND abs(a.y - b.y) <= 1 AND a.y // 4 = b.y // 4) OR (a.y = 4 AND b.y = 3 AND abs(a.x - b.x) <= 1 AND a.x // 4 = b.x // 4))""")
def g2(spark, sf):
    return P.tile_edge_pairs(tiled(spark, sf), "image", 4)


@query("g3_global_relabel", f"""WITH RECURSIVE {T.PIXELS}, tl AS (SELECT image, y, x, y // 4 AS ty, x // 4 AS tx, CASE WHEN intensity > 0 THEN (y % 4) * 4 + (x % 4) + 1 ELSE 0 END AS label FROM pixels),
m AS (SELECT image, ty, tx, max(label) AS m FROM tl GROUP BY 1, 2, 3), o AS (SELECT image, ty, tx, coalesce(sum(m) OVER (PARTITION BY image ORDER BY ty, tx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM m),
gl AS (SELECT tl.*, image * 1000 + label + off AS g FROM tl JOIN o USING (image, ty, tx) WHERE label > 0),
e AS (SELECT DISTINCT a.g AS a, b.g AS b FROM gl a JOIN gl b ON a.image = b.image AND ((a.x = 4 AND b.x = 3 AND abs(a.y - b.y) <= 1 AND a.ty = b.ty) OR (a.y = 4 AND b.y = 3 AND abs(a.x - b.x) <= 1 AND a.tx = b.tx))),
n AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT g AS node, g AS root FROM gl UNION SELECT n.y, r.root FROM r JOIN n ON n.x = r.node), c AS (SELECT node, min(root) AS root FROM r GROUP BY 1)
SELECT image, y, x, CAST(root AS BIGINT) AS object_id FROM gl JOIN c ON c.node = gl.g""")
def g3(spark, sf):
    p = T.pixels(spark, sf)
    lab = F.when(F.col("intensity") > 0, (F.col("y") % 4) * 4 + (F.col("x") % 4) + 1).otherwise(F.lit(0))
    t = p.select("image", "y", "x", F.expr("y div 4").alias("ty"), F.expr("x div 4").alias("tx"), lab.alias("label"))
    g = G.global_labels(t, ["ty", "tx"]).where("label > 0").withColumn("global_label", F.col("image") * 1000 + F.col("global_label"))
    pairs = P.tile_edge_pairs(g.drop("label").withColumnRenamed("global_label", "label"), "image", 4)
    return G.relabel(g, G.connected_components(pairs, "a", "b")).select("image", "y", "x", "object_id")


NODES = """en AS (SELECT cell_id, organelle, branch_type, unnest([src, dst]) AS node FROM branches), nd AS (SELECT cell_id, organelle, node, count(*) AS degree, bool_or(branch_type > 0) AS j, bool_or(branch_type < 2) AS t FROM en GROUP BY 1, 2, 3),
pn AS (SELECT cell_id, organelle, count(*) FILTER (j) AS num_nodes, count(*) FILTER (t AND NOT j) AS num_endpoints, coalesce(avg(degree) FILTER (j), 0) AS average_degree FROM nd GROUP BY 1, 2),
sk AS (SELECT cell_id, organelle, skeleton_id, count(*) AS c, sum(branch_length) AS l FROM branches GROUP BY 1, 2, 3),
pt AS (SELECT cell_id, organelle, CAST(sum(c) AS BIGINT) AS num_branches, sum(l) AS total_branch_length, max(l) AS largest_component_length, count(*) AS num_skeleton_components FROM sk GROUP BY 1, 2)"""


@query("g4_network_summary", f"""WITH {T.BRANCHES}, {NODES}, ar AS (SELECT l_orderkey AS cell_id, l_returnflag AS organelle, sum(l_quantity) AS area FROM lineitem GROUP BY 1, 2)
SELECT *, total_branch_length / area AS network_length_density, num_nodes / area AS branching_density FROM pt JOIN pn USING (cell_id, organelle) JOIN ar USING (cell_id, organelle)""",
    doubles="total_branch_length largest_component_length average_degree area network_length_density branching_density")
def g4(spark, sf):
    areas = T.objects(spark, sf).groupBy("cell_id", "organelle").agg(F.sum("area").alias("area"))
    return G.network_summary(T.branches(spark, sf), ["cell_id", "organelle"], areas)


@query("g5_skeleton_summary", f"""WITH {T.BRANCHES} SELECT cell_id, organelle, skeleton_id, count(*) AS n_branches, sum(branch_length) AS total_length, avg(branch_length) AS mean_length, avg(branch_thickness) AS mean_thickness FROM branches GROUP BY 1, 2, 3""", doubles="total_length mean_length mean_thickness")
def g5(spark, sf):
    return G.skeleton_summary(T.branches(spark, sf), ["cell_id", "organelle", "skeleton_id"])


@query("g6_tortuosity", f"""WITH {T.BRANCHES} SELECT cell_id, organelle, src, dst, branch_length, CASE WHEN abs(src - dst) = 0 THEN 1 ELSE branch_length / abs(src - dst) END AS tortuosity FROM branches""", doubles="branch_length tortuosity")
def g6(spark, sf):
    b = T.branches(spark, sf).withColumn("chord", F.abs(F.col("src") - F.col("dst")).cast("double"))
    return G.tortuosity(b, "branch_length", "chord").select("cell_id", "organelle", "src", "dst", "branch_length", "tortuosity")
