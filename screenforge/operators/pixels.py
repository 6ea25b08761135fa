"""Measurements of labelled regions from a pixel table (image, y, x, label, intensity).

Every measurement is a grouped sum or a closed form of grouped sums, so a region of any size is
reduced before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenforge.functions import scalars as X
from screenforge.operators.skew import quantiles

REGION = ("image", "label")


def region_measurements(pixels: DataFrame, keys: Sequence[str] = REGION, spacing: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Area, centroid, bounding box, extent and equivalent diameter, in spacing units."""
    sy, sx = spacing
    g = pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pixels"), (F.avg("y") * sy).alias("centroid_y"), (F.avg("x") * sx).alias("centroid_x"),
        F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1"),
    )
    area = F.col("n_pixels") * (sy * sx)
    return g.withColumns({
        "area": area, "extent": F.col("n_pixels") / ((F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))),
        "equivalent_diameter_area": F.sqrt(4 * area / math.pi),
    })


def shape_moments(pixels: DataFrame, keys: Sequence[str] = REGION, spacing: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Inertia eigenvalues, axis lengths, eccentricity and orientation from second central moments."""
    sy, sx = spacing
    y, x = F.col("y") * sy, F.col("x") * sx
    m = pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pixels"), F.var_pop(y).alias("vy"), F.var_pop(x).alias("vx"), F.covar_pop(y, x).alias("vyx")
    )
    half, diff = (F.col("vy") + F.col("vx")) / 2, (F.col("vy") - F.col("vx")) / 2
    root = F.sqrt(diff * diff + F.col("vyx") * F.col("vyx"))
    big, small = half + root, F.greatest(half - root, F.lit(0.0))
    tilt = F.when(
        F.col("vy") == F.col("vx"), F.when(F.col("vyx") > 0, F.lit(-math.pi / 4)).otherwise(F.lit(math.pi / 4))
    ).otherwise(0.5 * F.atan2(2 * F.col("vyx"), F.col("vy") - F.col("vx")))
    return m.select(
        *keys, "n_pixels", big.alias("inertia_eigval_0"), small.alias("inertia_eigval_1"), (4 * F.sqrt(big)).alias("axis_major_length"),
        (4 * F.sqrt(small)).alias("axis_minor_length"),
        F.when(big > 0, F.sqrt(F.greatest(1 - small / F.nullif(big, F.lit(0.0)), F.lit(0.0)))).otherwise(0.0).alias("eccentricity"), tilt.alias("orientation"),
    )


def hu_moments(pixels: DataFrame, keys: Sequence[str] = REGION, weight: str | None = None) -> DataFrame:
    """The seven Hu invariants, optionally weighted by intensity. Coordinates are centred on the
    region first, which keeps third-order sums from cancelling."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    c = pixels.groupBy(*keys).agg((F.sum(w * F.col("y")) / F.sum(w)).alias("__cy"), (F.sum(w * F.col("x")) / F.sum(w)).alias("__cx"))
    p = pixels.join(c, list(keys)).withColumns({"__dy": F.col("y") - F.col("__cy"), "__dx": F.col("x") - F.col("__cx"), "__w": w})
    orders = [(2, 0), (1, 1), (0, 2), (3, 0), (2, 1), (1, 2), (0, 3)]
    power = lambda name, k: F.lit(1.0) if k == 0 else F.col(name) if k == 1 else F.col(name) * power(name, k - 1)
    m = p.groupBy(*keys).agg(F.sum("__w").alias("m00"), *[F.sum(F.col("__w") * power("__dy", a) * power("__dx", b)).alias(f"m{a}{b}") for a, b in orders])
    eta = {(a, b): F.col(f"m{a}{b}") / F.pow("m00", F.lit(1 + (a + b) / 2)) for a, b in orders}
    e = m.select(*keys, *[v.alias(f"n{a}{b}") for (a, b), v in eta.items()])
    n = lambda s: F.col(f"n{s}")
    p3, q3 = n("30") + n("12"), n("21") + n("03")
    u3, v3 = n("30") - 3 * n("12"), 3 * n("21") - n("03")
    d2 = n("20") - n("02")
    hu = [
        n("20") + n("02"), d2 * d2 + 4 * n("11") * n("11"), u3 * u3 + v3 * v3, p3 * p3 + q3 * q3,
        u3 * p3 * (p3 * p3 - 3 * q3 * q3) + v3 * q3 * (3 * p3 * p3 - q3 * q3),
        d2 * (p3 * p3 - q3 * q3) + 4 * n("11") * p3 * q3,
        v3 * p3 * (p3 * p3 - 3 * q3 * q3) - u3 * q3 * (3 * p3 * p3 - q3 * q3),
    ]
    return e.select(*keys, *[h.alias(f"hu_{i}") for i, h in enumerate(hu)])


def intensity_statistics(pixels: DataFrame, keys: Sequence[str] = REGION, value: str = "intensity") -> DataFrame:
    """Mean, extremes, population std, quartiles, IQR, MAD, sum, weighted centroid, range and CV."""
    v = F.col(value)
    base = pixels.groupBy(*keys).agg(
        F.avg(v).alias("intensity_mean"), F.max(v).alias("intensity_max"), F.min(v).alias("intensity_min"), F.stddev_pop(v).alias("intensity_std"),
        F.sum(v).alias("intensity_integrated"), F.try_divide(F.sum(v * F.col("y")), F.sum(v)).alias("centroid_weighted_y"),
        F.try_divide(F.sum(v * F.col("x")), F.sum(v)).alias("centroid_weighted_x"),
    )
    q = quantiles(pixels, keys, value, [0.25, 0.5, 0.75], "__q").select(
        *keys, F.col("__q")[0].alias("intensity_q25"), F.col("__q")[1].alias("intensity_median"), F.col("__q")[2].alias("intensity_q75")
    )
    off = pixels.join(q.select(*keys, "intensity_median"), list(keys)).withColumn("__d", F.abs(v - F.col("intensity_median")))
    mad = quantiles(off, keys, "__d", [0.5], "__q").select(*keys, F.col("__q")[0].alias("intensity_mad"))
    j = base.join(q, list(keys)).join(mad, list(keys))
    return j.withColumns({
        "intensity_iqr": F.col("intensity_q75") - F.col("intensity_q25"), "intensity_range": F.col("intensity_max") - F.col("intensity_min"),
        "intensity_cv": F.try_divide(F.col("intensity_std"), F.col("intensity_mean")),
    })


def derived_shape(regions: DataFrame) -> DataFrame:
    major, minor = F.col("axis_major_length"), F.col("axis_minor_length")
    r = regions.withColumns({"aspect_ratio": X.aspect_ratio(major, minor), "perimeter_approx": X.ellipse_perimeter(major, minor)})
    r = r.withColumn("circularity_approx", X.circularity(F.col("area"), F.col("perimeter_approx")))
    return r.withColumn("solidity_approx", F.col("extent")) if "extent" in r.columns else r


def cell_measurements(pixels: DataFrame, cell: str = "image") -> DataFrame:
    """One region per cell: area, axes and derived shape under a ``cell_`` prefix."""
    r = region_measurements(pixels, [cell]).join(shape_moments(pixels, [cell]).drop("n_pixels"), cell)
    d = derived_shape(r).drop("y0", "x0", "y1", "x1", "n_pixels")
    return d.select(cell, *[F.col(c).alias(f"cell_{c}") for c in d.columns if c != cell])


def euler_number(pixels: DataFrame, keys: Sequence[str] = REGION) -> DataFrame:
    """Corners - edges + faces of the union of closed pixel squares, i.e. 8-connected objects minus holes.

    Corners and edges are distinct rows first, so shared ones meet by key, not by region.
    """
    y, x = F.col("y"), F.col("x")
    part = lambda kind, yy, xx: F.struct(F.lit(kind).alias("k"), yy.cast("long").alias("y"), xx.cast("long").alias("x"))
    pieces = F.array(
        part("v", y, x), part("v", y + 1, x), part("v", y, x + 1), part("v", y + 1, x + 1),
        part("h", y, x), part("h", y + 1, x), part("w", y, x), part("w", y, x + 1), part("f", y, x),
    )
    d = pixels.select(*keys, F.explode(pieces).alias("p")).select(*keys, "p.*").distinct()
    sign = F.when(F.col("k").isin("v", "f"), 1).otherwise(-1)
    return d.groupBy(*keys).agg(F.sum(sign).alias("euler_number"))


def boundary_pixels(pixels: DataFrame, keys: Sequence[str] = REGION) -> DataFrame:
    """Region pixels with a 4-neighbour outside the region.

    Each pixel votes for its four neighbours; one aggregation by position counts the votes, with
    no self-join.
    """
    y, x = F.col("y"), F.col("x")
    at = lambda yy, xx, me: F.struct(yy.alias("y"), xx.alias("x"), F.lit(me).alias("me"))
    votes = F.array(at(y, x, 1), at(y - 1, x, 0), at(y + 1, x, 0), at(y, x - 1, 0), at(y, x + 1, 0))
    v = pixels.select(*keys, F.explode(votes).alias("p")).select(*keys, "p.*")
    c = v.groupBy(*keys, "y", "x").agg(F.sum("me").alias("self"), F.count(F.lit(1)).alias("n"))
    return c.where((F.col("self") > 0) & (F.col("n") < 5)).select(*keys, "y", "x")


def packed_points(points: DataFrame, keys: Sequence[str], y: str, x: str, size: int = 1024) -> DataFrame:
    """Points of a key as arrays of about ``size``; a key with many points becomes many rows."""
    n = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    part = F.pmod(F.xxhash64(F.col(y), F.col(x)), F.ceil(F.col("__n") / size)).alias("part")
    j = points.join(n, list(keys)).select(*keys, part, F.struct(F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x")).alias("p"))
    return j.groupBy(*keys, "part").agg(F.collect_list("p").alias("points"))


def nearest_distance(objects: DataFrame, points: DataFrame, cell: str, y: str, x: str, alias: str, size: int = 1024) -> DataFrame:
    """Distance from each object to the nearest point of its cell.

    Points travel as arrays, so an object meets one row per array, not one per point, and the
    minimum inside an array is a row-local expression. Equal objects are worked out once and
    returned as often as they came.
    """
    packs = packed_points(points, [cell], "y", "x", size).select(cell, "points")
    oy, ox = F.col(y), F.col(x)
    best = F.array_min(F.transform("points", lambda p: (p["y"] - oy) * (p["y"] - oy) + (p["x"] - ox) * (p["x"] - ox)))
    cols = objects.columns
    once = objects.groupBy(*cols).agg(F.count(F.lit(1)).alias("__copies"))
    near = once.join(packs, cell, "left").withColumn("__d", best)
    found = near.groupBy(*cols, "__copies").agg(F.sqrt(F.min("__d")).alias(alias))
    return found.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*cols, alias)


def localization(objects: DataFrame, cell_pixels: DataFrame, nucleus_pixels: DataFrame, cell: str = "image", y: str = "centroid_y", x: str = "centroid_x") -> DataFrame:
    """Distances to the cell edge, the nucleus edge and the nucleus centroid; radial = dn / (dn + dc), 0.5 if both are 0."""
    edge = nearest_distance(objects, boundary_pixels(cell_pixels, [cell]), cell, y, x, "distance_from_cell_edge")
    both = nearest_distance(edge, boundary_pixels(nucleus_pixels, [cell]), cell, y, x, "distance_from_nucleus")
    c = nucleus_pixels.groupBy(cell).agg(F.avg("y").alias("__cy"), F.avg("x").alias("__cx"))
    dn, dc = F.col("distance_from_nucleus"), F.col("distance_from_cell_edge")
    j = both.join(c, cell, "left")
    return j.withColumns({
        "distance_from_nucleus_centroid": X.hypot(F.col(y) - F.col("__cy"), F.col(x) - F.col("__cx")),
        "normalized_radial_position": F.when(dn + dc == 0, F.lit(0.5)).otherwise(F.try_divide(dn, dn + dc)),
    }).drop("__cy", "__cx")


def box_count_dimension(pixels: DataFrame, keys: Sequence[str] = REGION, min_power: int = 4) -> DataFrame:
    """Minus the slope of log box count over log box size, in the trimmed bounding box.

    Sizes are the powers of two up to the smaller side; regions with fewer than ``min_power``
    doublings have no dimension.
    """
    box = pixels.groupBy(*keys).agg(
        F.min("y").alias("y0"), F.min("x").alias("x0"), F.least(F.max("y") - F.min("y"), F.max("x") - F.min("x")).alias("side")
    ).select(*keys, "y0", "x0", F.floor(F.log2(F.col("side") + 1)).cast("int").alias("top"))
    fit = box.where(F.col("top") >= min_power)
    s = F.pow(F.lit(2.0), F.col("k")).cast("long")
    p = pixels.join(fit, list(keys)).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("top")))).select(
        *keys, "k", F.floor((F.col("y") - F.col("y0")) / s).alias("by"), F.floor((F.col("x") - F.col("x0")) / s).alias("bx")
    ).distinct()
    counts = p.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("n"))
    dim = counts.groupBy(*keys).agg((-F.regr_slope(F.log("n"), F.col("k") * math.log(2.0))).alias("fractal_dimension"))
    return box.select(*keys).join(dim, list(keys), "left")


# --- thresholds -------------------------------------------------------------------------------
def _histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    ends = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    w = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("lo"), w)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).isNotNull()).join(ends, list(keys)).groupBy(*keys, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi")
    ).withColumn("centre", F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins)


def otsu_threshold(df: DataFrame, keys: Sequence[str], value: str, bins: int = 256) -> DataFrame:
    """Bin centre with the largest between-class variance per group. Windows run over at most ``bins`` rows."""
    h = _histogram(df, keys, value, bins)
    w = Window.partitionBy(*keys)
    run = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    total, mass = F.sum("n").over(w), F.sum(F.col("n") * F.col("centre")).over(w)
    n1, s1 = F.sum("n").over(run), F.sum(F.col("n") * F.col("centre")).over(run)
    n2 = total - n1
    gap = F.try_divide(s1, n1) - F.try_divide(mass - s1, n2)
    v = h.withColumn("variance", F.coalesce((n1 / total) * (n2 / total) * gap * gap, F.lit(0.0)))
    best = v.groupBy(*keys).agg(F.min_by(F.struct("centre", "variance"), F.struct((-F.col("variance")).alias("v"), F.col("bin").alias("b"))).alias("b"))
    return best.select(*keys, F.col("b.centre").alias("threshold"), F.col("b.variance").alias("variance"))


def triangle_threshold(df: DataFrame, keys: Sequence[str], value: str, bins: int = 256) -> DataFrame:
    """Bin furthest from the line between the histogram's peak and its longer tail. Row-local on a ``bins`` array."""
    h = _histogram(df, keys, value, bins).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", F.col("n").cast("double")))).alias("m"), F.min("bin").alias("low"), F.max("bin").alias("high"),
        F.sum("n").alias("total"), F.first("lo").alias("lo"), F.first("hi").alias("hi"),
    )
    full = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("total"))
    h = h.withColumn("h", full).withColumn("top", F.array_max("h")).withColumn("peak", (F.array_position("h", F.col("top")) - 1).cast("int"))
    h = h.withColumn("flip", (F.col("peak") - F.col("low")) < (F.col("high") - F.col("peak")))
    h = h.withColumns({
        "a": F.when(F.col("flip"), F.reverse("h")).otherwise(F.col("h")), "l": F.when(F.col("flip"), bins - 1 - F.col("high")).otherwise(F.col("low")),
        "p": F.when(F.col("flip"), bins - 1 - F.col("peak")).otherwise(F.col("peak")),
    }).withColumn("width", F.col("p") - F.col("l"))
    scale = F.sqrt(F.col("top") * F.col("top") + F.col("width") * F.col("width"))
    h = h.withColumn("len", F.when(F.col("width") > 0, F.transform(
        F.sequence(F.lit(0), F.col("width") - 1), lambda k: F.col("top") / scale * k - F.col("width") / scale * F.get("a", F.col("l") + k)
    )))
    level = F.col("l") + (F.array_position("len", F.array_max("len")) - 1).cast("int")
    level = F.when(F.col("low") == F.col("high"), F.lit(0)).when(F.col("width") <= 0, F.col("l")).otherwise(F.when(F.col("flip"), bins - 1 - level).otherwise(level))
    return h.select(*keys, (F.col("lo") + (level + 0.5) * (F.col("hi") - F.col("lo")) / bins).alias("threshold"))


def percentile_normalise(df: DataFrame, keys: Sequence[str], value: str, low: float = 0.01, high: float = 0.99, invert: bool = False) -> DataFrame:
    q = quantiles(df, keys, value, [low, high], "__q")
    a, b = F.col("__q")[0], F.col("__q")[1]
    v = F.least(F.greatest(F.coalesce(F.try_divide(F.col(value) - a, b - a), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return df.join(q, list(keys)).withColumn("normalised", 1 - v if invert else v).drop("__q")


def remove_small(pixels: DataFrame, keys: Sequence[str], minimum: int) -> DataFrame:
    keep = pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= minimum)
    return pixels.join(keep.select(*keys), list(keys), "left_semi")


def tile_edge_pairs(pixels: DataFrame, image: str, step: int, label: str = "label") -> DataFrame:
    """Pairs of different labels that touch (8-neighbourhood) across the left and top edges of tiles.

    A tile's edge pixel looks at three pixels over the border, within its own tile's span, through
    an equality join on position.
    """
    p = pixels.where(F.col(label) > 0).select(image, "y", "x", F.col(label).alias("a"))
    n = pixels.where(F.col(label) > 0).select(image, F.col("y").alias("ny"), F.col("x").alias("nx"), F.col(label).alias("b"))
    off = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    left = p.where((F.col("x") % step == 0) & (F.col("x") > 0)).withColumn("o", off).select(
        image, "a", (F.col("y") + F.col("o")).alias("ny"), (F.col("x") - 1).alias("nx"), F.floor(F.col("y") / step).alias("t"), F.floor((F.col("y") + F.col("o")) / step).alias("s"))
    top = p.where((F.col("y") % step == 0) & (F.col("y") > 0)).withColumn("o", off).select(
        image, "a", (F.col("y") - 1).alias("ny"), (F.col("x") + F.col("o")).alias("nx"), F.floor(F.col("x") / step).alias("t"), F.floor((F.col("x") + F.col("o")) / step).alias("s"))
    asked = left.unionByName(top).where(F.col("t") == F.col("s")).drop("t", "s")
    return asked.join(n, [image, "ny", "nx"]).where(F.col("a") != F.col("b")).select(image, "a", "b").distinct()
