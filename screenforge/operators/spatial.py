"""Spatial drift: radial positions, drift scores, binned profiles, break points and grids."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenforge.operators.skew import join_groups, join_keys
from screenforge.operators.stats import standard_scale
from screenforge.operators.windows import normalise_to_first


def radial_position(cells: DataFrame, group: str, x: str, y: str, alias: str = "radial", min_cells: int = 1) -> DataFrame:
    """Distance to the mid-range centre of the cell's group; null in groups with too few placed cells.

    The centre is a combinable aggregate joined back, so a large well is never gathered.
    """
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    px, py = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    c = cells.groupBy(group).agg(
        ((F.min(px) + F.max(px)) / 2).alias("__cx"), ((F.min(py) + F.max(py)) / 2).alias("__cy"), F.count_if(ok).alias("__placed"),
        F.count(F.lit(1)).alias("__n"),
    ).where(F.col("__placed") >= min_cells).drop("__placed")
    dx, dy = F.col(x) - F.col("__cx"), F.col(y) - F.col("__cy")
    return join_groups(cells, c, [group], "__n", "left").withColumn(alias, F.sqrt(dx * dx + dy * dy)).drop("__cx", "__cy")


def drift_score(long: DataFrame, ids: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean |z| over the features of a row, z with population std per feature (and key)."""
    z = standard_scale(long, [*keys, "feature"])
    return z.groupBy(*ids, *keys).agg(F.avg(F.abs("z")).alias("drift"))


def radial_bins(df: DataFrame, keys: Sequence[str], r: str, bins: int) -> DataFrame:
    """Right-closed equal-width bins per key; the minimum falls into bin 0."""
    ends = df.where(F.col(r).isNotNull()).groupBy(*keys).agg(F.min(r).alias("r_min"), F.max(r).alias("r_max"), F.count(F.lit(1)).alias("__n"))
    width = (F.col("r_max") - F.col("r_min")) / bins
    index = F.coalesce(F.greatest(F.ceil(F.try_divide(F.col(r) - F.col("r_min"), width)) - 1, F.lit(0)), F.lit(0))
    joined = join_groups(df.where(F.col(r).isNotNull()), ends, keys, "__n") if keys else df.where(F.col(r).isNotNull()).withColumn(
        "__e", ends.select(F.struct("r_min", "r_max")).scalar()).withColumns({"r_min": F.col("__e.r_min"), "r_max": F.col("__e.r_max")}).drop("__e")
    return joined.withColumn("bin", F.least(index, F.lit(bins - 1)).cast("int"))


def bin_profile(df: DataFrame, keys: Sequence[str], r: str, value: str, bins: int = 50, keep_empty: bool = False) -> DataFrame:
    """Mean value, count, annulus density, midpoint and centre-normalised value per radial bin."""
    b = radial_bins(df, keys, r, bins).groupBy(*keys, "bin").agg(
        F.avg(value).alias("mean_drift"), F.count(value).alias("n"), F.min("r_min").alias("r_min"), F.max("r_max").alias("r_max")
    )
    if keep_empty:
        frame = b.groupBy(*keys).agg(F.min("r_min").alias("r_min"), F.max("r_max").alias("r_max")).withColumn(
            "bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
        )
        b = frame.join(b.drop("r_min", "r_max"), [*keys, "bin"], "left").fillna(0, ["n"])
    width = (F.col("r_max") - F.col("r_min")) / bins
    left = F.when(F.col("bin") == 0, F.col("r_min") - (F.col("r_max") - F.col("r_min")) * 0.001).otherwise(F.col("r_min") + F.col("bin") * width)
    right = F.col("r_min") + (F.col("bin") + 1) * width
    area = F.pi() * (right * right - left * left)
    out = b.select(
        *keys, "bin", "mean_drift", "n", F.try_divide(F.col("n"), F.nullif(area, F.lit(0.0))).alias("density"), ((left + right) / 2).alias("mid")
    )
    if keep_empty:
        return out
    return normalise_to_first(out, keys, "mid", "mean_drift")


def _prefix(series: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Points of each binned series in order, and prefix sums of their products, as arrays from 0."""
    w = Window.partitionBy(*keys).orderBy(x, y)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    sums = {"sx": cx, "sy": cy, "sxx": cx * cx, "sxy": cx * cy, "syy": cy * cy}
    rows = series.select(*keys, F.row_number().over(w).alias("i"), F.col(x).alias("x"), *[F.sum(c).over(upto).alias(k) for k, c in sums.items()])
    all_rows = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "x", *sums))).alias("pts"))
    from_zero = lambda k: F.concat(F.array(F.lit(0.0)), F.transform("pts", lambda p: F.coalesce(p[k], F.lit(0.0))))
    return all_rows.withColumns({k: from_zero(k) for k in sums}).withColumn("m", F.size("pts"))


def _or_mean(found: DataFrame, series: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """A series too short for a break keeps its row, with the mean of x."""
    means = series.groupBy(*keys).agg(F.avg(x).alias("__mean"))
    joined = join_keys(means, found, keys, "left")
    return joined.withColumn("break_x", F.coalesce("break_x", "__mean")).drop("__mean")


def _sse(i: Column, j: Column) -> Column:
    """Residual sum of squares of the line through points i..j-1, from prefix sums."""
    d = lambda c: F.col(c)[j] - F.col(c)[i]
    n = (j - i).cast("double")
    sxx = d("sxx") - d("sx") * d("sx") / n
    sxy = d("sxy") - d("sx") * d("sy") / n
    syy = d("syy") - d("sy") * d("sy") / n
    return syy - F.coalesce(F.try_divide(sxy * sxy, sxx), F.lit(0.0))


def two_segment_break(series: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Split with the least total error of two lines, at least two points on each side; under five points the mean of x."""
    p = _prefix(series, keys, x, y)
    i = F.col("i")
    cand = p.where(F.col("m") >= 5).withColumn("i", F.explode(F.sequence(F.lit(2), F.col("m") - 3)))
    e = cand.select(*keys, (_sse(F.lit(0), i) + _sse(i, F.col("m"))).alias("sse"), F.col("pts")[i]["x"].alias("break_x"), "i")
    best = e.groupBy(*keys).agg(F.min_by("break_x", F.struct("sse", "i")).alias("break_x"), F.min("sse").alias("sse"))
    return _or_mean(best, series, keys, x)


def three_segment_break(series: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Best pair of splits; the second is reported when the first lies left of the middle; under seven points the mean of x."""
    p = _prefix(series, keys, x, y).where(F.col("m") >= 7)
    i, j, m = F.col("i"), F.col("j"), F.col("m")
    cand = p.withColumn("i", F.explode(F.sequence(F.lit(2), m - 5))).withColumn("j", F.explode(F.sequence(i + 2, m - 3)))
    sse = _sse(F.lit(0), i) + _sse(i, j) + _sse(j, m)
    pts = F.col("pts")
    mid = (pts[0]["x"] + pts[m - 1]["x"]) / 2
    chosen = F.when(pts[i]["x"] < mid, pts[j]["x"]).otherwise(pts[i]["x"])
    e = cand.select(*keys, sse.alias("sse"), chosen.alias("break_x"), "i", "j")
    best = e.groupBy(*keys).agg(F.min_by("break_x", F.struct("sse", "i", "j")).alias("break_x"), F.min("sse").alias("sse"))
    return _or_mean(best, series, keys, x)


def _local_regression(x: np.ndarray, y: np.ndarray, frac: float, rounds: int = 3) -> np.ndarray:
    """Robust local linear smoothing with tricube weights over the nearest share of points."""
    n, k = len(x), max(2, int(np.ceil(frac * len(x) - 1e-9)))
    robust = np.ones(n)
    fit = y.astype(float).copy()
    for _ in range(rounds + 1):
        for i in range(n):
            d = np.abs(x - x[i])
            h = np.sort(d)[k - 1]
            w = robust * np.clip(1 - (d / h) ** 3, 0, None) ** 3 if h > 0 else robust * (d == 0)
            sw = w.sum()
            if sw <= 0:
                continue
            mx, my = (w * x).sum() / sw, (w * y).sum() / sw
            sxx = (w * (x - mx) ** 2).sum()
            slope = (w * (x - mx) * (y - my)).sum() / sxx if sxx > 1e-12 else 0.0
            fit[i] = my + slope * (x[i] - mx)
        res = y - fit
        s = np.median(np.abs(res))
        if s <= 1e-12:
            break
        robust = np.clip(1 - (res / (6 * s)) ** 2, 0, None) ** 2
    return fit


def second_derivative_break(series: DataFrame, keys: Sequence[str], x: str, y: str, frac: float = 0.5) -> DataFrame:
    """Largest second derivative of the smoothed series of binned points; under three points the mean of x."""
    pts = series.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("pts"))

    @F.pandas_udf(T.DoubleType())
    def bend(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(xs, ys):
            a, b = np.asarray(a, float), np.asarray(b, float)
            if len(a) < 3:
                out.append(float(a.mean()) if len(a) else None)
                continue
            second = np.gradient(np.gradient(_local_regression(a, b, frac), a), a)
            out.append(float(a[int(np.argmax(second))]))
        return pd.Series(out, dtype="float64")

    return pts.select(*keys, bend(F.transform("pts", lambda p: p["x"]), F.transform("pts", lambda p: p["y"])).alias("break_x"))


def share_beyond(df: DataFrame, breaks: DataFrame, keys: Sequence[str], r: str) -> DataFrame:
    """Percent of cells beyond their key's break point."""
    beyond = F.col(r) > F.col("break_x")
    rows = df.where(F.col(r).isNotNull())
    sized = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).join(breaks.select(*keys, "break_x"), list(keys))
    return join_groups(rows, sized, keys, "__n").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(beyond).alias("n_beyond"), (F.avg(beyond.cast("double")) * 100).alias("pct_beyond")
    )


def well_grid(df: DataFrame, well: str, x: str, y: str, value: str, tiles: int = 30) -> DataFrame:
    """Mean value per tile of a tiles × tiles grid over each well, over the mean of the wells' centre tiles."""
    ends = df.groupBy(well).agg((F.floor(F.max(x)) + 1).alias("__w"), (F.floor(F.max(y)) + 1).alias("__h"), F.count(F.lit(1)).alias("__n"))
    t = join_groups(df, ends, [well], "__n").withColumns({
        "col": F.floor(F.col(x) / (F.col("__w") / tiles)), "row": F.floor(F.col(y) / (F.col("__h") / tiles)),
    })
    g = t.groupBy(well, "row", "col").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    centre = g.where((F.col("row") == tiles // 2) & (F.col("col") == tiles // 2)).select(F.coalesce(F.avg("mean"), F.lit(1.0))).scalar()
    return g.withColumn("__c", centre).withColumn(
        "normalised", F.when(F.col("__c") > 1e-9, F.col("mean") / F.nullif(F.col("__c"), F.lit(0.0))).otherwise(F.col("mean"))
    ).drop("__c")


def average_tile(df: DataFrame, x: str, y: str, value: str, bin_size: int = 25) -> DataFrame:
    """Left-closed bins of local coordinates, over the value at the centre of the occupied grid."""
    g = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({
        "x_bin": F.floor(F.col(x) / bin_size), "y_bin": F.floor(F.col(y) / bin_size),
    }).groupBy("y_bin", "x_bin").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    # the grid's size is bounded by the tile's size, not by the number of cells
    xs, ys = F.sort_array(F.collect_set("x_bin")), F.sort_array(F.collect_set("y_bin"))
    axes = g.agg(xs.alias("xs"), ys.alias("ys"))
    mid = axes.select(F.struct(
        F.col("xs")[F.floor(F.size("xs") / 2).cast("int")].alias("cx"), F.col("ys")[F.floor(F.size("ys") / 2).cast("int")].alias("cy")
    )).scalar()
    m = g.withColumn("__m", mid)
    at = m.where((F.col("x_bin") == F.col("__m.cx")) & (F.col("y_bin") == F.col("__m.cy"))).select(F.max("mean")).scalar()
    return m.withColumn("__c", at).withColumn(
        "normalised", F.when(F.col("__c") > 1e-9, F.col("mean") / F.nullif(F.col("__c"), F.lit(0.0))).otherwise(F.col("mean"))
    ).drop("__m", "__c")


def drift_summary(scores: DataFrame, well: str) -> DataFrame:
    return scores.groupBy(well).agg(F.avg("drift").alias("mean_drift"), F.stddev_samp("drift").alias("std_drift"), F.count("drift").alias("n"))
