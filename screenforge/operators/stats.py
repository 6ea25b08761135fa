"""Control comparison and related statistics on long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenforge.functions.scalars import log2_ratio, neg_log10
from screenforge.functions.special import t_two_sided
from screenforge.operators.skew import average_ranks, bh_adjust, join_groups, top_n
from screenforge.session import stored


# --- normalisation ----------------------------------------------------------------------------
def normalise(long: DataFrame, control: Column | None = None, keys: Sequence[str] = ("feature",), population: bool = False) -> DataFrame:
    """z = (value - mean) / std per feature, statistics from controls, or all rows without ``control``."""
    v = F.col("value") if control is None else F.when(control, F.col("value"))
    sd = F.stddev_pop(v) if population else F.stddev_samp(v)
    stats = long.groupBy(*keys).agg(F.avg(v).alias("__mu"), sd.alias("__sd"), F.count(F.lit(1)).alias("__n"))
    z = F.try_divide(F.col("value") - F.col("__mu"), F.col("__sd"))
    return join_groups(long, stats, keys, "__n", "left").withColumn("z", z).drop("__mu", "__sd")


def standard_scale(long: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Population-std scaling; a constant feature scales to 0."""
    out = normalise(long, None, keys, population=True)
    return out.withColumn("z", F.when(F.col("value").isNotNull(), F.coalesce("z", F.lit(0.0))))


# --- moments and tests ------------------------------------------------------------------------
def control_moments(long: DataFrame, control: Column, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Means, standard deviations and counts of both sides from one pass over the rows."""
    c = F.when(control, F.col("value"))
    t = F.when(~control, F.col("value"))
    return long.groupBy(*keys).agg(
        F.avg(c).alias("control_mean"), F.stddev_samp(c).alias("control_std"), F.count(c).alias("control_n"),
        F.avg(t).alias("mean"), F.stddev_samp(t).alias("std"), F.count(t).alias("n"),
    )


def welch(m1: Column, s1: Column, n1: Column, m2: Column, s2: Column, n2: Column) -> tuple[Column, Column]:
    """Welch's t and its degrees of freedom from means, standard deviations and counts."""
    a, b = s1 * s1 / n1, s2 * s2 / n2
    t = F.try_divide(m1 - m2, F.sqrt(a + b))
    df = F.try_divide((a + b) * (a + b), F.try_divide(a * a, n1 - 1) + F.try_divide(b * b, n2 - 1))
    return t, df


def pooled(m1: Column, s1: Column, n1: Column, m2: Column, s2: Column, n2: Column) -> tuple[Column, Column]:
    """Student's t with pooled variance."""
    df = (n1 + n2 - 2).cast("double")
    var = F.try_divide((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2, df)
    return F.try_divide(m1 - m2, F.sqrt(var * (1 / n1 + 1 / n2))), df


_SIDES = ("mean", "std", "n", "control_mean", "control_std", "control_n")


def differential_features(long: DataFrame, control: Column, min_control_std: float = 1e-6, with_p: bool = True) -> DataFrame:
    """Perturbed against control per feature: z, fold change, log2 fold change, Welch p and BH.

    A feature with one control row has effects with a control deviation of 1 and no t or p; one
    perturbed row has no t or p either. A null p counts as 1 in BH. Features without a row on one
    side are left out.
    """
    alone = F.col("control_n") == 1
    m = control_moments(long, control).where((alone | (F.col("control_std") > min_control_std)) & (F.col("n") > 0))
    m = m.withColumn("control_std", F.when(alone, 1.0).otherwise(F.col("control_std")))
    enough = (F.col("control_n") > 1) & (F.col("n") > 1)
    t, dof = (F.when(enough, c) for c in welch(*[F.col(c) for c in _SIDES]))
    out = m.select(
        "feature", *_SIDES,
        ((F.col("mean") - F.col("control_mean")) / F.col("control_std")).alias("z"),
        F.try_divide(F.col("mean"), F.col("control_mean")).alias("fold_change"),
        log2_ratio(F.col("mean"), F.col("control_mean")).alias("log2_fc"), t.alias("t"), dof.alias("dof"),
    )
    if not with_p:
        return out
    out = out.withColumn("p", t_two_sided("t", "dof"))
    return bh_adjust(out, [], "p")


def gene_feature_volcano(
    long: DataFrame, control: Column, gene: str = "gene", min_rows: int = 2, with_p: bool = True,
) -> DataFrame:
    """Each gene × feature against the controls: log2 fold change, Welch p (z-test for a single row), BH per feature."""
    c = long.where(control).groupBy("feature").agg(
        F.avg("value").alias("control_mean"), F.stddev_samp("value").alias("control_std"), F.count("value").alias("control_n")
    ).where((F.col("control_n") >= 2) & (F.col("control_std") > 0))
    g = long.where(~control).groupBy(gene, "feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n")
    ).where(F.col("n") >= min_rows)
    t, dof = welch(*[F.col(x) for x in _SIDES])
    single = F.col("n") == 1
    zscore = F.abs(F.col("mean") - F.col("control_mean")) / F.col("control_std")
    out = g.join(c, "feature").withColumns({
        "log2_fc": log2_ratio(F.col("mean"), F.col("control_mean")),
        "t": F.when(single, zscore).otherwise(t), "dof": F.when(single, F.lit(1e12)).otherwise(dof),
    })
    if not with_p:
        return out
    out = bh_adjust(out.withColumn("p", t_two_sided("t", "dof")), ["feature"], "p")
    return out.withColumn("neg_log10_p", neg_log10(F.col("p")))


def legacy_volcano(long: DataFrame, control: Column, min_rows: int = 2) -> DataFrame:
    """p = 1 where a side has too few rows; infinite -log10 p becomes 1.1 × the largest finite one."""
    m = control_moments(long, control)
    t, dof = welch(*[F.col(x) for x in _SIDES])
    enough = (F.col("n") >= min_rows) & (F.col("control_n") >= min_rows)
    p = m.withColumns({"t": t, "dof": dof}).withColumn("p", t_two_sided("t", "dof"))
    p = p.withColumn("p", F.when(enough, F.col("p")).otherwise(F.lit(1.0)))
    p = p.withColumn("nlp", F.when(F.col("p") > 0, -F.log10("p"))).withColumn(
        "log2_fc", log2_ratio(F.col("mean"), F.col("control_mean"))
    )
    top = p.select(F.max("nlp")).scalar()
    out = p.withColumn("neg_log10_p", F.when(F.col("p") == 0, top * 1.1).otherwise(F.col("nlp")))
    return out.where(F.col("log2_fc").isNotNull() & F.col("neg_log10_p").isNotNull()).drop("nlp")


def pooled_volcano(long: DataFrame, control: Column, min_change: float = 0.5, with_p: bool = True) -> DataFrame:
    """Difference of means with Student's t, Bonferroni 0.05 / m and an up / down / ns class."""
    m = control_moments(long, control)
    t, dof = pooled(*[F.col(x) for x in _SIDES])
    out = m.withColumns({"difference": F.col("mean") - F.col("control_mean"), "t": t, "dof": dof})
    if not with_p:
        return out
    p = out.withColumn("p", t_two_sided("t", "dof"))
    cut = p.select(F.lit(0.05) / F.count(F.lit(1))).scalar()
    hit = F.col("p") < cut
    kind = F.when(hit & (F.col("difference") > min_change), "up").when(hit & (F.col("difference") < -min_change), "down")
    return p.withColumn("class", kind.otherwise("ns"))


# --- rankings ---------------------------------------------------------------------------------
def gene_z(long: DataFrame, control: Column, group: str = "gene", keys: Sequence[str] = (), zero_std: str = "drop") -> DataFrame:
    """z of each group mean against the control rows, per feature."""
    ks = [*keys, "feature"]
    c = long.where(control).groupBy(*ks).agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
    if zero_std == "drop":
        c = c.where(F.col("sd") > 1e-6)
    elif zero_std == "one":
        c = c.withColumn("sd", F.when(F.coalesce(F.col("sd"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("sd")))
    else:
        c = c.withColumn("sd", F.col("sd") + F.lit(1e-10))
    g = long.where(~control).groupBy(group, *ks).agg(F.avg("value").alias("m"), F.count("value").alias("n"))
    return g.join(c, ks).withColumn("z", (F.col("m") - F.col("mu")) / F.col("sd"))


def control_z_ranking(long: DataFrame, control: Column, group: str = "gene") -> DataFrame:
    """Groups ordered by the mean |z| of their features."""
    z = gene_z(long, control, group).groupBy(group).agg(
        F.avg(F.abs("z")).alias("mean_abs_z"), F.max(F.abs("z")).alias("max_abs_z"), F.count(F.lit(1)).alias("n_features")
    )
    w = Window.orderBy(F.col("mean_abs_z").desc(), group)
    return z.withColumn("rank", F.row_number().over(w).cast("long"))


def feature_ranking(long: DataFrame, control: Column, n: int, group: str = "gene", by: str = "z") -> DataFrame:
    """Top features by mean |z| or mean |log2 fold change| over groups; only finite values count."""
    if by == "z":
        score = gene_z(long, control, group).withColumn("s", F.abs("z"))
    else:
        c = long.where(control).groupBy("feature").agg(F.avg("value").alias("mu"))
        g = long.where(~control).groupBy(group, "feature").agg(F.avg("value").alias("m"))
        score = g.join(c, "feature").withColumn("s", F.abs(log2_ratio(F.col("m"), F.col("mu"))))
    out = score.groupBy("feature").agg(F.avg("s").alias("score"), F.count("s").alias("n_groups"))
    return out.orderBy(F.col("score").desc_nulls_last(), "feature").limit(n)


def organelle_contribution(long: DataFrame, control: Column, gene: str = "gene", organelle: str = "organelle", zero_std: str = "one", min_rows: int = 3) -> DataFrame:
    """Mean |z| per gene and organelle, and its share of the gene's total (0 when the total is 0)."""
    z = gene_z(long, control, gene, [organelle], zero_std).where(F.col("n") >= min_rows)
    s = z.groupBy(gene, organelle).agg(F.avg(F.abs("z")).alias("score"))
    total = F.sum("score").over(Window.partitionBy(gene))
    return s.withColumn("share", F.coalesce(F.try_divide(F.col("score"), total), F.lit(0.0)))


# --- effect sizes -----------------------------------------------------------------------------
def set_effect_sizes(long: DataFrame, sets: DataFrame, gene: str = "gene", set_id: str = "set_id") -> DataFrame:
    """Cohen's d of every set against all other rows, for all sets in one pass.

    Rows are reduced to (n, mean, variance) per gene; from these follow n, sum and sum of squares of
    values centred by the feature mean. The rest of a set is total minus set, so no set needs a second
    scan, and no row but those per gene is joined.
    """
    moments = long.where(F.col("feature").isNotNull()).groupBy(gene, "feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
    )
    mu = moments.groupBy("feature").agg(F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("mu"))
    off = F.col("m") - F.col("mu")
    per_gene = moments.join(mu, "feature").select(
        gene, "feature", "n", (F.col("n") * off).alias("s1"), (F.col("n") * (F.col("v") + off * off)).alias("s2"), "mu"
    )
    total = per_gene.groupBy("feature").agg(F.sum("n").alias("tn"), F.sum("s1").alias("t1"), F.sum("s2").alias("t2"))
    inside = per_gene.join(sets.select(gene, set_id).distinct(), gene).groupBy(set_id, "feature").agg(
        F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.first("mu").alias("mu")
    )
    j = inside.join(total, "feature").withColumns({
        "rn": F.col("tn") - F.col("n"), "r1": F.col("t1") - F.col("s1"), "r2": F.col("t2") - F.col("s2"),
    })
    mean = lambda s, n: F.try_divide(F.col(s), F.col(n))
    var = lambda n, s1, s2: F.try_divide(F.col(s2) - F.try_divide(F.col(s1) * F.col(s1), F.col(n)), F.col(n) - 1)
    v1, v2 = F.greatest(var("n", "s1", "s2"), F.lit(0.0)), F.greatest(var("rn", "r1", "r2"), F.lit(0.0))
    sd = (
        F.when((F.col("n") < 2) & (F.col("rn") < 2), F.lit(None).cast("double")).when(F.col("n") < 2, F.sqrt(v2))
        .when(F.col("rn") < 2, F.sqrt(v1))
        .otherwise(F.sqrt(((F.col("n") - 1) * v1 + (F.col("rn") - 1) * v2) / (F.col("n") + F.col("rn") - 2)))
    )
    d = F.coalesce(F.try_divide(mean("s1", "n") - mean("r1", "rn"), sd), F.lit(0.0))
    return j.where(F.col("rn") > 0).select(
        set_id, "feature", "n", F.col("rn").alias("n_rest"), (mean("s1", "n") + F.col("mu")).alias("mean"),
        (mean("r1", "rn") + F.col("mu")).alias("mean_rest"), d.alias("d"),
    )


def representative_items(long: DataFrame, effects: DataFrame, n: int, item: str, set_id: str = "set_id", n_features: int = 5, within: bool = True) -> DataFrame:
    """Items that show a set's profile best: sum of |d|-weighted z over the top features, oriented by the sign of d.

    z uses the set's own statistics, or those of all rows with ``within=False``.
    """
    top = top_n(effects, [set_id], [F.abs("d").desc(), F.col("feature")], n_features, "fr").select(set_id, "feature", "d")
    stats_keys = [set_id, "feature"] if within else ["feature"]
    st = long.groupBy(*stats_keys).agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
    z = long.join(top, [set_id, "feature"]).join(st, stats_keys)
    score = F.coalesce(F.try_divide(F.col("value") - F.col("mu"), F.col("sd")), F.lit(0.0)) * F.col("d")
    s = z.groupBy(set_id, item).agg(F.sum(score).alias("score"), F.count("value").alias("n_features"))
    return top_n(s, [set_id], [F.col("score").desc(), F.col(item)], n)


# --- regression and correlation ---------------------------------------------------------------
def simple_regression(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
    )


def residuals(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows with their residual from the group's fitted line."""
    if keys:
        fit = simple_regression(df, x, y, keys).select(*keys, "slope", "intercept")
        joined = df.join(fit, list(keys))
    else:
        fit = simple_regression(df, x, y).select(F.struct("slope", "intercept").alias("f"))
        joined = df.withColumn("__f", fit.scalar()).withColumns({"slope": F.col("__f.slope"), "intercept": F.col("__f.intercept")}).drop("__f")
    return joined.withColumn("residual", F.col(y) - (F.col("intercept") + F.col("slope") * F.col(x))).drop("slope", "intercept")


def regress_out_two(long: DataFrame, x1: str, x2: str) -> DataFrame:
    """Residual of value ~ x1 + x2 per feature over rows with all three present.

    The normal equations are 2×2, so the fit is a handful of combinable sums per feature.
    """
    rows = long.where(F.col("value").isNotNull() & F.col(x1).isNotNull() & F.col(x2).isNotNull())
    m = rows.groupBy("feature").agg(
        F.avg("value").alias("my"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"),
        F.covar_pop(x1, x1).alias("s11"), F.covar_pop(x2, x2).alias("s22"), F.covar_pop(x1, x2).alias("s12"),
        F.covar_pop(x1, "value").alias("s1y"), F.covar_pop(x2, "value").alias("s2y"),
    )
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    b = m.withColumns({
        "b1": F.try_divide(F.col("s22") * F.col("s1y") - F.col("s12") * F.col("s2y"), det),
        "b2": F.try_divide(F.col("s11") * F.col("s2y") - F.col("s12") * F.col("s1y"), det),
    }).select("feature", "my", "m1", "m2", "b1", "b2")
    fitted = F.col("my") + F.col("b1") * (F.col(x1) - F.col("m1")) + F.col("b2") * (F.col(x2) - F.col("m2"))
    return rows.join(b, "feature").withColumn("residual", F.col("value") - fitted).drop("my", "m1", "m2", "b1", "b2")


def spearman_with_target(long: DataFrame, target: str, n: int = 20) -> DataFrame:
    """Spearman correlation of each feature with a target column, strongest first."""
    rows = long.where(F.col("value").isNotNull() & F.col(target).isNotNull()).select("feature", "value", target)
    # read by the counts of both ranks and by both joins
    ranked = average_ranks(stored(rows), ["feature"], {"value": "rv", target: "rt"})
    out = ranked.groupBy("feature").agg(F.corr("rv", "rt").alias("rho"), F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.abs("rho").desc_nulls_last(), "feature").limit(n)


# --- comparisons of two sides -----------------------------------------------------------------
def discrimination(long: DataFrame, control: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Mean |difference of means| over standardised features, and the share of features with Welch p < .05."""
    ks = [*keys, "feature"]
    scaled = standard_scale(long, ks).drop("value").withColumnRenamed("z", "value")
    m = control_moments(scaled, control, ks)
    t, dof = welch(*[F.col(x) for x in _SIDES])
    p = m.withColumns({"t": t, "dof": dof}).withColumn("p", t_two_sided("t", "dof"))
    return p.groupBy(*keys).agg(
        F.avg(F.abs(F.col("mean") - F.col("control_mean"))).alias("effect"),
        (F.avg((F.coalesce(F.col("p"), F.lit(1.0)) < 0.05).cast("double")) * 100).alias("pct_significant"),
    )


def variance_comparison(long: DataFrame, side: str) -> DataFrame:
    """Total, mean and median variance per side and the share above the joint upper quartile."""
    v = long.groupBy(side, "feature").agg(F.var_samp("value").alias("variance"))
    q75 = v.select(F.percentile("variance", 0.75)).scalar()
    return v.groupBy(side).agg(
        F.sum("variance").alias("total"), F.avg("variance").alias("mean"), F.median("variance").alias("median"),
        (F.avg((F.col("variance") > q75).cast("double")) * 100).alias("pct_high"),
    )


def geometric_batch_correction(real: DataFrame, control: DataFrame, key: str, columns: tuple[str, str], floor: float = 0.005, bound: float = 5.0) -> DataFrame:
    """Scale both sides by the geometric mean of the control scores, factors held within [1/bound, bound]."""
    a, b = columns
    c = control.groupBy(key).agg(F.min(a).alias("__a"), F.min(b).alias("__b"))
    j = real.join(c, key)
    ca, cb = F.greatest(F.col("__a"), F.lit(floor)), F.greatest(F.col("__b"), F.lit(floor))
    geo = F.sqrt(ca * cb)
    held = lambda f: F.least(F.greatest(f, F.lit(1 / bound)), F.lit(bound))
    return j.withColumns({
        "geo": geo, f"{a}_corrected": F.col(a) * held(geo / ca), f"{b}_corrected": F.col(b) * held(geo / cb)
    }).drop("__a", "__b")


def winner(df: DataFrame, a: str, b: str) -> DataFrame:
    """Difference and the larger side; a tie goes to the second."""
    return df.withColumns({"delta": F.col(a) - F.col(b), "winner": F.when(F.col(a) > F.col(b), F.lit(a)).otherwise(F.lit(b))})


def residual_outliers(df: DataFrame, item: str, x: str, y: str, n: int = 10, n_ends: int = 3) -> DataFrame:
    """The n largest |residuals| and the n_ends items highest and lowest in x + y, each item once."""
    r = residuals(df, x, y)
    total = F.col(x) + F.col(y)
    picks = [r.orderBy(F.abs("residual").desc(), item).limit(n), r.orderBy(total.desc(), item).limit(n_ends), r.orderBy(total.asc(), item).limit(n_ends)]
    ids = picks[0].select(item).union(picks[1].select(item)).union(picks[2].select(item)).distinct()
    return r.join(ids, item, "left_semi")


def profile_against_controls(long: DataFrame, members: Column, control: Column) -> DataFrame:
    """Mean standardised value of a set and of the controls per feature."""
    z = standard_scale(long)
    return z.groupBy("feature").agg(F.avg(F.when(members, F.col("z"))).alias("set_z"), F.avg(F.when(control, F.col("z"))).alias("control_z"))


def density_1d(df: DataFrame, key: str, x: str, factor: float = 0.3, points: int = 300) -> DataFrame:
    """Gaussian kernel density on a grid per key, scaled to a maximum of 1.

    Each row adds its kernel to the grid of its own key by exploding a fixed number of grid
    points; sums combine before the shuffle, so a large key costs no more than ``points`` rows a task.
    """
    st = df.where(F.col(x).isNotNull()).groupBy(key).agg(
        (F.stddev_samp(x) * factor).alias("__h"), F.count(x).alias("__n"), F.min(x).alias("__lo"), F.max(x).alias("__hi")
    )
    rows = df.where(F.col(x).isNotNull()).groupBy(key, x).agg(F.count(F.lit(1)).alias("__c")).join(st, key)
    g = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("i") / float(points - 1)
    u = (at - F.col(x)) / F.col("__h")
    d = g.groupBy(key, "i").agg(
        F.first(at).alias("grid_at"), (F.sum(F.col("__c") * F.exp(-0.5 * u * u)) / F.first(F.col("__n") * F.col("__h") * F.sqrt(2 * F.pi()))).alias("density")
    )
    return d.withColumn("density", F.try_divide(F.col("density"), F.max("density").over(Window.partitionBy(key))))


def density_2d(df: DataFrame, key: str, x: str, y: str, points: int = 100) -> DataFrame:
    """Gaussian kernel density with the sample covariance times n^(-1/3), on a points × points grid per key."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    st = ok.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp(x).alias("sx"), F.stddev_samp(y).alias("sy"), F.covar_samp(x, y).alias("sxy"),
        F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"),
    ).withColumns({"k2": F.pow(F.col("n").cast("double"), F.lit(-1.0 / 3)), "det": F.col("sx") * F.col("sx") * F.col("sy") * F.col("sy") - F.col("sxy") * F.col("sxy")})
    rows = ok.groupBy(key, F.col(x).alias("__x"), F.col(y).alias("__y")).agg(F.count(F.lit(1)).alias("__c")).join(st, key)
    axis = F.sequence(F.lit(0), F.lit(points - 1))
    g = rows.withColumn("i", F.explode(axis)).withColumn("j", F.explode(axis))
    dx = F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("i") / float(points - 1) - F.col("__x")
    dy = F.col("y0") + (F.col("y1") - F.col("y0")) * F.col("j") / float(points - 1) - F.col("__y")
    quad = (dx * dx * F.col("sy") * F.col("sy") - 2 * dx * dy * F.col("sxy") + dy * dy * F.col("sx") * F.col("sx")) / F.col("det")
    scale = F.first(F.col("n") * 2 * F.pi() * F.col("k2") * F.sqrt("det"))
    return g.groupBy(key, "i", "j").agg((F.sum(F.col("__c") * F.exp(-0.5 / F.col("k2") * quad)) / scale).alias("density"))
