"""Statistics and window operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenforge.functions.scalars import is_control_by_name
from screenforge.operators import skew as K
from screenforge.operators import stats as R
from screenforge.operators import summaries as S
from screenforge.operators import windows as W
from screenforge.operators.longform import to_long
from screenforge.plans import tables as T
from screenforge.plans.registry import query


def control():
    return is_control_by_name(F.col("gene"))

# features named per organelle, as in a screen's feature table
LONG = T.OBJECT_LONG + ", l AS (SELECT cell_id, organelle, guide, gene, well, organelle || '_' || feature AS feature, value FROM object_long)"


def long(spark, sf):
    return T.object_long(spark, sf).withColumn("feature", F.concat_ws("_", "organelle", "feature"))


MOMENTS = """m AS (SELECT feature, avg(value) FILTER (gene = '0') AS control_mean, stddev_samp(value) FILTER (gene = '0') AS control_std, count(value) FILTER (gene = '0') AS control_n,
 avg(value) FILTER (gene <> '0') AS mean, stddev_samp(value) FILTER (gene <> '0') AS std, count(value) FILTER (gene <> '0') AS n FROM l GROUP BY feature)"""
WELCH = """(mean - control_mean) / sqrt(std * std / n + control_std * control_std / control_n) AS t, pow(std * std / n + control_std * control_std / control_n, 2)
 / (pow(std * std / n, 2) / (n - 1) + pow(control_std * control_std / control_n, 2) / (control_n - 1)) AS dof"""




def student_p(source: str) -> str:
    """CTE ``pv``: ``source`` with the two-sided p of Student's t, by Simpson's rule instead of a continued fraction.

    With t = sqrt(dof) tan(a) the tail is a multiple of the integral of cos(a)^(dof - 1) up to a right
    angle; the integrand is taken relative to its first value, so that small p keep their digits.
    """
    weight = "CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    total = f"list_sum(list_transform(range(0, 1001), lambda i: {weight} * exp((dof - 1) * (ln(cos(a0 + wide * i / 1000)) - ln(cos(a0))))))"
    return f"""pa AS (SELECT *, atan(abs(t) / sqrt(dof)) AS a0 FROM {source}), pw AS (SELECT *, least(pi() / 2 - a0, 12 / sqrt(greatest(dof - 1, 1e-9)), 60 / greatest((dof - 1) * tan(a0), 1e-9)) AS wide FROM pa),
pv AS (SELECT * EXCLUDE (a0, wide), exp(ln(2) + lgamma((dof + 1) / 2) - lgamma(dof / 2) - ln(pi()) / 2 + (dof - 1) * ln(cos(a0)) + ln(wide / 3000 * {total})) AS p FROM pw)"""


def bh(source: str, keys: str = "") -> str:
    """CTE ``adjusted``: ``source`` with Benjamini-Hochberg's p_adj within ``keys``; a null p counts as 1."""
    part = f"PARTITION BY {keys} " if keys else ""
    raw = f"least(1.0, coalesce(p, 1.0) * count(*) OVER ({part}) / count(*) OVER ({part}ORDER BY coalesce(p, 1.0) RANGE UNBOUNDED PRECEDING))"
    return f"""bw AS (SELECT *, {raw} AS raw FROM {source}), adjusted AS (SELECT * EXCLUDE (raw), min(raw) OVER ({part}ORDER BY coalesce(p, 1.0) DESC RANGE UNBOUNDED PRECEDING) AS p_adj FROM bw)"""


@query("r1_control_z", f"""WITH {LONG}, c AS (SELECT feature, avg(value) AS mu, stddev_samp(value) AS sd FROM l WHERE gene = '0' GROUP BY 1),
z AS (SELECT gene, l.feature, (value - mu) / nullif(sd, 0) AS z FROM l LEFT JOIN c USING (feature)) SELECT gene, feature, avg(z) AS mean_z, max(z) AS max_z FROM z GROUP BY 1, 2""", doubles="mean_z max_z")
def r1(spark, sf):
    z = R.normalise(long(spark, sf), control())
    return z.groupBy("gene", "feature").agg(F.avg("z").alias("mean_z"), F.max("z").alias("max_z"))


@query("r1_global_z", f"""WITH {LONG}, c AS (SELECT feature, avg(value) AS mu, stddev_samp(value) AS sd FROM l GROUP BY 1),
z AS (SELECT gene, l.feature, (value - mu) / nullif(sd, 0) AS z FROM l LEFT JOIN c USING (feature)) SELECT gene, feature, avg(z) AS mean_z, min(z) AS min_z FROM z GROUP BY 1, 2""", doubles="mean_z min_z")
def r1g(spark, sf):
    return R.normalise(long(spark, sf)).groupBy("gene", "feature").agg(F.avg("z").alias("mean_z"), F.min("z").alias("min_z"))


@query("r2_standard_scale", f"""WITH {LONG}, c AS (SELECT feature, avg(value) AS mu, stddev_pop(value) AS sd FROM l GROUP BY 1),
z AS (SELECT guide, l.feature, coalesce((value - mu) / nullif(sd, 0), 0) AS z FROM l JOIN c USING (feature)) SELECT guide, feature, avg(z) AS mean_z FROM z GROUP BY 1, 2""", doubles="mean_z")
def r2(spark, sf):
    return R.standard_scale(long(spark, sf)).groupBy("guide", "feature").agg(F.avg("z").alias("mean_z"))


@query("r3_simple_regression", f"""WITH {T.OBJECT_ROWS}, g AS (SELECT gene, cell_id, sum(area) AS x, sum(intensity_mean) / 1000 AS y FROM object_rows GROUP BY 1, 2)
SELECT gene, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, CAST(regr_count(y, x) AS BIGINT) AS n FROM g GROUP BY 1""", doubles="slope intercept r2")
def r3(spark, sf):
    g = T.object_rows(spark, sf).groupBy("gene", "cell_id").agg(F.sum("area").alias("x"), (F.sum("intensity_mean") / 1000).alias("y"))
    return R.simple_regression(g, "x", "y", ["gene"])


@query("k3_residual_outliers", f"""WITH {T.OBJECT_ROWS}, g AS (SELECT guide, avg(area) AS x, avg(extent) AS y FROM object_rows GROUP BY 1), f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM g),
r AS (SELECT guide, x, y, y - (a + b * x) AS residual FROM g, f) SELECT guide, x, y, residual FROM r WHERE guide IN (SELECT guide FROM r ORDER BY abs(residual) DESC, guide LIMIT 10)
 OR guide IN (SELECT guide FROM r ORDER BY x + y DESC, guide LIMIT 3) OR guide IN (SELECT guide FROM r ORDER BY x + y, guide LIMIT 3)""", doubles="x y residual")
def k3(spark, sf):
    g = T.object_rows(spark, sf).groupBy("guide").agg(F.avg("area").alias("x"), F.avg("extent").alias("y"))
    return R.residual_outliers(g, "guide", "x", "y")


@query("r4_regress_out_two", f"""WITH {T.SPATIAL}, l AS (SELECT cell_id, x, y, 'f_k' AS feature, f_k AS value FROM spatial UNION ALL SELECT cell_id, x, y, 'mix', x * 0.5 + y * 0.01 + f_k FROM spatial),
v AS (SELECT * FROM l WHERE value IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL), m AS (SELECT feature, avg(value) AS my, avg(x) AS m1, avg(y) AS m2, var_pop(x) AS s11, var_pop(y) AS s22, covar_pop(x, y) AS s12,
 covar_pop(x, value) AS s1y, covar_pop(y, value) AS s2y FROM v GROUP BY 1), b AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM m)
SELECT cell_id, feature, value - (my + b1 * (x - m1) + b2 * (y - m2)) AS residual FROM v JOIN b USING (feature)""", doubles="residual")
def r4(spark, sf):
    s = T.spatial(spark, sf).withColumn("mix", F.col("x") * 0.5 + F.col("y") * 0.01 + F.col("f_k"))
    l = s.select("cell_id", "x", "y", "f_k", "mix").unpivot(["cell_id", "x", "y"], ["f_k", "mix"], "feature", "value")
    return R.regress_out_two(l, "x", "y").select("cell_id", "feature", "residual")


@query("r5_differential_features", f"""WITH {LONG}, {MOMENTS} SELECT feature, mean, std, n, control_mean, control_std, control_n, (mean - control_mean) / control_std AS z, mean / nullif(control_mean, 0) AS fold_change,
 log2((mean + 1e-10) / (control_mean + 1e-10)) AS log2_fc, {WELCH} FROM m WHERE control_std > 1e-6""", doubles="mean std control_mean control_std z fold_change log2_fc t dof", digits=4)
def r5(spark, sf):
    return R.differential_features(long(spark, sf), control(), with_p=False)


@query("r5_differential_p_values", f"""WITH {LONG}, {MOMENTS}, w AS (SELECT *, {WELCH} FROM m WHERE control_std > 1e-6), {student_p("w")}, {bh("pv")}
SELECT feature, mean, std, n, control_mean, control_std, control_n, (mean - control_mean) / control_std AS z, mean / nullif(control_mean, 0) AS fold_change, log2((mean + 1e-10) / (control_mean + 1e-10)) AS log2_fc, t, dof, p, p_adj FROM adjusted""",
       doubles="mean std control_mean control_std z fold_change log2_fc t dof p p_adj", digits=4)
def r5p(spark, sf):
    return R.differential_features(long(spark, sf), control())


@query("r6_gene_feature_volcano", f"""WITH {LONG}, c AS (SELECT feature, avg(value) AS control_mean, stddev_samp(value) AS control_std, count(value) AS control_n FROM l WHERE gene = '0' GROUP BY 1),
g AS (SELECT gene, feature, avg(value) AS mean, stddev_samp(value) AS std, count(value) AS n FROM l WHERE gene <> '0' GROUP BY 1, 2 HAVING count(value) >= 2)
SELECT gene, feature, mean, n, log2((mean + 1e-10) / (control_mean + 1e-10)) AS log2_fc, {WELCH} FROM g JOIN c USING (feature)""", doubles="mean log2_fc t dof", digits=4)
def r6(spark, sf):
    v = R.gene_feature_volcano(long(spark, sf), control(), with_p=False)
    return v.select("gene", "feature", "mean", "n", "log2_fc", "t", "dof")


@query("r6_gene_feature_p_values", f"""WITH {LONG}, c AS (SELECT feature, avg(value) AS control_mean, stddev_samp(value) AS control_std, count(value) AS control_n FROM l WHERE gene = '0' GROUP BY 1),
g AS (SELECT gene, feature, avg(value) AS mean, stddev_samp(value) AS std, count(value) AS n FROM l WHERE gene <> '0' GROUP BY 1, 2 HAVING count(value) >= 2), w AS (SELECT *, {WELCH} FROM g JOIN c USING (feature)), {student_p("w")}, {bh("pv", "feature")}
SELECT gene, feature, mean, std, n, control_mean, control_std, control_n, log2((mean + 1e-10) / (control_mean + 1e-10)) AS log2_fc, t, dof, p, p_adj, -log10(greatest(p, 1e-300)) AS neg_log10_p FROM adjusted""",
       doubles="mean std control_mean control_std log2_fc t dof p p_adj neg_log10_p", digits=4)
def r6p(spark, sf):
    return R.gene_feature_volcano(long(spark, sf), control())


@query("r7_legacy_volcano", f"""WITH {LONG}, {MOMENTS}, w AS (SELECT *, {WELCH} FROM m), {student_p("w")}, o AS (SELECT * REPLACE (CASE WHEN n >= 2 AND control_n >= 2 THEN p ELSE 1.0 END AS p), log2((mean + 1e-10) / (control_mean + 1e-10)) AS log2_fc FROM pv),
k AS (SELECT *, CASE WHEN p > 0 THEN -log10(p) END AS nlp FROM o), u AS (SELECT * EXCLUDE (nlp), CASE WHEN p = 0 THEN 1.1 * max(nlp) OVER () ELSE nlp END AS neg_log10_p FROM k) SELECT * FROM u WHERE log2_fc IS NOT NULL AND neg_log10_p IS NOT NULL""",
       doubles="mean std control_mean control_std log2_fc t dof p neg_log10_p", digits=4)
def r7(spark, sf):
    return R.legacy_volcano(long(spark, sf), control())


@query("r8_pooled_volcano", f"""WITH {LONG}, {MOMENTS}, p AS (SELECT *, CAST(n + control_n - 2 AS DOUBLE) AS dof, ((n - 1) * std * std + (control_n - 1) * control_std * control_std) / (n + control_n - 2) AS v FROM m)
SELECT feature, mean - control_mean AS difference, (mean - control_mean) / sqrt(v * (1.0::DOUBLE / n + 1.0::DOUBLE / control_n)) AS t, dof FROM p""", doubles="difference t dof", digits=4)
def r8(spark, sf):
    return R.pooled_volcano(long(spark, sf), control(), with_p=False).select("feature", "difference", "t", "dof")


@query("r8_pooled_p_values", f"""WITH {LONG}, {MOMENTS}, v AS (SELECT *, CAST(n + control_n - 2 AS DOUBLE) AS dof, ((n - 1) * std * std + (control_n - 1) * control_std * control_std) / (n + control_n - 2) AS var FROM m),
w AS (SELECT * EXCLUDE (var), mean - control_mean AS difference, (mean - control_mean) / sqrt(var * (1.0::DOUBLE / n + 1.0::DOUBLE / control_n)) AS t FROM v), {student_p("w")}
SELECT *, CASE WHEN p < 0.05 / count(*) OVER () AND difference > 0.5 THEN 'up' WHEN p < 0.05 / count(*) OVER () AND difference < -0.5 THEN 'down' ELSE 'ns' END AS class FROM pv""",
       doubles="mean std control_mean control_std difference t dof p", digits=4)
def r8p(spark, sf):
    return R.pooled_volcano(long(spark, sf), control())


_GZ = """c AS (SELECT feature, avg(value) AS mu, stddev_samp(value) AS sd FROM l WHERE gene = '0' GROUP BY 1 HAVING stddev_samp(value) > 1e-6),
g AS (SELECT gene, feature, avg(value) AS m, count(value) AS n FROM l WHERE gene <> '0' GROUP BY 1, 2)"""


@query("r9_feature_ranking_z", f"""WITH {LONG}, {_GZ} SELECT feature, avg(abs((m - mu) / sd)) AS score, count(*) AS n_groups FROM g JOIN c USING (feature) GROUP BY 1 ORDER BY score DESC, feature LIMIT 10""", doubles="score")
def r9(spark, sf):
    return R.feature_ranking(long(spark, sf), control(), 10)


@query("r10_feature_ranking_fc", f"""WITH {LONG}, {_GZ} SELECT feature, avg(abs(log2((m + 1e-10) / (mu + 1e-10)))) AS score, count(*) AS n_groups FROM g JOIN c USING (feature) GROUP BY 1 ORDER BY score DESC, feature LIMIT 10""", doubles="score")
def r10(spark, sf):
    return R.feature_ranking(long(spark, sf), control(), 10, by="fc")


@query("r11_organelle_contribution", f"""WITH {T.OBJECT_LONG}, c AS (SELECT organelle, feature, avg(value) AS mu, stddev_samp(value) AS sd FROM object_long WHERE gene = '0' GROUP BY 1, 2),
g AS (SELECT gene, organelle, feature, avg(value) AS m FROM object_long WHERE gene <> '0' GROUP BY 1, 2, 3 HAVING count(value) >= 3),
s AS (SELECT gene, organelle, avg(abs((m - mu) / CASE WHEN coalesce(sd, 0) = 0 THEN 1 ELSE sd END)) AS score FROM g JOIN c USING (organelle, feature) GROUP BY 1, 2)
SELECT gene, organelle, score, score / sum(score) OVER (PARTITION BY gene) AS share FROM s""", doubles="score share")
def r11(spark, sf):
    return R.organelle_contribution(T.object_long(spark, sf), control())


_SETS = f"""{T.GENES}, sets AS (SELECT gene, set_id FROM genes)"""
EFFECTS = f"""e AS (SELECT s.set_id, l.feature, l.gene IN (SELECT gene FROM sets x WHERE x.set_id = s.set_id) AS inside, l.value FROM l CROSS JOIN (SELECT DISTINCT set_id FROM sets) s),
em AS (SELECT set_id, feature, avg(value) FILTER (inside) AS mean, var_samp(value) FILTER (inside) AS v1, count(value) FILTER (inside) AS n, avg(value) FILTER (NOT inside) AS mean_rest,
 var_samp(value) FILTER (NOT inside) AS v2, count(value) FILTER (NOT inside) AS n_rest FROM e GROUP BY 1, 2),
effects AS (SELECT set_id, feature, n, n_rest, mean, mean_rest, (mean - mean_rest) / sqrt(((n - 1) * v1 + (n_rest - 1) * v2) / (n + n_rest - 2)) AS d FROM em)"""


def effects(spark, sf):
    return R.set_effect_sizes(long(spark, sf), T.genes(spark, sf))


@query("r12_set_effect_sizes", f"WITH {LONG}, {_SETS}, {EFFECTS} SELECT * FROM effects", doubles="mean mean_rest d", digits=5)
def r12(spark, sf):
    return effects(spark, sf)


@query("r13_representative_items", f"""WITH {LONG}, {_SETS}, {EFFECTS}, top AS (SELECT set_id, feature, d FROM effects QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY abs(d) DESC, feature) <= 5),
g AS (SELECT s.set_id, l.guide, l.feature, avg(value) AS value FROM l JOIN sets s USING (gene) GROUP BY 1, 2, 3), st AS (SELECT set_id, feature, avg(value) AS mu, stddev_samp(value) AS sd FROM g GROUP BY 1, 2),
sc AS (SELECT set_id, guide, sum(coalesce((value - mu) / nullif(sd, 0), 0) * d) AS score, count(value) AS n_features FROM g JOIN top USING (set_id, feature) JOIN st USING (set_id, feature) GROUP BY 1, 2)
SELECT set_id, guide, score, n_features, row_number() OVER (PARTITION BY set_id ORDER BY score DESC, guide) AS rank FROM sc QUALIFY rank <= 4""", doubles="score")
def r13(spark, sf):
    g = long(spark, sf).join(T.genes(spark, sf).select("gene", "set_id"), "gene").groupBy("set_id", "guide", "feature").agg(F.avg("value").alias("value"))
    out = R.representative_items(g, effects(spark, sf), 4, "guide")
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("a20_effect_summary", f"""WITH {LONG}, {_SETS}, {EFFECTS} SELECT set_id, substr(feature, 1, 1) AS organelle, max(abs(d)) AS max_abs_d, count(*) AS n_features, avg(d) AS mean_d,
 arg_max(feature, (abs(d), feature)) AS top_feature FROM effects GROUP BY 1, 2""", doubles="max_abs_d mean_d", digits=5)
def a20(spark, sf):
    e = effects(spark, sf).withColumn("organelle", F.substring("feature", 1, 1))
    return S.effect_summary(e, keys=["set_id"])


@query("a24_base_metric_groups", f"""WITH {LONG}, {_SETS}, {EFFECTS}, f AS (SELECT feature || CASE set_id WHEN 0 THEN '_mean' WHEN 1 THEN '_mean_std' WHEN 2 THEN '_max' WHEN 3 THEN '_median' ELSE '_min' END AS feature, d FROM effects),
b AS (SELECT *, regexp_replace(feature, '(_(mean|std|median|max|min))+$', '') AS base_metric FROM f), s AS (SELECT base_metric, bool_and(d > 0) OR bool_and(d < 0) AS same FROM b GROUP BY 1)
SELECT base_metric, CASE WHEN same THEN base_metric ELSE feature END AS display, avg(d) AS mean_d, max(abs(d)) AS max_abs_d, count(*) AS n_features, string_agg(feature, ',' ORDER BY feature) AS features FROM b JOIN s USING (base_metric) GROUP BY 1, 2""", doubles="mean_d max_abs_d", digits=5)
def a24(spark, sf):
    tail = F.element_at(F.array(*[F.lit(x) for x in ("_mean", "_mean_std", "_max", "_median", "_min")]), F.col("set_id") + 1)
    return S.grouped_by_base_metric(effects(spark, sf).select(F.concat("feature", tail).alias("feature"), "d"))


@query("r16_named_group_p_values", f"""WITH {LONG}, {MOMENTS.replace("gene <> '0'", "gene IN ('1', '2', '3')")}, w AS (SELECT *, {WELCH} FROM m WHERE control_std > 1e-6), {student_p("w")}, {bh("pv")} SELECT feature, t, dof, p, p_adj FROM adjusted""", doubles="t dof p p_adj", digits=4)
def r16p(spark, sf):
    l = long(spark, sf).where(F.col("gene").isin("0", "1", "2", "3"))
    return R.differential_features(l, control()).select("feature", "t", "dof", "p", "p_adj")


@query("r16_named_group_test", f"""WITH {LONG}, {MOMENTS.replace("gene <> '0'", "gene IN ('1', '2', '3')")} SELECT feature, mean, n, control_mean, control_n, {WELCH} FROM m""", doubles="mean control_mean t dof", digits=4)
def r16(spark, sf):
    l = long(spark, sf).where(F.col("gene").isin("0", "1", "2", "3"))
    return R.differential_features(l, control(), with_p=False).select("feature", "mean", "n", "control_mean", "control_n", "t", "dof")


@query("r17_spearman_with_target", f"""WITH {T.GENE_CELLS}, {T.OBJECTS}, f AS (SELECT cell_id, avg(area) AS area, max(extent) AS extent, sum(eccentricity) AS ecc FROM objects GROUP BY 1),
l AS (SELECT feature, value, target FROM (SELECT 'area' AS feature, area AS value, cell_area AS target FROM f JOIN gene_cells USING (cell_id) UNION ALL SELECT 'extent', extent, cell_area FROM f JOIN gene_cells USING (cell_id)
 UNION ALL SELECT 'ecc', round(ecc, 6), cell_area FROM f JOIN gene_cells USING (cell_id))),
r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS rv, rank() OVER (PARTITION BY feature ORDER BY target) + (count(*) OVER (PARTITION BY feature, target) - 1) / 2.0::DOUBLE AS rt FROM l)
SELECT feature, corr(rv, rt) AS rho, count(*) AS n FROM r GROUP BY 1""", doubles="rho")
def r17(spark, sf):
    f = T.objects(spark, sf).groupBy("cell_id").agg(F.avg("area").alias("area"), F.max("extent").alias("extent"), F.round(F.sum("eccentricity"), 6).alias("ecc"))
    j = f.join(T.gene_cells(spark, sf).select("cell_id", F.col("cell_area").alias("target")), "cell_id")
    return R.spearman_with_target(to_long(j, ["cell_id", "target"], ["area", "extent", "ecc"]), "target")


@query("r18_method_correlation", f"""WITH {T.GENE_CELLS}, s AS (SELECT guide, avg(cell_area) FILTER (status = 'F') AS a, avg(cell_area) FILTER (status = 'O') AS b FROM gene_cells GROUP BY 1) SELECT corr(a, b) AS r, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n FROM s""", doubles="r")
def r18(spark, sf):
    s = T.gene_cells(spark, sf).groupBy("guide").agg(F.avg(F.when(F.col("status") == "F", F.col("cell_area"))).alias("a"), F.avg(F.when(F.col("status") == "O", F.col("cell_area"))).alias("b"))
    return s.agg(F.corr("a", "b").alias("r"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n"))


@query("r19_discrimination_significance", f"""WITH {T.OBJECT_LONG}, c AS (SELECT organelle, feature, avg(value) AS mu, stddev_pop(value) AS sd FROM object_long GROUP BY 1, 2),
l AS (SELECT organelle, feature, gene, (value - mu) / sd AS value FROM object_long JOIN c USING (organelle, feature)), {MOMENTS.replace("SELECT feature,", "SELECT organelle, feature,").replace("GROUP BY feature", "GROUP BY organelle, feature")}, w AS (SELECT *, {WELCH} FROM m), {student_p("w")}
SELECT organelle, avg(abs(mean - control_mean)) AS effect, avg(CASE WHEN coalesce(p, 1.0) < 0.05 THEN 1.0 ELSE 0.0 END) * 100 AS pct_significant FROM pv GROUP BY 1""", doubles="effect pct_significant")
def r19p(spark, sf):
    return R.discrimination(T.object_long(spark, sf), control(), ["organelle"])


@query("r19_discrimination_effect", f"""WITH {T.OBJECT_LONG}, c AS (SELECT organelle, feature, avg(value) AS mu, stddev_pop(value) AS sd FROM object_long GROUP BY 1, 2),
m AS (SELECT organelle, feature, avg((value - mu) / sd) FILTER (gene <> '0') - avg((value - mu) / sd) FILTER (gene = '0') AS diff FROM object_long JOIN c USING (organelle, feature) GROUP BY 1, 2)
SELECT organelle, avg(abs(diff)) AS effect FROM m GROUP BY 1""", doubles="effect")
def r19(spark, sf):
    return R.discrimination(T.object_long(spark, sf), control(), ["organelle"]).select("organelle", "effect")


@query("r20_variance_comparison", f"""WITH {T.OBJECT_LONG}, v AS (SELECT organelle, feature, var_samp(value) AS variance FROM object_long GROUP BY 1, 2) SELECT organelle, sum(variance) AS total, avg(variance) AS mean, median(variance) AS median,
 avg(CASE WHEN variance > (SELECT quantile_cont(variance, 0.75) FROM v) THEN 1.0 ELSE 0 END) * 100 AS pct_high FROM v GROUP BY 1""", doubles="total mean median pct_high", digits=3)
def r20(spark, sf):
    return R.variance_comparison(T.object_long(spark, sf), "organelle")


_BATCH = f"""{T.GENE_CELLS}, real_ AS (SELECT gene, avg(extract_a) AS a, avg(extract_b) AS b FROM (SELECT gene, CASE WHEN status = 'F' THEN cell_area / 500000 END AS extract_a, CASE WHEN status = 'O' THEN cell_area / 500000 END AS extract_b FROM gene_cells) GROUP BY 1),
ctl AS (SELECT gene, avg(cell_area) FILTER (status = 'P' AND batch = 'FURNITURE') / 500000 AS a, avg(cell_area) FILTER (status = 'P' AND batch = 'BUILDING') / 5000000 AS b FROM gene_cells GROUP BY 1)"""


@query("r21_geometric_batch_correction", f"""WITH {_BATCH}, j AS (SELECT r.*, greatest(c.a, 0.005) AS ca, greatest(c.b, 0.005) AS cb FROM real_ r JOIN ctl c USING (gene) WHERE c.a IS NOT NULL AND c.b IS NOT NULL)
SELECT gene, a, b, sqrt(ca * cb) AS geo, a * least(greatest(sqrt(ca * cb) / ca, 0.2), 5) AS a_corrected, b * least(greatest(sqrt(ca * cb) / cb, 0.2), 5) AS b_corrected FROM j""", doubles="a b geo a_corrected b_corrected")
def r21(spark, sf):
    c = T.gene_cells(spark, sf)
    m = lambda cond, k, name: F.avg(F.when(cond, F.col("cell_area") / k)).alias(name)
    st, ba = F.col("status"), F.col("batch")
    real = c.groupBy("gene").agg(m(st == "F", 500000, "a"), m(st == "O", 500000, "b"))
    ctl = c.groupBy("gene").agg(m((st == "P") & (ba == "FURNITURE"), 500000, "a"), m((st == "P") & (ba == "BUILDING"), 5000000, "b"))
    return R.geometric_batch_correction(real, ctl.where("a IS NOT NULL AND b IS NOT NULL"), "gene", ("a", "b"))


@query("r22_winner_table", f"""WITH {_BATCH} SELECT gene, a - b AS delta, CASE WHEN a > b THEN 'a' ELSE 'b' END AS winner FROM real_""", doubles="delta")
def r22(spark, sf):
    c = T.gene_cells(spark, sf)
    m = lambda s, name: F.avg(F.when(F.col("status") == s, F.col("cell_area") / 500000)).alias(name)
    return R.winner(c.groupBy("gene").agg(m("F", "a"), m("O", "b")), "a", "b").select("gene", "delta", "winner")


@query("r23_profile_against_controls", f"""WITH {LONG}, c AS (SELECT feature, avg(value) AS mu, stddev_pop(value) AS sd FROM l GROUP BY 1), z AS (SELECT gene, l.feature, (value - mu) / sd AS z FROM l JOIN c USING (feature))
SELECT feature, avg(z) FILTER (gene IN ('5', '6')) AS set_z, avg(z) FILTER (gene = '0') AS control_z FROM z GROUP BY 1""", doubles="set_z control_z")
def r23(spark, sf):
    return R.profile_against_controls(long(spark, sf), F.col("gene").isin("5", "6"), control())


@query("r24_density_1d", f"""WITH {T.GENE_CELLS}, v AS (SELECT batch, avg(cell_area) / 100000 AS x FROM gene_cells GROUP BY batch, guide), s AS (SELECT batch, stddev_samp(x) * 0.3 AS h, count(*) AS n, min(x) AS lo, max(x) AS hi FROM v GROUP BY 1),
g AS (SELECT batch, h, n, i, lo + (hi - lo) * i / 49.0::DOUBLE AS grid_at FROM s, range(50) t(i)), d AS (SELECT g.batch, g.i, g.grid_at, sum(exp(-0.5 * pow((g.grid_at - v.x) / h, 2))) / any_value(n * h * sqrt(2 * pi())) AS density FROM g JOIN v USING (batch) GROUP BY 1, 2, 3)
SELECT batch, CAST(i AS INTEGER) AS i, grid_at, density / max(density) OVER (PARTITION BY batch) AS density FROM d""", doubles="grid_at density")
def r24(spark, sf):
    v = T.gene_cells(spark, sf).groupBy("batch", "guide").agg((F.avg("cell_area") / 100000).alias("x"))
    return R.density_1d(v, "batch", "x", points=50)


@query("r25_density_2d", f"""WITH {T.SPATIAL}, v AS (SELECT well, f_k AS x, y FROM spatial WHERE f_k IS NOT NULL), s AS (SELECT well, count(*) AS n, pow(count(*), -1.0 / 6) AS k, stddev_samp(x) AS sx, stddev_samp(y) AS sy, covar_samp(x, y) AS sxy, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v GROUP BY 1),
w AS (SELECT v.well, v.x, v.y, count(*) AS c FROM v GROUP BY 1, 2, 3),
g AS (SELECT s.*, i, j, x0 + (x1 - x0) * i / 7.0::DOUBLE AS gx, y0 + (y1 - y0) * j / 7.0::DOUBLE AS gy, (sx * sx * sy * sy - sxy * sxy) AS det FROM s, range(8) a(i), range(8) b(j))
SELECT g.well, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, sum(c * exp(-0.5 / (k * k) / det * (pow(gx - w.x, 2) * sy * sy - 2 * (gx - w.x) * (gy - w.y) * sxy + pow(gy - w.y, 2) * sx * sx))) / any_value(n * 2 * pi() * k * k * sqrt(det)) * 1000 AS density FROM g JOIN w USING (well) GROUP BY 1, 2, 3""", doubles="density")
def r25(spark, sf):
    d = R.density_2d(T.spatial(spark, sf).where("f_k IS NOT NULL"), "well", "f_k", "y", points=8)
    return d.select("well", "i", "j", (F.col("density") * 1000).alias("density"))


# --- windows ----------------------------------------------------------------------------------
@query("w7_min_max_composite", f"""WITH {T.OBJECTS}, o AS (SELECT organelle, avg(area) AS a, avg(extent) AS b FROM objects GROUP BY 1), s AS (SELECT *, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS a_scaled, (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) AS b_scaled FROM o)
SELECT *, (a_scaled + b_scaled) / 2 AS composite FROM s""", doubles="a b a_scaled b_scaled composite", digits=5)
def w7(spark, sf):
    o = T.objects(spark, sf).groupBy("organelle").agg(F.avg("area").alias("a"), F.avg("extent").alias("b"))
    return W.min_max_composite(o, "organelle", ["a", "b"])


@query("w8_components_to_reach", f"""WITH {T.GENE_CELLS}, n AS (SELECT gene, batch, count(*) AS c, row_number() OVER (PARTITION BY gene ORDER BY count(*) DESC, batch) AS k FROM gene_cells GROUP BY 1, 2),
s AS (SELECT gene, k, sum(c) OVER (PARTITION BY gene ORDER BY k) / sum(c) OVER (PARTITION BY gene) AS cum FROM n) SELECT gene, min(k) FILTER (cum >= 0.75) AS n_components FROM s GROUP BY 1""")
def w8(spark, sf):
    from pyspark.sql import Window

    n = T.gene_cells(spark, sf).groupBy("gene", "batch").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("gene")
    n = n.withColumns({"k": F.row_number().over(w.orderBy(F.col("c").desc(), "batch")).cast("long"), "share": F.col("c") / F.sum("c").over(w)})
    return W.components_to_reach(n, ["gene"], "k", "share", 0.75)


@query("w9_row_shares", f"""WITH {T.GENE_CELLS}, n AS (SELECT gene, batch, count(*) AS c FROM gene_cells GROUP BY 1, 2) SELECT gene, batch, c, c / sum(c) OVER (PARTITION BY gene) AS share FROM n""", doubles="share")
def w9(spark, sf):
    return W.normalise_rows(T.gene_cells(spark, sf).groupBy("gene", "batch").agg(F.count(F.lit(1)).alias("c")), ["gene"], "c")


@query("w11_step_delta", f"""WITH {T.SPATIAL}, s AS (SELECT well, CAST(floor(y / 60) AS BIGINT) AS step, avg(f_k) AS score FROM spatial GROUP BY 1, 2) SELECT well, CAST(step AS BIGINT) AS step, score, score - lag(score) OVER (PARTITION BY well ORDER BY step) AS delta FROM s""", doubles="score delta")
def w11(spark, sf):
    s = T.spatial(spark, sf).groupBy("well", F.floor(F.col("y") / 60).alias("step")).agg(F.avg("f_k").alias("score"))
    return W.step_delta(s, ["well"], "step", "score")


@query("w12_baseline_normalised", f"""WITH {T.GENE_CELLS}, s AS (SELECT gene, batch AS reporter, avg(cell_area) / 1000 AS v FROM gene_cells GROUP BY 1, 2) SELECT s.gene, s.reporter, s.v, s.v / nullif(b.v, 0) AS normalised FROM s LEFT JOIN s b ON b.gene = s.gene AND b.reporter = 'FURNITURE'""", doubles="v normalised")
def w12(spark, sf):
    s = T.gene_cells(spark, sf).groupBy("gene", F.col("batch").alias("reporter")).agg((F.avg("cell_area") / 1000).alias("v"))
    return W.normalise_to_baseline(s, ["gene"], "reporter", "FURNITURE", "v")
