"""Level tables and summaries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenforge.functions.scalars import is_control_by_name
from screenforge.operators import levels as L
from screenforge.operators import summaries as S
from screenforge.operators.longform import to_long
from screenforge.plans import tables as T
from screenforge.plans.registry import query

STAT_SQL = {
    "mean": "avg({0})", "median": "median({0})", "std": "stddev_samp({0})", "sum": "sum({0})", "min": "min({0})",
    "max": "max({0})", "count": "count({0})",
}


def stats_sql(features, prefix="", aggs=tuple(STAT_SQL)):
    return ", ".join(f"{STAT_SQL[a].format(f)} AS {prefix}{f}_{a}" for f in features for a in aggs)


def stat_doubles(features, prefix="", aggs=tuple(STAT_SQL)):
    return " ".join(f"{prefix}{f}_{a}" for f in features for a in aggs if a != "count")


def cell_features(spark, sf):
    """Cells with the mean area and intensity per organelle as wide features, plus guide and gene."""
    per = L.objects_to_cells(T.objects(spark, sf), ["area", "extent"], aggs=["mean"]).drop("count")
    wide = L.prefixed_by_organelle(per, ["A", "N", "R"])
    return T.gene_cells(spark, sf).join(wide, "cell_id", "left")


CELL_FEATURES = ["A_area_mean", "N_area_mean", "R_area_mean", "A_extent_mean", "N_extent_mean", "R_extent_mean"]
CELL_FEATURES_SQL = f"""{T.OBJECTS}, {T.GENE_CELLS}, wide AS (SELECT cell_id, """ + ", ".join(
    f"avg(CASE WHEN organelle='{f[0]}' THEN {f[2:-5]} END) AS {f}" for f in CELL_FEATURES
) + """ FROM objects GROUP BY cell_id), cell_features AS (SELECT c.*, w.* EXCLUDE (cell_id) FROM gene_cells c LEFT JOIN wide w USING (cell_id))"""


@query("flagship_ranked_perturbations", f"""
WITH {CELL_FEATURES_SQL}, long AS ({" UNION ALL ".join(f"SELECT gene, '{f}' AS feature, {f} AS value FROM cell_features" for f in CELL_FEATURES)}),
control AS (SELECT feature, avg(value) AS mu, stddev_samp(value) AS sd FROM long WHERE gene = '0' GROUP BY feature),
g AS (SELECT gene, feature, avg(value) AS m, count(value) AS n FROM long WHERE gene <> '0' GROUP BY gene, feature),
z AS (SELECT g.gene, g.feature, abs((m - mu) / sd) AS z, n FROM g JOIN control USING (feature) WHERE sd > 1e-6)
SELECT gene, avg(z) AS mean_abs_z, max(z) AS max_abs_z, count(*) AS n_features,
 row_number() OVER (ORDER BY avg(z) DESC, gene) AS rank FROM z GROUP BY gene""", doubles="mean_abs_z max_abs_z")
def flagship(spark, sf):
    from screenforge.operators.stats import control_z_ranking

    df = cell_features(spark, sf)
    long = to_long(df, ["cell_id", "gene"], CELL_FEATURES)
    return control_z_ranking(long, is_control_by_name(F.col("gene")), "gene")


@query("a1_seven_stats", f"""WITH {T.OBJECT_LONG} SELECT organelle, feature, avg(value) AS mean, median(value) AS median,
 stddev_samp(value) AS std, sum(value) AS sum, min(value) AS min, max(value) AS max, count(value) AS count
 FROM object_long GROUP BY organelle, feature""", doubles="mean median std sum min max", digits=5)
def a1(spark, sf):
    return L.seven_stats_long(T.object_long(spark, sf), ["organelle", "feature"])


@query("a2_objects_to_cells", f"""WITH {T.OBJECTS} SELECT cell_id, organelle, {stats_sql(["area", "extent"])}, count(*) AS count
 FROM objects GROUP BY cell_id, organelle""", doubles=stat_doubles(["area", "extent"]))
def a2(spark, sf):
    return L.objects_to_cells(T.objects(spark, sf), ["area", "extent"])


@query("a3_area_fraction", f"""WITH {T.OBJECTS}, {T.CELLS}, s AS (SELECT cell_id, organelle, sum(area) AS area_sum FROM objects GROUP BY 1, 2)
 SELECT s.cell_id, organelle, area_sum, cell_area, area_sum / nullif(cell_area, 0) AS area_fraction
 FROM s JOIN cells USING (cell_id)""", doubles="area_sum cell_area area_fraction")
def a3(spark, sf):
    per = L.seven_stats(T.objects(spark, sf), ["cell_id", "organelle"], ["area"], ["sum"])
    return L.area_fraction(per, T.cells(spark, sf), "area_sum", "cell_area")


@query("a4_branches_to_cells", f"""WITH {T.BRANCHES} SELECT cell_id, organelle,
 {stats_sql(["branch_length", "branch_thickness"], "network_")}, count(*) AS branch_count
 FROM branches GROUP BY cell_id, organelle""", doubles=stat_doubles(["branch_length", "branch_thickness"], "network_"))
def a4(spark, sf):
    return L.seven_stats(
        T.branches(spark, sf), ["cell_id", "organelle"], ["branch_length", "branch_thickness"], prefix="network_",
        extra=[F.count(F.lit(1)).alias("branch_count")],
    )


@query("a5_supplement_to_cells", f"""WITH {T.OBJECTS} SELECT cell_id, organelle, {stats_sql(["eccentricity"])}
 FROM objects GROUP BY cell_id, organelle""", doubles=stat_doubles(["eccentricity"]))
def a5(spark, sf):
    return L.seven_stats(T.objects(spark, sf), ["cell_id", "organelle"], ["eccentricity"])


@query("a6_localization_to_cells", f"""WITH {T.OBJECTS} SELECT cell_id, organelle, avg(extent) AS extent_mean,
 coalesce(stddev_samp(extent), 0) AS extent_std, min(extent) AS extent_min, max(extent) AS extent_max
 FROM objects GROUP BY cell_id, organelle""", doubles="extent_mean extent_std extent_min extent_max")
def a6(spark, sf):
    out = L.seven_stats(T.objects(spark, sf), ["cell_id", "organelle"], ["extent"], ["mean", "std", "min", "max"])
    return out.fillna(0.0, ["extent_std"])


_F2 = ["A_area_mean", "R_extent_mean"]


@query("a7_cells_to_guides", f"""WITH {CELL_FEATURES_SQL} SELECT guide, {stats_sql(_F2)},
 arg_min(gene, cell_id) AS gene, arg_min(batch, cell_id) AS batch, count(*) AS n_cells FROM cell_features GROUP BY guide""",
    doubles=stat_doubles(_F2))
def a7(spark, sf):
    return L.cells_to_guides(cell_features(spark, sf), _F2, metadata=["gene", "batch"])


@query("a7_cells_to_guides_zero_filled", f"""WITH {CELL_FEATURES_SQL}, z AS (SELECT guide, coalesce(A_area_mean, 0) AS A_area_mean,
 coalesce(R_extent_mean, 0) AS R_extent_mean FROM cell_features) SELECT guide, avg(A_area_mean) AS A_area_mean_mean,
 coalesce(stddev_samp(A_area_mean), 0) AS A_area_mean_std, avg(R_extent_mean) AS R_extent_mean_mean,
 coalesce(stddev_samp(R_extent_mean), 0) AS R_extent_mean_std, count(*) AS n_cells FROM z GROUP BY guide""",
    doubles="A_area_mean_mean A_area_mean_std R_extent_mean_mean R_extent_mean_std")
def a7z(spark, sf):
    return L.cells_to_guides(cell_features(spark, sf), _F2, aggs=["mean", "std"], missing="zero", zero_std=True)


@query("a8_cells_to_genes", f"""WITH {CELL_FEATURES_SQL} SELECT gene, {stats_sql(_F2)}, arg_min(batch, cell_id) AS batch,
 count(*) AS n_cells, count(DISTINCT guide) AS n_guides FROM cell_features GROUP BY gene""", doubles=stat_doubles(_F2))
def a8(spark, sf):
    return L.cells_to_genes(cell_features(spark, sf), _F2, metadata=["batch"])


_SIX = ["mean", "median", "std", "sum", "min", "max"]


@query("a9_guides_min_support", f"""WITH {CELL_FEATURES_SQL} SELECT guide, {stats_sql(_F2, aggs=_SIX)}, count(*) AS n_cells
 FROM cell_features GROUP BY guide HAVING count(*) >= 3""", doubles=stat_doubles(_F2))
def a9(spark, sf):
    return L.cells_to_guides(cell_features(spark, sf), _F2, aggs=_SIX, min_cells=3)


@query("a10_barcode_fallback", f"""WITH {CELL_FEATURES_SQL} SELECT batch, {stats_sql(_F2)}, count(*) AS n_cells
 FROM cell_features GROUP BY batch""", doubles=stat_doubles(_F2))
def a10(spark, sf):
    return L.cells_to_guides(cell_features(spark, sf), _F2, guide="batch")


@query("a12_variance_ranking", f"""WITH {T.OBJECT_LONG}, v AS (SELECT organelle || '_' || feature AS feature, value FROM object_long)
 SELECT feature, var_samp(value) AS variance FROM v GROUP BY feature ORDER BY variance DESC, feature LIMIT 6""",
    doubles="variance", digits=3)
def a12(spark, sf):
    named = T.object_long(spark, sf).withColumn("feature", F.concat_ws("_", "organelle", "feature"))
    return S.variance_ranking(named, 6)


@query("a13_describe", f"""WITH {T.OBJECT_LONG} SELECT feature, min(value) AS min, max(value) AS max, avg(value) AS mean,
 median(value) AS median, stddev_samp(value) AS std FROM object_long GROUP BY feature""", doubles="min max mean median std", digits=5)
def a13(spark, sf):
    return L.seven_stats_long(T.object_long(spark, sf), ["feature"], ["min", "max", "mean", "median", "std"])


@query("a14_group_quality", f"""WITH {T.OBJECT_LONG}, per AS (SELECT organelle, feature, var_samp(value) AS variance,
 avg(CASE WHEN value IS NULL OR value = 0 THEN 1.0 ELSE 0.0 END) * 100 AS empty FROM object_long GROUP BY 1, 2),
cut AS (SELECT organelle, greatest(quantile_cont(variance, 0.05), 1e-8) AS threshold FROM per GROUP BY 1),
o AS (SELECT organelle, count(*) AS n_features, avg(variance) AS mean_variance, median(variance) AS median_variance,
 avg(CASE WHEN variance < threshold THEN 1.0 ELSE 0.0 END) * 100 AS pct_low_variance, avg(empty) AS pct_zero_or_null
 FROM per JOIN cut USING (organelle) GROUP BY 1)
SELECT *, CASE WHEN pct_low_variance > 80 THEN 'POOR' WHEN pct_low_variance > 50 THEN 'MARGINAL'
 WHEN pct_zero_or_null > 80 THEN 'SPARSE' ELSE 'GOOD' END AS status FROM o""",
    doubles="mean_variance median_variance pct_low_variance pct_zero_or_null", digits=3)
def a14(spark, sf):
    return S.group_quality(T.object_long(spark, sf))


_GUIDE_LONG_SQL = CELL_FEATURES_SQL + ", guide_long AS (" + " UNION ALL ".join(
    f"SELECT gene, guide, '{f}' AS feature, avg({f}) AS value FROM cell_features GROUP BY gene, guide" for f in CELL_FEATURES[:3]
) + ")"


def guide_long(spark, sf):
    g = L.seven_stats(cell_features(spark, sf), ["gene", "guide"], CELL_FEATURES[:3], ["mean"])
    g = g.withColumnsRenamed({f"{f}_mean": f for f in CELL_FEATURES[:3]})
    return to_long(g, ["gene", "guide"], CELL_FEATURES[:3])


@query("a15_within_gene_consistency", f"""WITH {_GUIDE_LONG_SQL}, per AS (SELECT gene, feature, count(*) AS n,
 stddev_samp(value) / (avg(value) + 1e-10) AS cv FROM guide_long GROUP BY 1, 2)
SELECT gene, max(n) AS n_guides, avg(cv) AS mean_cv, avg(cv) > 1.0 AS inconsistent FROM per GROUP BY gene HAVING max(n) >= 2""",
    doubles="mean_cv")
def a15(spark, sf):
    return S.within_gene_consistency(guide_long(spark, sf))


@query("a16_well_distribution", f"""WITH {T.CELLS}, w AS (SELECT well, count(*) AS c FROM cells GROUP BY well)
 SELECT count(*) AS n_groups, avg(c) AS mean_rows, stddev_samp(c) AS std_rows FROM w""", doubles="mean_rows std_rows")
def a16(spark, sf):
    return S.group_size_summary(T.cells(spark, sf), "well")


@query("a17_low_count_flags", f"""WITH {T.CELLS}, g AS (SELECT guide, count(*) AS n_cells FROM cells GROUP BY guide)
 SELECT count(*) AS n_guides, count(*) FILTER (n_cells < 10) AS n_low,
 avg(CASE WHEN n_cells < 10 THEN 1.0 ELSE 0.0 END) * 100 AS pct_low FROM g""", doubles="pct_low")
def a17(spark, sf):
    return S.flag_low_counts(T.cells(spark, sf).groupBy("guide").agg(F.count(F.lit(1)).alias("n_cells")), 10)


def _unique(cols):
    return f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(cols)} FROM objects))"


def _a18_part(name, cols):
    per = " UNION ALL ".join(
        f"SELECT count(DISTINCT {c}) AS d, count(*) FILTER ({c} = 0) AS z, min({c}) AS lo, max({c}) AS hi, count(*) AS n FROM objects" for c in cols
    )
    return f"""SELECT '{name}' AS organelle, max(n) AS n_rows, {_unique(cols)} AS n_unique,
 (max(n) - {_unique(cols)}) * 100.0 / max(n) AS duplicate_pct, avg(d) AS avg_distinct, min(d) AS min_distinct, max(d) AS max_distinct,
 CAST(sum(z) AS DOUBLE) / sum(n) * 100 AS zero_pct, CAST(count(*) FILTER (d <= 1) AS BIGINT) AS n_constant, max(hi) - min(lo) AS value_range
 FROM ({per})"""


@query("a18_duplicate_diagnosis", f"""WITH {T.OBJECTS} {_a18_part("shape", ["area", "extent", "eccentricity"])}
 UNION ALL {_a18_part("texture", ["extent", "eccentricity"])}""", doubles="duplicate_pct avg_distinct zero_pct value_range")
def a18(spark, sf):
    return S.duplicate_diagnosis(
        T.objects(spark, sf), {"shape": ["area", "extent", "eccentricity"], "texture": ["extent", "eccentricity"]}
    )


@query("a19_distinct_and_value_counts", f"""WITH {T.GENE_CELLS} SELECT gene, count(*) AS n,
 count(DISTINCT guide) AS n_guides, count(DISTINCT well) AS n_wells FROM gene_cells GROUP BY gene""")
def a19(spark, sf):
    return T.gene_cells(spark, sf).groupBy("gene").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("guide").alias("n_guides"), F.count_distinct("well").alias("n_wells")
    )


_CLUSTER_LONG = f"""{T.OBJECT_LONG}, cl AS (SELECT well AS cluster, organelle || '_' || feature AS feature, value FROM object_long)"""


@query("a21_cluster_profiles", f"""WITH {_CLUSTER_LONG}, m AS (SELECT cluster, feature, avg(value) AS mean FROM cl GROUP BY 1, 2 HAVING count(value) >= 2),
s AS (SELECT feature, var_samp(mean) AS between_, avg(mean) AS mu, stddev_pop(mean) AS sd FROM m GROUP BY 1 ORDER BY between_ DESC, feature LIMIT 8),
z AS (SELECT cluster, feature, mean, coalesce((mean - mu) / nullif(sd, 0), 0) AS z FROM m JOIN s USING (feature)),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY z DESC, feature) AS top_rank,
 row_number() OVER (PARTITION BY cluster ORDER BY z, feature) AS bottom_rank FROM z)
SELECT * FROM r WHERE top_rank <= 3 OR bottom_rank <= 3""", doubles="mean z")
def a21(spark, sf):
    long = T.object_long(spark, sf).select(
        F.col("well").alias("cluster"), F.concat_ws("_", "organelle", "feature").alias("feature"), "value"
    )
    return S.cluster_profiles(long, n_features=8, n_ends=3).select(
        "cluster", "feature", "mean", "z", F.col("top_rank").cast("long"), F.col("bottom_rank").cast("long")
    )


@query("a26_timing_summary", f"""WITH {T.OBJECTS} SELECT 'area' AS task, sum(area) AS total, avg(area) AS mean, max(area) AS slowest FROM objects
 UNION ALL SELECT 'extent', sum(extent), avg(extent), max(extent) FROM objects""", doubles="total mean slowest", digits=4)
def a26(spark, sf):
    return S.timing_summary(T.objects(spark, sf), ["area", "extent"])


@query("a27_reporter_stats", f"""WITH {T.GENE_CELLS}, reports AS (SELECT batch AS signal, string_agg(DISTINCT well, ',') AS experiment, count(*) AS n_cells
 FROM gene_cells GROUP BY batch), e AS (SELECT signal, trim(unnest(string_split(experiment, ','))) AS e FROM reports),
x AS (SELECT signal, string_agg(DISTINCT e, ',' ORDER BY e) AS experiments FROM e GROUP BY signal)
SELECT r.signal, CAST(r.n_cells AS BIGINT) AS n_cells, experiments, r.signal || ' (' || format('{{:,}}', r.n_cells) || ' cells)' AS display
 FROM reports r JOIN x USING (signal)""")
def a27(spark, sf):
    reports = T.gene_cells(spark, sf).groupBy(F.col("batch").alias("signal")).agg(
        F.array_join(F.collect_set("well"), ",").alias("experiment"), F.count(F.lit(1)).alias("n_cells")
    )
    return S.reporter_stats(reports)


@query("a29_gene_area_variance", f"""WITH {T.GENE_CELLS}, c AS (SELECT gene, guide, cell_area / 1000 AS area FROM gene_cells), top AS (SELECT gene, var_samp(area) AS gene_variance FROM c
 GROUP BY gene ORDER BY gene_variance DESC, gene LIMIT 5), p AS (SELECT gene, guide, var_samp(area) AS guide_variance,
 count(*) AS n_cells FROM c GROUP BY 1, 2) SELECT p.*, gene_variance FROM p JOIN top USING (gene)""",
    doubles="gene_variance guide_variance")
def a29(spark, sf):
    c = T.gene_cells(spark, sf).withColumn("area", F.col("cell_area") / 1000)
    return S.gene_area_variance(c, "gene", "guide", "area")


@query("a30_property_distribution", f"""WITH {T.OBJECT_ROWS}, c AS (SELECT cell_id, CASE WHEN gene = '0' THEN 'NTC' ELSE 'Perturbed' END AS gene_group,
 avg(area) AS area FROM object_rows GROUP BY 1, 2), r AS (SELECT min(area) AS lo, max(area) AS hi FROM c),
b AS (SELECT gene_group, CAST(least(49, floor((area - lo) / ((hi - lo) / 50))) AS INTEGER) AS bin, (hi - lo) / 50 AS w FROM c, r),
n AS (SELECT gene_group, bin, count(*) AS n, any_value(w) AS w FROM b GROUP BY 1, 2)
SELECT gene_group, bin, n, n / (sum(n) OVER (PARTITION BY gene_group) * w) AS density FROM n""", doubles="density")
def a30(spark, sf):
    from screenforge.functions.scalars import gene_group

    rows = T.object_rows(spark, sf).withColumn("gene_group", gene_group(is_control_by_name(F.col("gene"))))
    per = rows.groupBy("cell_id", "gene_group").agg(F.avg("area").alias("area"))
    return S.histogram(per, ["gene_group"], "area", 50)


@query("a31_metric_comparison", f"""WITH {T.OBJECT_LONG} SELECT organelle, feature, CASE WHEN gene = '0' THEN 'NTC' ELSE 'Perturbed' END AS gene_group,
 quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75
 FROM object_long GROUP BY 1, 2, 3""", doubles="q25 q50 q75", digits=4)
def a31(spark, sf):
    from screenforge.functions.scalars import gene_group

    long = T.object_long(spark, sf).withColumn("gene_group", gene_group(is_control_by_name(F.col("gene"))))
    out = S.metric_comparison(long, ["organelle", "feature", "gene_group"], [0.25, 0.5, 0.75])
    q = F.col("quantiles")
    return out.select("organelle", "feature", "gene_group", q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"))


@query("a32_clustermap_means", f"""WITH {T.OBJECT_LONG} SELECT gene, feature, avg(value) AS mean FROM object_long GROUP BY 1, 2""",
    doubles="mean", digits=4)
def a32(spark, sf):
    return T.object_long(spark, sf).groupBy("gene", "feature").agg(F.avg("value").alias("mean"))


@query("a33_stage_metrics", f"""WITH {T.CELLS}, {T.GUIDES}, q AS (SELECT 'n_rows' AS metric, count(*) AS value FROM cells),
 c AS (SELECT 'n_' || batch AS metric, count(*) AS value FROM guides GROUP BY batch)
 SELECT 'cell' AS level, 'qc' AS stage, 'qc_' || metric AS metric, CAST(value AS DOUBLE) AS value FROM q
 UNION ALL SELECT 'cell', 'clust', 'clust_' || metric, CAST(value AS DOUBLE) FROM c""", doubles="value")
def a33(spark, sf):
    qc = T.cells(spark, sf).agg(F.count(F.lit(1)).alias("value")).select(F.lit("n_rows").alias("metric"), "value")
    clust = T.guides(spark, sf).groupBy(F.concat(F.lit("n_"), "batch").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    return S.prefixed_metrics({"qc": qc, "clust": clust}, "cell")


@query("a37_extreme_genes", f"""WITH {T.OBJECT_LONG}, g AS (SELECT feature, gene, avg(value) AS mean, count(value) AS n_rows FROM object_long
 GROUP BY 1, 2 HAVING count(value) >= 3), h AS (SELECT *, 'high' AS side, row_number() OVER (PARTITION BY feature ORDER BY mean DESC, gene) AS rank FROM g),
 l AS (SELECT *, 'low' AS side, row_number() OVER (PARTITION BY feature ORDER BY mean, gene) AS rank FROM g)
 SELECT * FROM h WHERE rank <= 5 UNION ALL SELECT * FROM l WHERE rank <= 5""", doubles="mean", digits=4)
def a37(spark, sf):
    return S.extreme_genes(T.object_long(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


@query("a38_cluster_centroids", f"""WITH {T.SPATIAL} SELECT well, avg(x) AS x, avg(y) AS y, count(*) AS n FROM spatial WHERE well <> 'error' GROUP BY well""",
    doubles="x y")
def a38(spark, sf):
    return S.centroids(T.spatial(spark, sf), "well", "x", "y", noise="error")


@query("a39_fragment_features", f"""WITH {T.BRANCHES}, f AS (SELECT cell_id, organelle, skeleton_id, count(*) AS n, sum(branch_length) AS total,
 avg(branch_length) AS mean_length FROM branches GROUP BY 1, 2, 3) SELECT cell_id, organelle, CAST(sum(n) AS BIGINT) AS n_branches, sum(total) AS total_length,
 avg(mean_length) AS mean_length, count(*) AS n_fragments FROM f GROUP BY 1, 2""", doubles="total_length mean_length")
def a39(spark, sf):
    from screenforge.operators.graph import fragments_to_objects, skeleton_summary

    return fragments_to_objects(skeleton_summary(T.branches(spark, sf), ["cell_id", "organelle", "skeleton_id"]), ["cell_id", "organelle"])
