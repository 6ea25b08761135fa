"""Predicates, deduplication, sampling and set operations, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenforge.functions import scalars as X
from screenforge.operators import longform as LF
from screenforge.operators import records as R
from screenforge.operators import summaries as S
from screenforge.operators import skew as K
from screenforge.plans import tables as T
from screenforge.plans.registry import query

H = "CAST('0x' || substr(md5(CAST({0} AS VARCHAR) || '|42'), 1, 15) AS BIGINT)"

# records with gaps, from the orders table
RAW = f"""{T.CELLS}, raw AS (SELECT cell_id, well, CASE WHEN cell_id % 7 <> 0 THEN segmentation_id END AS segmentation_id,
 CASE WHEN cell_id % 5 = 0 THEN cell_id END AS cp_seg, CASE WHEN cell_id % 11 = 0 THEN '' WHEN cell_id % 13 = 0 THEN 'None'
 WHEN cell_id % 17 <> 0 THEN CAST(guide AS VARCHAR) END AS sgrna,
 CASE WHEN cell_id % 4 <> 0 THEN [0, 0, CAST(cell_id % 97 AS INTEGER) + 1, CAST(cell_id % 89 AS INTEGER) + 1] END AS bbox,
 CASE WHEN cell_id % 3 = 0 THEN [1, 1, CAST(cell_id % 53 AS INTEGER) + 2, CAST(cell_id % 59 AS INTEGER) + 2] END AS cp_bbox, cell_area FROM cells)"""


def raw(spark, sf):
    i = F.col("cell_id")
    m = lambda n: (i % n).cast("int")
    box = lambda lo, a, b: F.array(F.lit(lo), F.lit(lo), m(a) + lo + 1, m(b) + lo + 1)
    return T.cells(spark, sf).select(
        "cell_id", "well", F.when(i % 7 != 0, F.col("segmentation_id")).alias("segmentation_id"),
        F.when(i % 5 == 0, i).alias("cp_seg"),
        F.when(i % 11 == 0, "").when(i % 13 == 0, "None").when(i % 17 != 0, F.col("guide").cast("string")).alias("sgrna"),
        F.when(i % 4 != 0, box(0, 97, 89)).alias("bbox"), F.when(i % 3 == 0, box(1, 53, 59)).alias("cp_bbox"), "cell_area",
    )


@query("p1_feature_columns", """SELECT 'l_quantity' AS feature, count(l_quantity) AS n FROM lineitem UNION ALL SELECT 'l_extendedprice', count(l_extendedprice) FROM lineitem
 UNION ALL SELECT 'l_discount', count(l_discount) FROM lineitem UNION ALL SELECT 'l_tax', count(l_tax) FROM lineitem""")
def p1(spark, sf):
    df = T.read(spark, sf, "lineitem")
    cols = LF.feature_columns(df, [*X.METADATA_PATTERNS, "key", "linenumber"])
    return df.select(*cols).unpivot([], cols, "feature", "value").groupBy("feature").agg(F.count("value").alias("n"))


@query("p2_feature_columns_by_prefix", """SELECT 'l_quantity' AS feature, count(*) AS n FROM lineitem UNION ALL SELECT 'l_extendedprice', count(*) FROM lineitem
 UNION ALL SELECT 'l_discount', count(*) FROM lineitem UNION ALL SELECT 'l_tax', count(*) FROM lineitem""")
def p2(spark, sf):
    df = T.read(spark, sf, "lineitem")
    cols = LF.feature_columns_by_prefix(df, ["l"], ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
    return df.select(*cols).unpivot([], cols, "feature", "value").groupBy("feature").agg(F.count("value").alias("n"))


@query("p3_control_masks", f"""WITH {RAW}, m AS (SELECT CASE WHEN cell_id % 19 = 0 THEN 'NTC_' || well WHEN cell_id % 23 = 0 THEN '0' WHEN cell_id % 29 = 0 THEN 'Non-Targeting'
 ELSE sgrna END AS gene, cell_id % 31 - 1 AS gene_id, CASE WHEN cell_id % 37 = 0 THEN 'ntc7' ELSE 'ACGT' END AS barcode FROM raw),
f AS (SELECT *, coalesce(regexp_matches(gene, '(?i)ntc|non-targeting|^0$'), false) AS rx, gene_id = -1 OR gene IS NULL OR trim(gene) IN ('', 'None') AS other FROM m)
SELECT count(*) FILTER (rx OR other) AS stage, count(*) FILTER (rx) AS analyser, count(*) FILTER (regexp_matches(gene, '(?i)ntc|non-targeting')) AS legacy,
 count(*) FILTER (rx OR other OR upper(barcode) LIKE 'NTC%') AS with_barcode, count(*) FILTER (gene = '0') AS relabelled FROM f""")
def p3(spark, sf):
    i = F.col("cell_id")
    m = raw(spark, sf).select(
        F.when(i % 19 == 0, F.concat(F.lit("NTC_"), "well")).when(i % 23 == 0, "0").when(i % 29 == 0, "Non-Targeting").otherwise(F.col("sgrna")).alias("gene"),
        (i % 31 - 1).alias("gene_id"), F.when(i % 37 == 0, "ntc7").otherwise("ACGT").alias("barcode"),
    )
    g = F.col("gene")
    renamed = (X.relabel_control(g) == "NTC") & (g != "NTC")
    return m.agg(
        F.count_if(X.is_control(g, F.col("gene_id"))).alias("stage"), F.count_if(X.is_control_by_name(g)).alias("analyser"),
        F.count_if(X.is_control_by_name(g, legacy=True)).alias("legacy"),
        F.count_if(X.is_control(g, F.col("gene_id"), barcode=F.col("barcode"))).alias("with_barcode"),
        F.count_if(renamed).alias("relabelled"),
    )


@query("p4_valid_guides", f"""WITH {RAW} SELECT cell_id, sgrna FROM raw WHERE sgrna IS NOT NULL AND sgrna NOT IN ('', 'None')""")
def p4(spark, sf):
    return raw(spark, sf).where(X.has_guide(F.col("sgrna"))).select("cell_id", "sgrna")


@query("p5_coverage_counts", f"""WITH {RAW}, f AS (SELECT bbox IS NOT NULL AND segmentation_id IS NOT NULL AS s, cp_bbox IS NOT NULL AND cp_seg IS NOT NULL AS c FROM raw)
SELECT count(*) FILTER (s AND c) AS n_both, count(*) FILTER (s AND NOT c) AS n_std_only, count(*) FILTER (NOT s AND c) AS n_cp_only,
 count(*) FILTER (NOT s AND NOT c) AS n_neither FROM f""")
def p5(spark, sf):
    return R.coverage_counts(R.coverage(raw(spark, sf), "bbox", "segmentation_id", "cp_bbox", "cp_seg"))


@query("p6_high_variance_features", f"""WITH {T.OBJECT_LONG}, v AS (SELECT organelle || '_' || feature AS feature, var_samp(value) AS variance FROM object_long GROUP BY 1)
SELECT feature, variance FROM v WHERE variance >= (SELECT greatest(quantile_cont(variance, 0.05), 1e-8) FROM v)""", doubles="variance", digits=3)
def p6(spark, sf):
    return S.high_variance_features(T.object_long(spark, sf).withColumn("feature", F.concat_ws("_", "organelle", "feature")))


@query("p6_fixed_threshold", f"""WITH {T.OBJECT_LONG} SELECT feature, var_samp(value) AS variance FROM object_long GROUP BY 1 HAVING var_samp(value) >= 1e-3""",
    doubles="variance", digits=3)
def p6f(spark, sf):
    return S.high_variance_features(T.object_long(spark, sf), fixed=1e-3)


@query("p7_control_variance_features", f"""WITH {T.OBJECT_LONG} SELECT feature, stddev_samp(value) AS control_std FROM object_long WHERE gene = '0' GROUP BY 1
 HAVING stddev_samp(value) > 1e-6""", doubles="control_std", digits=4)
def p7(spark, sf):
    c = T.object_long(spark, sf).where(X.is_control_by_name(F.col("gene")))
    return c.groupBy("feature").agg(F.stddev_samp("value").alias("control_std")).where(F.col("control_std") > 1e-6)


@query("p8_harmonised_columns", f"""WITH {RAW} SELECT well, coalesce(sgrna, CAST(cp_seg AS VARCHAR)) AS gene_name, count(*) AS n FROM raw GROUP BY 1, 2""")
def p8(spark, sf):
    df = raw(spark, sf).select(
        F.col("well").alias("well_x"), F.col("well").alias("well_y"), F.col("sgrna").alias("gene_name"),
        F.col("cp_seg").cast("string").alias("perturbation"),
    )
    df = R.harmonise_columns(df, {"well_x": "well", "perturbation": "gene_name"}, ["well_y"])
    return df.groupBy("well", "gene_name").agg(F.count(F.lit(1)).alias("n"))


@query("p9_finite_values", """SELECT l_returnflag AS organelle, count(CASE WHEN l_discount > 0 AND l_tax > 0 THEN 1 END) AS n_finite,
 avg(CASE WHEN l_discount > 0 AND l_tax > 0 THEN l_tax / l_discount END) AS mean FROM lineitem GROUP BY 1""", doubles="mean")
def p9(spark, sf):
    o = T.objects(spark, sf)
    ratio = F.when(F.col("extent") > 0, F.col("eccentricity") / F.nullif(F.col("extent"), F.lit(0.0))).otherwise(F.lit(float("inf")))
    v = X.finite(F.when(F.col("eccentricity") > 0, ratio).otherwise(F.lit(float("nan"))))
    return o.groupBy("organelle").agg(F.count(v).alias("n_finite"), F.avg(v).alias("mean"))


@query("p10_zero_filled_features", f"""WITH {RAW} SELECT well, avg(coalesce(segmentation_id, 0)) AS mean_zero, avg(segmentation_id) AS mean_skip FROM raw GROUP BY 1""",
    doubles="mean_zero mean_skip")
def p10(spark, sf):
    long = LF.to_long(raw(spark, sf), ["well"], ["segmentation_id"], missing="zero").groupBy("well").agg(F.avg("value").alias("mean_zero"))
    skip = LF.to_long(raw(spark, sf), ["well"], ["segmentation_id"]).groupBy("well").agg(F.avg("value").alias("mean_skip"))
    return long.join(skip, "well")


@query("p11_drop_empty_columns", f"""WITH {RAW} SELECT cell_id, well, cp_seg FROM raw""")
def p11(spark, sf):
    df = raw(spark, sf).select("cell_id", "well", F.lit(None).cast("double").alias("nothing"), "cp_seg")
    return R.drop_all_null_columns(df)


@query("p12_internal_columns", """SELECT l_orderkey AS cell_id, sum(l_tax) AS _t_read, sum(l_discount) AS _t_measure FROM lineitem GROUP BY 1""",
    doubles="_t_read _t_measure")
def p12(spark, sf):
    o = T.objects(spark, sf).groupBy("cell_id").agg(
        F.sum("area").alias("area"), F.sum("eccentricity").alias("_t_read"), F.sum("extent").alias("_t_measure")
    )
    return R.split_internal(o, ["cell_id"])[1]


_NAMES_SQL = """names AS (SELECT DISTINCT CASE l_linenumber % 7 WHEN 0 THEN 'cp1_nuclei_' WHEN 1 THEN 'phase2d_tubular_' WHEN 2 THEN 'cp2_actin_' WHEN 3 THEN 'network_cp1_nuclei_'
 WHEN 4 THEN 'cell_' WHEN 5 THEN 'cp_cell_' ELSE 'other_' END || CASE l_returnflag WHEN 'A' THEN 'area' WHEN 'N' THEN 'intensity_max' ELSE 'branch_length' END
 || CASE l_linestatus WHEN 'F' THEN '_mean' ELSE '_std' END AS feature FROM lineitem)"""


def names(spark, sf):
    k = F.col("l_linenumber") % 7
    head = F.lit("other_")
    for i, p in enumerate(["cp1_nuclei_", "phase2d_tubular_", "cp2_actin_", "network_cp1_nuclei_", "cell_", "cp_cell_"]):
        head = F.when(k == i, p).otherwise(head)
    metric = F.when(F.col("l_returnflag") == "A", "area").when(F.col("l_returnflag") == "N", "intensity_max").otherwise("branch_length")
    agg = F.when(F.col("l_linestatus") == "F", "_mean").otherwise("_std")
    return T.read(spark, sf, "lineitem").select(F.concat(head, metric, agg).alias("feature")).distinct()


_ORGS = ["cp1_nuclei", "phase2d_tubular", "cp2_actin"]
_PARSED_SQL = f"""{_NAMES_SQL}, p AS (SELECT feature, regexp_extract(regexp_replace(feature, '^network_', ''), '_(mean|std)$', 1) AS agg,
 regexp_replace(regexp_replace(feature, '^network_', ''), '_(mean|std)$', '') AS rest FROM names),
o AS (SELECT *, CASE WHEN rest LIKE 'phase2d\\_tubular\\_%' ESCAPE '\\' THEN 'phase2d_tubular' WHEN rest LIKE 'cp1\\_nuclei\\_%' ESCAPE '\\' THEN 'cp1_nuclei'
 WHEN rest LIKE 'cp2\\_actin\\_%' ESCAPE '\\' THEN 'cp2_actin' END AS org FROM p),
parsed AS (SELECT feature, CASE WHEN feature LIKE 'cell\\_%' ESCAPE '\\' THEN 'cell' WHEN feature LIKE 'cp\\_cell\\_%' ESCAPE '\\' THEN 'cp_cell' ELSE org END AS organelle,
 CASE WHEN feature LIKE 'cell\\_%' ESCAPE '\\' THEN substr(feature, 6) WHEN feature LIKE 'cp\\_cell\\_%' ESCAPE '\\' THEN substr(feature, 9)
  WHEN org IS NULL THEN rest ELSE substr(rest, length(org) + 2) END AS metric,
 CASE WHEN feature LIKE 'cell\\_%' ESCAPE '\\' OR feature LIKE 'cp\\_cell\\_%' ESCAPE '\\' THEN 'cell_morphology' WHEN feature LIKE 'network\\_%' ESCAPE '\\' THEN 'network'
  WHEN org IS NULL THEN 'unknown' WHEN rest LIKE '%intensity%' THEN 'intensity' ELSE 'morphology' END AS category,
 CASE WHEN feature LIKE 'cell\\_%' ESCAPE '\\' OR feature LIKE 'cp\\_cell\\_%' ESCAPE '\\' THEN NULL ELSE agg END AS aggregation FROM o)"""


def parsed(spark, sf):
    return names(spark, sf).select("feature", X.parse_feature(F.col("feature"), _ORGS).alias("p")).select("feature", "p.*")


@query("f1_parse_feature_names", f"WITH {_PARSED_SQL} SELECT * FROM parsed")
def f1(spark, sf):
    return parsed(spark, sf)


@query("f2_metric_units", f"""WITH {_PARSED_SQL} SELECT feature, CASE metric WHEN 'area' THEN 'um^2' WHEN 'branch_length' THEN 'um' WHEN 'intensity_max' THEN 'AU'
 ELSE 'unknown' END AS unit FROM parsed""")
def f2(spark, sf):
    return parsed(spark, sf).select("feature", X.metric_unit(F.col("metric")).alias("unit"))


@query("p13_fixed_stain_features", f"""WITH {_PARSED_SQL} SELECT feature, organelle FROM parsed WHERE organelle IN ('cell', 'cp_cell')
 OR regexp_matches(organelle, '^cp[12]_') AND NOT regexp_matches(organelle, 'phase2d_|focus3d_')""")
def p13(spark, sf):
    return LF_fixed(parsed(spark, sf)).select("feature", "organelle")


def LF_fixed(meta):
    from screenforge.operators.joins import fixed_stain_features

    return fixed_stain_features(meta)


@query("p14_global_id", f"""WITH {RAW} SELECT cell_id, CASE WHEN segmentation_id IS NOT NULL THEN well || '_' || segmentation_id
 WHEN cp_seg IS NOT NULL THEN well || '_cp' || cp_seg END AS global_id FROM raw""")
def p14(spark, sf):
    return raw(spark, sf).select("cell_id", X.global_id(F.col("well"), F.col("segmentation_id"), F.col("cp_seg")).alias("global_id"))


@query("p15_gene_groups", f"""WITH {T.GUIDES} SELECT CASE WHEN gene = '0' THEN 'NTC' ELSE 'Perturbed' END AS gene_group, count(*) AS n FROM guides GROUP BY 1""")
def p15(spark, sf):
    g = T.guides(spark, sf).withColumn("gene_group", X.gene_group(X.is_control_by_name(F.col("gene"))))
    return S.value_counts(g, "gene_group")


@query("p16_network_organelles", f"""WITH {_PARSED_SQL} SELECT DISTINCT organelle, organelle NOT SIMILAR TO '.*(cell_mask|cell_seg|cp_cell|nuclear|nuclei|nucleoli|vesicular).*'
 AND (organelle LIKE '%tubular%' OR organelle SIMILAR TO 'cp[12]_.*') AS network FROM parsed WHERE organelle IS NOT NULL""")
def p16(spark, sf):
    return parsed(spark, sf).where(F.col("organelle").isNotNull()).select("organelle", X.is_network_organelle(F.col("organelle")).alias("network")).distinct()


_STATS_SQL = f"""{T.OBJECT_LONG}, c AS (SELECT feature, avg(value) AS mu, stddev_samp(value) AS sd FROM object_long WHERE gene = '0' GROUP BY 1),
stats AS (SELECT gene || '_' || o.feature AS feature, (avg(value) - any_value(mu)) / any_value(sd) * sqrt(count(value)) AS z, 1.0 / count(value) AS p_adj FROM object_long o JOIN c USING (feature) WHERE gene <> '0' GROUP BY gene, o.feature)"""


def gene_stats(spark, sf):
    from screenforge.operators.stats import gene_z

    z = gene_z(T.object_long(spark, sf), X.is_control_by_name(F.col("gene")))
    return z.select(F.concat_ws("_", "gene", "feature").alias("feature"), (F.col("z") * F.sqrt("n")).alias("z"), (F.lit(1.0) / F.col("n")).alias("p_adj"))


@query("p17_hits", f"""WITH {_STATS_SQL} SELECT feature, z, p_adj, row_number() OVER (ORDER BY abs(z) DESC, feature) AS rank FROM stats WHERE abs(z) > 1 AND p_adj < 0.05""", doubles="z p_adj")
def p17(spark, sf):
    return R.hits(gene_stats(spark, sf), z_min=1.0)


@query("p17_hits_fallback", f"""WITH {_STATS_SQL} SELECT feature, z, p_adj, row_number() OVER (ORDER BY abs(z) DESC, feature) AS rank FROM stats QUALIFY rank <= 20""", doubles="z p_adj")
def p17f(spark, sf):
    return R.hits(gene_stats(spark, sf), p_max=0.0)


@query("p18_missing_labels", f"""WITH {T.OBJECTS}, h AS (SELECT DISTINCT cell_id, organelle FROM objects), e AS (SELECT organelle FROM h WHERE cell_id = (SELECT min(cell_id) FROM h))
SELECT c.cell_id, e.organelle FROM (SELECT DISTINCT cell_id FROM h) c CROSS JOIN e ANTI JOIN h ON h.cell_id = c.cell_id AND h.organelle = e.organelle""")
def p18(spark, sf):
    return R.missing_labels(T.objects(spark, sf).select("cell_id", "organelle"), "cell_id", "organelle")


@query("p19_named_genes", f"""WITH {RAW} SELECT sgrna AS gene, count(*) AS n FROM raw WHERE sgrna IS NOT NULL AND sgrna <> 'None' GROUP BY 1""")
def p19(spark, sf):
    return raw(spark, sf).where(F.col("sgrna").isNotNull() & (F.col("sgrna") != "None")).groupBy(F.col("sgrna").alias("gene")).agg(F.count(F.lit(1)).alias("n"))


@query("p20_minimum_support", f"""WITH {T.GENE_CELLS}, g AS (SELECT gene, guide, count(*) AS n_cells FROM gene_cells GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT gene, count(*) AS n_guides, CAST(sum(n_cells) AS BIGINT) AS n_cells FROM g GROUP BY 1 HAVING count(*) >= 2""")
def p20(spark, sf):
    g = T.gene_cells(spark, sf).groupBy("gene", "guide").agg(F.count(F.lit(1)).alias("n_cells")).where(F.col("n_cells") >= 3)
    out = g.groupBy("gene").agg(F.count(F.lit(1)).alias("n_guides"), F.sum("n_cells").alias("n_cells"))
    return out.where(F.col("n_guides") >= 2)


@query("p21_numeric_coercion", """SELECT event_type AS well, count(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS n_number, count(TRY_CAST(event_type AS DOUBLE)) AS n_bad,
 avg(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS mean FROM events GROUP BY 1""", doubles="mean")
def p21(spark, sf):
    e = T.read(spark, sf, "events")
    k = X.safe_number(F.get_json_object("props", "$.k"))
    return e.groupBy(F.col("event_type").alias("well")).agg(F.count(k).alias("n_number"), F.count(X.safe_number(F.col("event_type"))).alias("n_bad"), F.avg(k).alias("mean"))


@query("p24_level_feature_columns", f"""WITH {T.OBJECTS} SELECT cell_id, avg(area) AS area_mean FROM objects GROUP BY 1""", doubles="area_mean")
def p24(spark, sf):
    from screenforge.operators.levels import seven_stats

    df = seven_stats(T.objects(spark, sf), ["cell_id"], ["area"], ["mean", "count"])
    return df.select("cell_id", *LF.level_feature_columns(df, ["cell_id"]))


@query("p26_reporters_by_origin", f"""WITH {_NAMES_SQL} SELECT feature, CASE WHEN feature LIKE 'cp1\\_%' ESCAPE '\\' OR feature LIKE 'cp2\\_%' ESCAPE '\\' THEN 'CP_' || feature ELSE feature END AS reporter FROM names""")
def p26(spark, sf):
    from screenforge.operators.joins import mark_by_origin

    df = names(spark, sf).withColumn("channel", F.concat(F.lit("GFP,"), F.upper("feature")))
    return mark_by_origin(df, "feature", "channel").select("feature", "reporter")


@query("p27_log_colouring", f"""WITH {T.OBJECTS} SELECT cell_id, log10(greatest(sum(area), 1e-10) + 1) AS log_area FROM objects GROUP BY 1""", doubles="log_area")
def p27(spark, sf):
    return T.objects(spark, sf).groupBy("cell_id").agg(F.log10(F.greatest(F.sum("area"), F.lit(1e-10)) + 1).alias("log_area"))


@query("w1_dedupe_prefer_guide", f"""WITH {RAW} SELECT cell_id, well, segmentation_id, sgrna FROM raw WHERE segmentation_id IS NULL UNION ALL
SELECT cell_id, well, segmentation_id, sgrna FROM raw WHERE segmentation_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY well, segmentation_id
 ORDER BY CASE WHEN sgrna IS NOT NULL AND sgrna NOT IN ('', 'None') THEN 0 ELSE 1 END, cell_id) = 1""")
def w1(spark, sf):
    df = raw(spark, sf).select("cell_id", "well", "segmentation_id", "sgrna")
    return R.dedupe_prefer_guide(df, "well", "segmentation_id", "sgrna", "cell_id")


@query("w2_duplicate_keys", f"""WITH {RAW} SELECT well, segmentation_id, count(*) AS n_rows FROM raw WHERE segmentation_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1
 ORDER BY n_rows DESC, well, segmentation_id LIMIT 5""")
def w2(spark, sf):
    return R.duplicate_keys(raw(spark, sf), ["well", "segmentation_id"])


@query("w3_benjamini_hochberg", f"""WITH {T.OBJECTS}, t AS (SELECT organelle, cell_id, label, round((extent + eccentricity) / 2, 3) AS p FROM objects),
r AS (SELECT *, row_number() OVER (PARTITION BY organelle ORDER BY p) AS i, count(*) OVER (PARTITION BY organelle) AS m FROM t),
a AS (SELECT *, least(1.0, min(p * m / i) OVER (PARTITION BY organelle ORDER BY i DESC)) AS p_adj FROM r)
SELECT organelle, p, min(p_adj) AS p_adj, count(*) AS n FROM a GROUP BY 1, 2""", doubles="p p_adj")
def w3(spark, sf):
    t = T.objects(spark, sf).select("organelle", F.round((F.col("extent") + F.col("eccentricity")) / 2, 3).alias("p"))
    return K.bh_adjust(t, ["organelle"], "p").groupBy("organelle", "p").agg(F.min("p_adj").alias("p_adj"), F.count(F.lit(1)).alias("n"))


@query("w4_average_rank", f"""WITH {T.SPATIAL}, r AS (SELECT well, cell_id, rank() OVER (PARTITION BY well ORDER BY x) + (count(*) OVER (PARTITION BY well, x) - 1) / 2.0 AS rank FROM spatial)
SELECT * FROM r""", doubles="rank")
def w4(spark, sf):
    return K.average_rank(T.spatial(spark, sf).select("well", "cell_id", "x"), ["well"], "x", "rank").drop("x")


@query("w5_top_n_per_group", f"""WITH {T.GENE_CELLS} SELECT gene, cell_id, cell_area, row_number() OVER (PARTITION BY gene ORDER BY cell_area DESC, cell_id) AS rank FROM gene_cells QUALIFY rank <= 10""", doubles="cell_area")
def w5(spark, sf):
    t = K.top_n(T.gene_cells(spark, sf).select("gene", "cell_id", "cell_area"), ["gene"], [F.col("cell_area").desc(), F.col("cell_id")], 10)
    return t.withColumn("rank", F.col("rank").cast("long"))


@query("w6_arg_max", f"""WITH {T.GENE_CELLS} SELECT gene, arg_max(cell_id, (cell_area, cell_id)) AS top_cell, max(cell_area) AS area FROM gene_cells GROUP BY 1""", doubles="area")
def w6(spark, sf):
    return T.gene_cells(spark, sf).groupBy("gene").agg(F.max_by("cell_id", F.struct("cell_area", "cell_id")).alias("top_cell"), F.max("cell_area").alias("area"))


@query("e1_distinct_on_values", f"""WITH {T.OBJECTS} SELECT area, extent, min(cell_id * 100 + label) AS key FROM objects GROUP BY 1, 2""", doubles="area extent")
def e1(spark, sf):
    o = T.objects(spark, sf).select("area", "extent", (F.col("cell_id") * 100 + F.col("label")).alias("key"))
    return R.distinct_on_values(o, ["area", "extent"], "key")


_AB = f"""{T.GENE_CELLS}, a AS (SELECT DISTINCT gene, guide FROM gene_cells WHERE cell_area > 400000), b AS (SELECT DISTINCT gene, guide FROM gene_cells WHERE status = 'P')"""


def _ab(spark, sf):
    c = T.gene_cells(spark, sf)
    return c.where("cell_area > 400000").select("gene", "guide"), c.where("status = 'P'").select("gene", "guide")


@query("e2_common_genes", f"WITH {_AB} SELECT gene, guide FROM a INTERSECT SELECT gene, guide FROM b")
def e2(spark, sf):
    a, b = _ab(spark, sf)
    return a.intersect(b)


@query("e3_pooled_rows", f"WITH {_AB}, u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT gene, count(*) AS n FROM u GROUP BY 1")
def e3(spark, sf):
    a, b = _ab(spark, sf)
    return a.distinct().unionByName(b.distinct()).groupBy("gene").agg(F.count(F.lit(1)).alias("n"))


@query("e4_only_left", f"WITH {_AB} SELECT gene, guide FROM a EXCEPT SELECT gene, guide FROM b")
def e4(spark, sf):
    a, b = _ab(spark, sf)
    return a.distinct().join(b.distinct(), ["gene", "guide"], "left_anti")


@query("e5_jaccard", f"""WITH {_AB}, j AS (SELECT coalesce(a.gene, b.gene) AS gene, a.guide AS x, b.guide AS y FROM a FULL JOIN b USING (gene, guide))
SELECT gene, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_both, count(*) AS n_union, n_both / count(*) AS jaccard FROM j GROUP BY 1""", doubles="jaccard")
def e5(spark, sf):
    return R.jaccard(*_ab(spark, sf), "guide", ["gene"])


@query("e6_overlap_classes", f"""WITH {T.GENE_CELLS}, a AS (SELECT guide, avg(cell_area) > 250000 AS f FROM gene_cells WHERE status <> 'P' GROUP BY 1), b AS (SELECT guide, avg(cell_area) > 250000 AS f
 FROM gene_cells WHERE status = 'P' GROUP BY 1) SELECT guide, CASE WHEN coalesce(a.f, false) AND coalesce(b.f, false) THEN 'both' WHEN coalesce(a.f, false) THEN 'a_only'
 WHEN coalesce(b.f, false) THEN 'b_only' ELSE 'neither' END AS overlap FROM a FULL JOIN b USING (guide)""")
def e6(spark, sf):
    c = T.gene_cells(spark, sf)
    side = lambda cond: c.where(cond).groupBy("guide").agg((F.avg("cell_area") > 250000).alias("f"))
    return R.overlap_classes(side("status <> 'P'"), side("status = 'P'"), ["guide"], "f")


@query("k1_order_by_effect", f"""WITH {_STATS_SQL} SELECT feature, z, row_number() OVER (ORDER BY abs(z) DESC, feature) AS rank FROM stats ORDER BY rank LIMIT 25""", doubles="z")
def k1(spark, sf):
    s = R.hits(gene_stats(spark, sf), z_min=-1.0, p_max=2.0)
    return s.where("rank <= 25").select("feature", "z", "rank")


@query("k2_up_down_lists", f"""WITH {_STATS_SQL}, s AS (SELECT regexp_replace(feature, '^[0-9]+_', '') AS f, feature, z FROM stats),
u AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY z DESC, feature) AS rank, 'up' AS direction FROM s WHERE z > 0),
d AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY z, feature) AS rank, 'down' AS direction FROM s WHERE z < 0),
b AS (SELECT * FROM u WHERE rank <= 6 UNION ALL SELECT * FROM d WHERE rank <= 6)
SELECT * FROM b QUALIFY count(*) OVER (PARTITION BY f, direction) >= 5""", doubles="z")
def k2(spark, sf):
    s = gene_stats(spark, sf).select(F.regexp_replace("feature", "^[0-9]+_", "").alias("f"), "feature", "z")
    return R.up_down_lists(s, ["f"], "z", "feature", n=6).withColumn("rank", F.col("rank").cast("long"))


@query("k4_spatial_batches", f"""WITH {T.SPATIAL}, s AS (SELECT cell_id, well, CASE WHEN cell_id % 50 <> 0 THEN x * 20 END AS x, CASE WHEN cell_id % 50 <> 0 THEN y END AS y FROM spatial),
r AS (SELECT cell_id, well, row_number() OVER (PARTITION BY well ORDER BY floor(coalesce(y, 999999) / 512), floor(coalesce(x, 999999) / 512), coalesce(y, 999999), coalesce(x, 999999), cell_id) - 1 AS position FROM s)
SELECT cell_id, position, well || '_' || lpad(CAST(position // 300 AS VARCHAR), 4, '0') AS batch_id FROM r""")
def k4(spark, sf):
    i = F.col("cell_id") % 50 != 0
    s = T.spatial(spark, sf).select("cell_id", "well", F.when(i, F.col("x") * 20).alias("x"), F.when(i, F.col("y")).alias("y"))
    return R.spatial_batches(s, "well", "x", "y", "cell_id", 300).select("cell_id", "position", "batch_id")


@query("k5_equalised_sides", f"""WITH {T.CELLS}, n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM cells GROUP BY status))
SELECT cell_id, status FROM cells QUALIFY row_number() OVER (PARTITION BY status ORDER BY {H.format("cell_id")}) <= (SELECT n FROM n)""")
def k5(spark, sf):
    return R.equalise(T.cells(spark, sf).select("cell_id", "status"), "status", "cell_id")


@query("k6_proportional_sample", f"""WITH {T.CELLS}, c AS (SELECT *, CASE WHEN cell_id % 100 = 0 THEN 'rare' ELSE well END AS signal FROM cells),
q AS (SELECT signal, least(count(*), greatest(100, CAST(round_even(count(*) / (SELECT count(*) FROM c) * 2000, 0) AS BIGINT))) AS n_take FROM c GROUP BY 1)
SELECT cell_id, signal FROM c JOIN q USING (signal) QUALIFY row_number() OVER (PARTITION BY signal ORDER BY {H.format("cell_id")}) <= n_take""")
def k6(spark, sf):
    c = T.cells(spark, sf).select("cell_id", F.when(F.col("cell_id") % 100 == 0, "rare").otherwise(F.col("well")).alias("signal"))
    return R.proportional_sample(c, "signal", "cell_id", 2000)


@query("k7_objects_per_cell", f"""WITH {T.OBJECTS}, o AS (SELECT DISTINCT cell_id, organelle, label, area FROM objects) SELECT cell_id, count(*) AS n FROM
 (SELECT cell_id FROM o QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY {H.format("cell_id || organelle || label || '_' || area")}) <= 3) GROUP BY 1""")
def k7(spark, sf):
    o = T.objects(spark, sf).select("cell_id", "organelle", "label", "area").distinct()
    label = F.concat_ws("_", "cell_id", "organelle", "label", "area")
    return R.objects_per_cell(o, "cell_id", label, 3).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))


@query("k8_balanced_sample", f"""WITH {T.CELLS} SELECT cell_id, well FROM cells QUALIFY row_number() OVER (PARTITION BY well ORDER BY {H.format("cell_id")}) <=
 1001 // (SELECT count(DISTINCT well) FROM cells)""")
def k8(spark, sf):
    return R.balanced_sample(T.cells(spark, sf).select("cell_id", "well"), "well", "cell_id", 1001)


@query("k9_fraction_sample", f"""WITH {T.CELLS} SELECT cell_id FROM cells WHERE {H.format("cell_id")} < {int(0.1 * (1 << 60))}""")
def k9(spark, sf):
    return R.fraction_sample(T.cells(spark, sf).select("cell_id"), "cell_id", 0.1)


@query("k10_size_capped_sample", f"""WITH {T.CELLS} SELECT cell_id FROM cells ORDER BY {H.format("cell_id")} LIMIT 500""")
def k10(spark, sf):
    return R.capped_sample(T.cells(spark, sf).select("cell_id"), "cell_id", 500)


@query("k11_complexity_split", f"""WITH {RAW}, f AS (SELECT cell_id, bbox IS NOT NULL AND segmentation_id IS NOT NULL AS s, cp_bbox IS NOT NULL AND cp_seg IS NOT NULL AS c,
 CAST(greatest(coalesce((bbox[3] - bbox[1]) * (bbox[4] - bbox[2]), 0), coalesce((cp_bbox[3] - cp_bbox[1]) * (cp_bbox[4] - cp_bbox[2]), 0)) AS DOUBLE) AS area FROM raw),
z AS (SELECT cell_id, CASE WHEN s AND c THEN 50.0::DOUBLE ELSE 0 END + area / (SELECT max(area) FROM f) * 20 + CASE WHEN s OR c THEN 15 ELSE 0 END AS score FROM f)
SELECT cell_id, score, CASE WHEN score <= (SELECT quantile_cont(score, 0.4) FROM z) THEN 'simple' ELSE 'complex' END AS route FROM z""", doubles="score")
def k11(spark, sf):
    return R.complexity(raw(spark, sf), "bbox", "segmentation_id", "cp_bbox", "cp_seg", 3).select("cell_id", "score", "route")


@query("k12_embedding_outliers", f"""WITH {T.SPATIAL}, c AS (SELECT avg(x) AS cx, avg(y) AS cy FROM spatial), d AS (SELECT cell_id, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS distance FROM spatial, c)
SELECT * FROM d WHERE distance > (SELECT quantile_cont(distance, 0.92) FROM d)""", doubles="distance")
def k12(spark, sf):
    return R.embedding_outliers(T.spatial(spark, sf).select("cell_id", "x", "y"), "x", "y").select("cell_id", "distance")


@query("k13_highlight_genes", f"""WITH {T.GENE_CELLS}, h AS (SELECT DISTINCT gene, {H.format("gene")} AS "order" FROM gene_cells WHERE gene <> '0') SELECT * FROM h ORDER BY 2, 1 LIMIT 7""")
def k13(spark, sf):
    return R.highlight_genes(T.gene_cells(spark, sf).where("gene <> '0'"), "gene", 7)
