"""Joins, sources and scalar functions, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenforge.functions import scalars as X
from screenforge.operators import joins as J
from screenforge.operators import summaries as S
from screenforge.plans import tables as T
from screenforge.plans.b_records import _NAMES_SQL, _ORGS, _PARSED_SQL, RAW, names, parsed, raw
from screenforge.plans.registry import query
from screenforge.sources import io as IO


@query("j1_features_metadata", f"""WITH {T.OBJECTS}, {T.CELLS}, f AS (SELECT cell_id, avg(area) AS area FROM objects GROUP BY 1)
SELECT CAST(cell_id AS VARCHAR) AS cell_id, area, well, guide FROM f LEFT JOIN cells USING (cell_id)""", doubles="area")
def j1(spark, sf):
    f = T.objects(spark, sf).groupBy("cell_id").agg(F.avg("area").alias("area"))
    return J.attach(f, T.cells(spark, sf).select("cell_id", "well", "guide"), "cell_id")


_THREE = ["A", "N", "R"]


@query("j2_aligned_frames", f"""WITH {T.OBJECTS} SELECT cell_id, sum(area) FILTER (organelle = 'A') AS a_area, sum(area) FILTER (organelle = 'N') AS n_area,
 max(extent) FILTER (organelle = 'R') AS r_extent FROM objects GROUP BY 1""", doubles="a_area n_area r_extent")
def j2(spark, sf):
    o = T.objects(spark, sf)
    one = lambda org, agg: o.where(F.col("organelle") == org).groupBy("cell_id").agg(agg)
    return J.align_frames([one("A", F.sum("area").alias("a_area")), one("N", F.sum("area").alias("n_area")), one("R", F.max("extent").alias("r_extent"))], "cell_id")


@query("j3_aggregates_first_metadata", f"""WITH {T.GENE_CELLS} SELECT guide, avg(cell_area) AS cell_area_mean, arg_min(well, cell_id) AS well, count(*) AS n_cells FROM gene_cells GROUP BY 1""", doubles="cell_area_mean", digits=4)
def j3(spark, sf):
    from screenforge.operators.levels import cells_to_guides

    return cells_to_guides(T.gene_cells(spark, sf), ["cell_area"], metadata=["well"], aggs=["mean"])


@query("j4_enrich_missing", f"""WITH {RAW}, {T.GUIDES}, l AS (SELECT CAST(guide % 1000 AS VARCHAR) AS sgrna, arg_max(batch, guide) AS batch FROM guides GROUP BY 1)
SELECT cell_id, coalesce(CASE WHEN cell_id % 2 = 0 THEN well END, l.batch) AS batch FROM raw LEFT JOIN l USING (sgrna)""")
def j4(spark, sf):
    df = raw(spark, sf).select("cell_id", "sgrna", F.when(F.col("cell_id") % 2 == 0, F.col("well")).alias("batch"))
    lookup = T.guides(spark, sf).select((F.col("guide") % 1000).cast("string").alias("sgrna"), "batch", "guide")
    return J.enrich_missing(df, lookup, "sgrna", ["batch"], "guide").select("cell_id", "batch")


@query("j7_before_after", f"""WITH {T.GENE_CELLS}, b AS (SELECT gene, avg(cell_area) AS score FROM gene_cells WHERE status = 'F' GROUP BY 1), a AS (SELECT gene, avg(cell_area) AS score FROM gene_cells WHERE status = 'O' GROUP BY 1)
SELECT gene, b.score AS score_before, a.score AS score_after, a.score - b.score AS delta FROM b JOIN a USING (gene)""", doubles="score_before score_after delta", digits=4)
def j7(spark, sf):
    c = T.gene_cells(spark, sf)
    side = lambda s: c.where(F.col("status") == s).groupBy("gene").agg(F.avg("cell_area").alias("score"))
    j = J.compare_methods(side("F"), side("O"), ["gene"], ("_before", "_after"))
    return j.withColumn("delta", F.col("score_after") - F.col("score_before"))


@query("j8_membership_filter", f"""WITH {T.GENE_CELLS}, {T.GENES} SELECT cell_id, gene FROM gene_cells WHERE gene IN (SELECT gene FROM genes WHERE set_id = 2)""")
def j8(spark, sf):
    wanted = T.genes(spark, sf).where("set_id = 2").select("gene")
    return T.gene_cells(spark, sf).join(wanted, "gene", "left_semi").select("cell_id", "gene")


@query("j9_exclusion_filter", f"""WITH {T.GENE_CELLS}, {T.GENES} SELECT cell_id, gene FROM gene_cells WHERE gene NOT IN (SELECT gene FROM genes WHERE set_id < 3)""")
def j9(spark, sf):
    out = T.genes(spark, sf).where("set_id < 3").select("gene")
    return T.gene_cells(spark, sf).join(out, "gene", "left_anti").select("cell_id", "gene")


@query("j11_grid_range_join", f"""WITH {T.SPATIAL} SELECT well, CAST(floor(x / 10) AS BIGINT) AS grid_x, CAST(floor(y / 60) AS BIGINT) AS grid_y, count(*) AS n, avg(f_k) AS mean FROM spatial GROUP BY 1, 2, 3""", doubles="mean")
def j11(spark, sf):
    g = J.grid_cells(T.spatial(spark, sf), ["well"], "x", "y", F.lit(10), F.lit(60))
    return g.groupBy("well", "grid_x", "grid_y").agg(F.count(F.lit(1)).alias("n"), F.avg("f_k").alias("mean"))


_CAT_SQL = f"""{T.GENES}, mapping AS (SELECT gene, 'set' || set_id AS category, 1 AS pass FROM genes UNION ALL SELECT gene, 'len' || length(gene), 2 FROM genes UNION ALL SELECT gene, 'even', 1 FROM genes WHERE CAST(gene AS INT) % 2 = 0)"""


def mapping(spark, sf):
    g = T.genes(spark, sf)
    a = g.select("gene", F.concat(F.lit("set"), "set_id").alias("category"), F.lit(1).alias("pass"))
    b = g.select("gene", F.concat(F.lit("len"), F.length("gene")).alias("category"), F.lit(2).alias("pass"))
    c = g.where(F.col("gene").cast("int") % 2 == 0).select("gene", F.lit("even").alias("category"), F.lit(1).alias("pass"))
    return a.unionByName(b).unionByName(c)


@query("j14_category_join_multiple", f"""WITH {_CAT_SQL}, {T.GENE_CELLS}, s AS (SELECT gene, count(*) AS n FROM gene_cells GROUP BY 1) SELECT gene, n, category, pass FROM s JOIN mapping USING (gene)""")
def j14(spark, sf):
    return J.category_join(T.gene_cells(spark, sf).groupBy("gene").agg(F.count(F.lit(1)).alias("n")), mapping(spark, sf))


@query("j14_category_join_single", f"""WITH {_CAT_SQL}, {T.GENE_CELLS}, s AS (SELECT gene, count(*) AS n FROM gene_cells GROUP BY 1),
m AS (SELECT * FROM mapping QUALIFY row_number() OVER (PARTITION BY gene ORDER BY pass, category) = 1) SELECT gene, n, category, pass FROM s JOIN m USING (gene)""")
def j14s(spark, sf):
    return J.category_join(T.gene_cells(spark, sf).groupBy("gene").agg(F.count(F.lit(1)).alias("n")), mapping(spark, sf), multiple=False)


@query("j15_feature_metadata_join", f"""WITH {_PARSED_SQL}, {T.OBJECTS} SELECT coalesce(organelle, '_unassigned') AS organelle, category, count(*) AS n_features FROM parsed GROUP BY 1, 2""")
def j15(spark, sf):
    n = names(spark, sf)
    return n.join(IO.feature_metadata(n, _ORGS), "feature").groupBy("organelle", "category").agg(F.count(F.lit(1)).alias("n_features"))


@query("j16_match_by_metric", f"""WITH {_PARSED_SQL}, l AS (SELECT metric, max(feature) AS left_feature FROM parsed WHERE organelle = 'cp1_nuclei' AND metric <> '' GROUP BY 1),
r AS (SELECT metric, max(feature) AS right_feature FROM parsed WHERE organelle = 'phase2d_tubular' AND metric <> '' GROUP BY 1) SELECT * FROM l JOIN r USING (metric)""")
def j16(spark, sf):
    p = parsed(spark, sf)
    return J.match_by_metric(p.where("organelle = 'cp1_nuclei'"), p.where("organelle = 'phase2d_tubular'"))


@query("j17_label_resolution", """WITH asked AS (SELECT DISTINCT p_name AS channel FROM part UNION SELECT DISTINCT p_type FROM part UNION SELECT DISTINCT upper(replace(p_name, ' ', '_')) FROM part
 UNION SELECT DISTINCT replace(p_name, ' ', '') FROM part UNION SELECT DISTINCT 'CP1_' || p_brand || '_' || p_type FROM part),
cat AS (SELECT DISTINCT p_brand AS channel_name, p_type || ', ' || p_name AS label FROM part),
k AS (SELECT 1 AS tier, 'marker' AS method, 'exact' AS form, trim(split_part(label, ',', 2)) AS key, label FROM cat UNION ALL
 SELECT 0, 'direct', 'exact', channel_name, label FROM cat UNION ALL SELECT 2, 'label', 'exact', label, label FROM cat UNION ALL
 SELECT 3, 'marker_fuzzy', 'fuzzy', lower(translate(trim(split_part(label, ',', 2)), '_-', '  ')), label FROM cat UNION ALL
 SELECT 4, 'label_fuzzy', 'fuzzy', lower(translate(label, '_-', '  ')), label FROM cat UNION ALL
 SELECT 5, 'marker_collapsed', 'collapsed', lower(regexp_replace(trim(split_part(label, ',', 2)), '[_ -]', '', 'g')), label FROM cat UNION ALL
 SELECT 6, 'label_collapsed', 'collapsed', lower(regexp_replace(label, '[_ -]', '', 'g')), label FROM cat),
h AS (SELECT channel, tier, method, label FROM asked JOIN k ON (form = 'exact' AND key = channel) OR (form = 'fuzzy' AND key = lower(translate(channel, '_-', '  ')))
  OR (form = 'collapsed' AND key = lower(regexp_replace(channel, '[_ -]', '', 'g')))
 UNION ALL SELECT channel, 7, 'stain', split_part(channel, '_', 2) || ', ' || split_part(channel, '_', 3) FROM asked WHERE channel LIKE 'CP1\\_%' ESCAPE '\\'
 UNION ALL SELECT channel, 9, 'unresolved', '(unmapped: ' || channel || ')' FROM asked)
SELECT channel, label, method FROM h QUALIFY row_number() OVER (PARTITION BY channel ORDER BY tier, label) = 1""")
def j17(spark, sf):
    p = T.read(spark, sf, "part")
    c = lambda e: p.select(e.alias("channel"))
    n = F.col("p_name")
    asked = c(n).union(c(F.col("p_type"))).union(c(F.upper(F.replace(n, F.lit(" "), F.lit("_"))))).union(c(F.replace(n, F.lit(" "), F.lit("")))).union(
        c(F.concat_ws("_", F.lit("CP1"), "p_brand", "p_type"))
    )
    cat = p.select(F.col("p_brand").alias("channel_name"), F.concat_ws(", ", "p_type", "p_name").alias("label")).distinct()
    return J.resolve_labels(asked, cat)


@query("j18_gene_reporter_matrix", f"""WITH {T.GENE_CELLS} SELECT gene, avg(cell_area) FILTER (batch = 'FURNITURE') AS FURNITURE, avg(cell_area) FILTER (batch = 'MACHINERY') AS MACHINERY FROM gene_cells GROUP BY 1""",
    doubles="FURNITURE MACHINERY", digits=4)
def j18(spark, sf):
    return T.gene_cells(spark, sf).groupBy("gene").pivot("batch", ["FURNITURE", "MACHINERY"]).agg(F.avg("cell_area"))


@query("j19_majority_label", f"""WITH {T.BRANCHES}, c AS (SELECT cell_id, organelle, src, count(*) AS n FROM branches GROUP BY 1, 2, 3)
SELECT cell_id, organelle, src, n FROM c QUALIFY row_number() OVER (PARTITION BY cell_id, organelle ORDER BY n DESC, src) = 1""")
def j19(spark, sf):
    return J.majority_label(T.branches(spark, sf), ["cell_id", "organelle"], "src")


_CHANNELS = [(0, "Phase2D"), (1, "Focus3D"), (2, "CP1_nuclei_Hoechst"), (3, "CP2_actin_Phalloidin")]
_CHANNELS_SQL = "(VALUES (0, 'phase2d'), (1, 'focus3d'), (2, 'cp1_nuclei_hoechst'), (3, 'cp2_actin_phalloidin')) AS c(i, ch)"


@query("j20_label_to_channel", f"""WITH {_NAMES_SQL}, l AS (SELECT feature AS label, split_part(feature, '_', 1) || '_' || split_part(feature, '_', 2) AS key FROM names)
SELECT DISTINCT key AS label, CASE WHEN key LIKE 'cp1_nuclei%' THEN 2 WHEN key LIKE 'cp2_actin%' THEN 3 WHEN key LIKE 'phase2d%' THEN 0 END AS channel_index FROM l""")
def j20(spark, sf):
    key = F.concat_ws("_", F.split("feature", "_")[0], F.split("feature", "_")[1])
    channels = spark.createDataFrame(_CHANNELS, "index int, channel string")
    return J.channel_of_label(names(spark, sf).select(key.alias("label")).distinct(), channels)


@query("p22_shortest_match", f"""WITH {_PARSED_SQL}, n AS (SELECT DISTINCT organelle FROM parsed WHERE organelle IS NOT NULL), pat AS (SELECT DISTINCT upper(substr(organelle, 1, 2)) AS pattern FROM n)
SELECT pattern, arg_min(organelle, (length(organelle), organelle)) AS organelle FROM pat JOIN n ON contains(lower(organelle), lower(pattern)) GROUP BY 1""")
def p22(spark, sf):
    n = parsed(spark, sf).where(F.col("organelle").isNotNull()).select("organelle").distinct()
    return J.shortest_match(n, n.select(F.upper(F.substring("organelle", 1, 2)).alias("pattern")).distinct())


@query("p23_group_sides", f"""WITH {_PARSED_SQL} SELECT CASE WHEN regexp_matches(organelle, '^cp[12]_') THEN 'fixed' ELSE 'other' END AS side, count(*) AS n FROM parsed WHERE organelle IS NOT NULL GROUP BY 1""")
def p23(spark, sf):
    p = parsed(spark, sf).where(F.col("organelle").isNotNull()).withColumn("side", J.stain_side(F.col("organelle")))
    return S.value_counts(p, "side")


@query("p25_sets_in_data", f"""WITH {T.GENES}, have AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS gene FROM customer WHERE c_nationkey % 3 <> 0)
SELECT set_id, array_to_string(list_sort(list(DISTINCT gene)), ',') AS genes, count(DISTINCT gene) AS n_genes FROM genes WHERE gene IN (SELECT gene FROM have) GROUP BY 1 HAVING count(DISTINCT gene) >= 2""")
def p25(spark, sf):
    have = T.guides(spark, sf).where(F.col("gene").cast("int") % 3 != 0)
    kept, _ = J.restrict_sets(T.genes(spark, sf), have)
    return kept.withColumn("genes", F.array_join("genes", ","))


@query("p25_genes_missing_from_data", f"""WITH {T.GENES} SELECT set_id, gene FROM genes WHERE CAST(gene AS INT) % 3 = 0""")
def p25m(spark, sf):
    have = T.guides(spark, sf).where(F.col("gene").cast("int") % 3 != 0)
    return J.restrict_sets(T.genes(spark, sf), have)[1]


# --- sources ----------------------------------------------------------------------------------
@query("s1_read_batches", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def s1(spark, sf):
    return IO.read_batches(spark, f"{sf}/lineitem.parquet").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("s2_read_partition", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '5-LOW'", doubles="o_totalprice")
def s2(spark, sf):
    return IO.read_partition(spark, f"{sf}/orders.parquet", "5-LOW", "o_orderpriority", ["o_orderkey", "o_totalprice"])


@query("s3_pruned_read", "SELECT l_orderkey AS cell_id, l_returnflag AS organelle_name FROM lineitem")
def s3(spark, sf):
    return T.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("cell_id"), F.col("l_returnflag").alias("organelle_name"))


@query("s4_row_count", "SELECT count(*) AS n FROM lineitem")
def s4(spark, sf):
    return T.read(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("s6_read_chunks", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders")
def s6(spark, sf):
    df = IO.read_chunks(spark, f"{sf}/orders.parquet")
    return df.where(F.length("organelle") > 0).agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("keys"))


@query("s7_load_profiles", f"""WITH {T.GENE_CELLS} SELECT cell_id, CASE WHEN gene = '0' THEN 'NTC' ELSE gene END AS gene, cell_area, [0, 0, CAST(cell_id % 50 AS INT), 9] AS bbox FROM gene_cells""", doubles="cell_area")
def s7(spark, sf):
    c = T.gene_cells(spark, sf)
    obs = c.select("cell_id", "gene", F.concat(F.lit("[0 0 "), (F.col("cell_id") % 50).cast("string"), F.lit(" 9]")).alias("bbox"))
    return IO.load_profiles(c.select("cell_id", F.col("cell_area").cast("string").alias("cell_area")), obs, "cell_id", ["bbox"], ["cell_area"], "gene")


@query("s11_gene_sets", f"""WITH {T.GENES}, s AS (SELECT set_id, 'SET_' || set_id AS set_name, list(gene) AS genes FROM genes GROUP BY 1)
SELECT set_id, set_name, unnest(list_distinct(genes)) AS gene FROM s WHERE set_name <> 'SET_1' AND len(list_distinct(genes)) >= 5""")
def s11(spark, sf):
    s = T.genes(spark, sf).groupBy("set_id").agg(F.collect_list("gene").alias("genes"))
    return IO.gene_sets(s.select("set_id", F.concat(F.lit("SET_"), "set_id").alias("set_name"), "genes"), ["SET_1"], 5)


@query("s12_remaining_tasks", f"""WITH {T.OBJECTS}, t AS (SELECT DISTINCT cell_id, organelle FROM objects) SELECT * FROM t WHERE (cell_id, organelle) NOT IN (SELECT (cell_id, organelle) FROM objects WHERE label = 1)""")
def s12(spark, sf):
    o = T.objects(spark, sf)
    return IO.remaining(o.select("cell_id", "organelle").distinct(), o.where("label = 1"), ["cell_id", "organelle"])


@query("s13_outer_concat", f"""WITH {T.OBJECTS} SELECT cell_id, organelle, CASE WHEN organelle = 'A' THEN area ELSE 0 END AS area, CASE WHEN organelle <> 'A' THEN extent ELSE 0 END AS extent FROM objects""", doubles="area extent")
def s13(spark, sf):
    o = T.objects(spark, sf)
    a = o.where("organelle = 'A'").select("cell_id", "organelle", "area")
    return IO.outer_concat([a, o.where("organelle <> 'A'").select("cell_id", "organelle", "extent")], ["area", "extent"])


@query("s14_collected_summaries", f"""WITH {T.GENE_CELLS} SELECT batch, well, n FROM (SELECT batch, well, count(*) AS n FROM gene_cells GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY batch ORDER BY n DESC, well) = 1""")
def s14(spark, sf):
    g = T.gene_cells(spark, sf).groupBy("batch", "well").agg(F.count(F.lit(1)).alias("n"))
    return IO.collect_summaries([g.where("well < '3'"), g.where("well >= '3'")], "batch", F.struct((-F.col("n")).alias("a"), F.col("well").alias("b")))


def _s15(join):
    def q(spark, sf):
        g = T.gene_cells(spark, sf).where("status <> 'P' OR batch = 'FURNITURE'")
        parts = [g.where(F.col("status") == s) for s in "FOP"]
        return IO.combine_by_signal(parts, "guide", "status", "cell_area", ["F", "O", "P"], join)

    return q


_S15 = """WITH {gc}, w AS (SELECT guide, avg(cell_area) FILTER (status = 'F') AS F_cell_area, avg(cell_area) FILTER (status = 'O') AS O_cell_area, avg(cell_area) FILTER (status = 'P') AS P_cell_area,
 count(DISTINCT status) AS n_signals FROM gene_cells WHERE status <> 'P' OR batch = 'FURNITURE' GROUP BY 1) SELECT * FROM w {where}"""
for _j, _w in (("inner", "WHERE n_signals = 3"), ("outer", "")):
    query(f"s15_combined_signals_{_j}", _S15.format(gc=T.GENE_CELLS, where=_w), doubles="F_cell_area O_cell_area P_cell_area", digits=4)(_s15(_j))


@query("s16_channel_files", """WITH f AS (SELECT url AS path, regexp_extract(url, '^(.*)/[^/]+/[^/]+$', 1) AS root, regexp_extract(url, '/([^/]+)/[^/]+$', 1) AS experiment,
 regexp_extract(url, '/([^/]+?)(\\.[^./]+)?$', 1) AS channel FROM pages), r AS (SELECT *, CASE WHEN root LIKE 'http:%' THEN 1 ELSE 2 END AS k FROM f WHERE experiment <> '' AND channel NOT LIKE '.%')
SELECT path, experiment, channel FROM r QUALIFY row_number() OVER (PARTITION BY experiment, channel ORDER BY k, path) = 1""")
def s16(spark, sf):
    p = T.read(spark, sf, "pages").select(F.col("url").alias("path"))
    exp, root = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1), F.regexp_extract("path", r"^(.*)/[^/]+/[^/]+$", 1)
    marked = p.where(exp != "").select(F.concat_ws("/", F.when(root.startswith("http:"), "r1").otherwise("r2"), exp, F.regexp_extract("path", r"/([^/]+)$", 1)).alias("path"), F.col("path").alias("url"))
    # one channel may have files of several endings: the first address of all of them is asked for
    out = IO.channel_files(marked, ["r1", "r2"], by="url")
    return out.select(F.col("url").alias("path"), "experiment", "channel")


@query("s17_interactive_extract", f"""WITH {T.OBJECT_ROWS} SELECT cell_id, gene, well, avg(intensity_mean) AS intensity_mean, avg(area) AS area FROM object_rows GROUP BY 1, 2, 3""", doubles="intensity_mean area", digits=5)
def s17(spark, sf):
    rows = T.object_rows(spark, sf)
    top = [r["feature"] for r in S.variance_ranking(T.object_long(spark, sf), 2).collect()]
    return rows.groupBy("cell_id", "gene", "well").agg(*[F.avg(t).alias(t) for t in top])


@query("s18_append_coordinates", f"""WITH {T.CELLS} SELECT cell_id, well, x.value AS umap_1 FROM cells LEFT JOIN (SELECT event_id AS cell_id, value FROM events) x USING (cell_id)""", doubles="umap_1")
def s18(spark, sf):
    e = T.read(spark, sf, "events").select(F.col("event_id").alias("cell_id"), F.col("value").alias("umap_1"))
    return IO.append_by_id(T.cells(spark, sf).select("cell_id", "well"), e, "cell_id")


# --- scalar functions -------------------------------------------------------------------------
@query("f3_f4_f7_name_parts", """SELECT DISTINCT p_type || ', ' || p_name AS label, p_type AS reporter, p_brand || '_PC' || (p_size % 4) AS pc, p_brand AS pc_reporter, split_part(replace(p_name, ' ', '_'), '_', 1) AS short FROM part""")
def f3(spark, sf):
    p = T.read(spark, sf, "part")
    label, pc = F.concat_ws(", ", "p_type", "p_name"), F.concat(F.col("p_brand"), F.lit("_PC"), (F.col("p_size") % 4).cast("string"))
    return p.select(label.alias("label"), X.reporter_type(label).alias("reporter"), pc.alias("pc"), X.reporter_of_component(pc).alias("pc_reporter"),
                    X.short_experiment(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("short")).distinct()


@query("f5_f6_label_codes", """SELECT DISTINCT p_type, p_name, lower(substr(p_type, 1, 5) || '_' || substr(p_name, 1, 6) || '_' || p_brand || '_seg') AS code,
 lower(translate(p_name || '-X', '_-', '  ')) AS fuzzy, lower(regexp_replace(p_name || '-X', '[_ -]', '', 'g')) AS collapsed FROM part""")
def f5(spark, sf):
    p = T.read(spark, sf, "part")
    n = F.concat("p_name", F.lit("-X"))
    return p.select("p_type", "p_name", X.label_code(F.col("p_type"), F.col("p_name"), F.col("p_brand")).alias("code"), X.fuzzy_key(n).alias("fuzzy"), X.collapsed_key(n).alias("collapsed")).distinct()


@query("f8_strip_aggregates", f"""WITH {_NAMES_SQL} SELECT feature || '_max' AS feature, feature AS outermost, regexp_replace(feature, '(_(mean|median|std|sum|min|max|count))+$', '') AS base FROM names""")
def f8(spark, sf):
    f = F.concat("feature", F.lit("_max"))
    return names(spark, sf).select(f.alias("feature"), X.strip_aggregates(f).alias("outermost"), X.strip_aggregates(f, recursive=True).alias("base"))


@query("f12_bbox_parse", f"""WITH {T.CELLS} SELECT cell_id, CASE WHEN cell_id % 5 IN (0, 1) THEN [1, 2, CAST(cell_id % 40 AS INT) + 1, CAST(cell_id % 30 AS INT) + 2] END AS box,
 CASE WHEN cell_id % 5 IN (0, 1) THEN CAST(cell_id % 40 AS INT) * CAST(cell_id % 30 AS INT) END AS area FROM cells""")
def f12(spark, sf):
    i = F.col("cell_id")
    a, b = (i % 40 + 1).cast("string"), (i % 30 + 2).cast("string")
    text = F.when(i % 5 == 0, F.concat(F.lit("[1 2 "), a, F.lit(" "), b, F.lit("]"))).when(i % 5 == 1, F.concat(F.lit("(1, 2, "), a, F.lit(", "), b, F.lit(")"))).when(i % 5 == 2, "nan").when(i % 5 == 3, "[1 2 3]")
    box = X.parse_bbox(text)
    return T.cells(spark, sf).select("cell_id", box.alias("box"), X.bbox_area(box).alias("area"))


@query("f13_f14_f17_arithmetic", f"""WITH {T.OBJECTS} SELECT cell_id, label, organelle, area, CASE WHEN (extent + 1e-10) / (eccentricity + 1e-10) > 0 THEN log2((extent + 1e-10) / (eccentricity + 1e-10)) END AS log2_eps,
 CASE WHEN extent / (CASE WHEN eccentricity = 0 THEN 1e-9 ELSE eccentricity END) > 0 THEN log2(extent / (CASE WHEN eccentricity = 0 THEN 1e-9 ELSE eccentricity END)) END AS log2_floor,
 -log10(greatest(extent, 1e-300)) AS neg_log10, sqrt(area * area + label * label) AS radius, (area / 2) / 0.325 / sqrt(2) AS sigma, area / 0.325 AS px FROM objects""", doubles="area log2_eps log2_floor neg_log10 radius sigma px")
def f13(spark, sf):
    e, c, a = F.col("extent"), F.col("eccentricity"), F.col("area")
    px = F.lit(0.325)
    return T.objects(spark, sf).select(
        "cell_id", "label", "organelle", "area", X.log2_ratio(e, c).alias("log2_eps"), X.log2_ratio_floor(e, c).alias("log2_floor"),
        X.neg_log10(e).alias("neg_log10"), X.hypot(a, F.col("label")).alias("radius"), X.blob_sigma(a, px).alias("sigma"), X.micron_to_pixels(a, px).alias("px"),
    )


@query("f15_derived_shape", f"""WITH {T.OBJECTS}, s AS (SELECT cell_id, organelle, area, area AS major, label AS minor FROM objects), p AS (SELECT *, pi() * (3 * (major / 2 + minor / 2.0) - sqrt((3 * major / 2 + minor / 2.0) * (major / 2 + 3 * minor / 2.0))) AS perimeter FROM s)
SELECT cell_id, organelle, major, minor, major / minor AS aspect_ratio, perimeter, 4 * pi() * area / (perimeter * perimeter) AS circularity FROM p""", doubles="major aspect_ratio perimeter circularity")
def f15(spark, sf):
    s = T.objects(spark, sf).select("cell_id", "organelle", "area", F.col("area").alias("major"), F.col("label").alias("minor"))
    p = s.withColumn("perimeter", X.ellipse_perimeter(F.col("major"), F.col("minor")))
    return p.select("cell_id", "organelle", "major", "minor", X.aspect_ratio(F.col("major"), F.col("minor")).alias("aspect_ratio"), "perimeter", X.circularity(F.col("area"), F.col("perimeter")).alias("circularity"))


@query("f18_vector_functions", f"""WITH {T.PROFILES}, c AS (SELECT list(m ORDER BY i) AS ref FROM (SELECT i, avg(features[i]) AS m FROM profiles, range(1, 65) t(i) GROUP BY i))
SELECT id, list_dot_product(features, ref) AS dot, sqrt(list_dot_product(features, features)) AS norm, list_cosine_similarity(features, ref) AS cosine, list_distance(features, ref) AS distance FROM profiles, c""", doubles="dot norm cosine distance")
def f18(spark, sf):
    from screenforge.operators.longform import array_to_long, to_vector

    p = T.profiles(spark, sf)
    mean = array_to_long(p, ["id"], "features").groupBy("dim").agg(F.avg("value").alias("value"))
    ref = to_vector(mean.withColumn("g", F.lit(0)), ["g"], "dim").select("features")
    q = p.withColumn("ref", ref.scalar())
    a, b = F.col("features"), F.col("ref")
    return q.select("id", X.dot(a, b).alias("dot"), X.norm(a).alias("norm"), X.cosine(a, b).alias("cosine"), X.euclidean(a, b).alias("distance"))
